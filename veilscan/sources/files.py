"""Files as a table: folders listed, and bytes read and decoded, by the executors."""

from __future__ import annotations

import json
import os
import re
import subprocess
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import folders

#: What is read by name, by ending, what is never walked into, and agents' own files.
NAMES = frozenset("CLAUDE.md AGENTS.md GEMINI.md SKILL.md README.md Dockerfile Containerfile Makefile Jenkinsfile Procfile Vagrantfile Gemfile Rakefile Brewfile CODEOWNERS LICENSE .cursorrules .windsurfrules .clinerules .roorules .goosehints .gitattributes .gitignore .gitmodules .npmrc .yarnrc .editorconfig .env .envrc".split())
ENDINGS = frozenset(
    ".md .markdown .mdx .mdc .txt .rst .adoc .tex .json .jsonc .json5 .yaml .yml .toml .ini .cfg .conf .properties .env .xml .svg .csv .tsv .ipynb .lock .js .mjs .cjs .ts .mts .cts .tsx .jsx .vue .svelte .py .rb .go .rs .java .kt .kts .scala .swift .dart .c .h .cc .cpp .hpp .cs .fs .php .pl .lua .r "
    ".ex .exs .erl .hs .clj .el .vim .zig .nix .sh .bash .zsh .fish .ps1 .psm1 .bat .cmd .html .htm .css .scss .less .sql .graphql .gql .proto .tf .hcl .gradle .cmake .mk".split()
)
SKIPPED_DIRS = frozenset("node_modules .git dist build vendor target .next .venv __pycache__ coverage".split())
AGENT_FILES = frozenset("CLAUDE.md CLAUDE.local.md AGENTS.md AGENTS.override.md GEMINI.md SKILL.md copilot-instructions.md .cursorrules .windsurfrules .clinerules .roorules .goosehints".split())
MOST_BYTES = 8 << 20


def is_readable(path: str) -> bool:
    name = os.path.basename(path)
    return name in NAMES or bool(re.match(r"\.env(?:\.|\Z)", name, re.I)) or os.path.splitext(name)[1].lower() in ENDINGS


def is_agent_file(path: str) -> bool:
    name = os.path.basename(path)
    return name in AGENT_FILES or name.endswith(".mdc")


def git_ignored(folder: str, deep: bool = True) -> set[str]:
    """Untracked files that the repository ignores, in a folder or all below it, as absolute paths; none outside a repository."""
    run = subprocess.run(["git", "-C", folder, "ls-files", "-z", "--others", "--ignored", "--exclude-standard", *(() if deep else ("--", ":(glob)*"))], capture_output=True)
    return {os.path.abspath(os.path.join(folder, p)) for p in run.stdout.decode("utf-8", "surrogateescape").split("\0") if p} if run.returncode == 0 else set()


#: Bytes of files that a task gathers before it passes them on, beside the one that is more.
HELD = 4 << 20
_read = pa.schema([("path", pa.string()), ("content", pa.binary()), ("wide", pa.string())])
_READ = "path string, content binary, wide string"


def _wide(content: bytes | None) -> str | None:
    """The text of a file in UTF-16; None for any other."""
    head = (content or b"")[:2]
    if head == b"\xff\xfe":
        return content[2:].decode("utf-16le", "replace")
    return content[2 : len(content) - len(content) % 2].decode("utf-16be", "replace") if head == b"\xfe\xff" else None


def _batches(found: Iterator[tuple[str, bytes | None]]) -> Iterator[pa.RecordBatch]:
    """Files with their bytes, and their text where only Python decodes it. A task holds ``HELD`` and a file, however many it reads."""
    held, size = [], 0
    for path, content in found:
        held.append((path, content, _wide(content)))
        size += len(content or b"")
        if size >= HELD or len(held) == 1000:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), _read.types, strict=True)], schema=_read)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), _read.types, strict=True)], schema=_read)


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes | None]]:
    for batch in batches:
        for path in batch.column("path").to_pylist():
            try:
                with open(path, "rb") as f:
                    content = f.read(MOST_BYTES + 1)
            except OSError:
                content = None
            yield path, content


def _load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _batches(_opened(batches))


def encoding(content: Column) -> Column:
    """utf-16le, utf-16be, binary or utf-8, by the first bytes."""
    head = F.hex(F.substring(content, 1, 2))
    return F.when(head == "FFFE", "utf-16le").when(head == "FEFF", "utf-16be").when(F.contains(F.substring(content, 1, 8192), F.lit(b"\0")), "binary").otherwise("utf-8")


def decoded(files: DataFrame) -> DataFrame:
    """(path, content, wide) -> path, content, encoding, text; UTF-8 natively with replacement characters and its mark kept, null text for binary files."""
    kinds = files.withColumn("encoding", encoding(F.col("content")))
    text = F.when(F.col("encoding") == "utf-8", F.make_valid_utf8(F.col("content").cast("string"))).otherwise(F.col("wide"))
    return kinds.select("path", "content", "encoding", text.alias("text"))


def _options(spark: SparkSession, roots: list[str], exclude: list[str], gitignore: bool) -> dict[str, str]:
    return {"roots": json.dumps(list(roots)), "exclude": json.dumps(list(exclude)), "gitignore": str(bool(gitignore)).lower(), "cwd": os.getcwd(), "tasks": str(spark.sparkContext.defaultParallelism)}


def listed(spark: SparkSession, roots: list[str], exclude: list[str] = (), gitignore: bool = True) -> DataFrame:
    """path, size, changed and the reason it is skipped for, of each file of the given kinds; a root that is a file is listed whatever its name."""
    spark.dataSource.register(folders.FolderSource)
    return spark.read.format(folders.NAME).options(**_options(spark, roots, exclude, gitignore)).load()


def _loaded(spark: SparkSession, paths: DataFrame) -> DataFrame:
    """Read in other tasks than listed, so that one large folder is read by all."""
    return decoded(paths.select("path").repartition(spark.sparkContext.defaultParallelism * 4).mapInArrow(_load, _READ))


def files(spark: SparkSession, roots: list[str], exclude: list[str] = (), gitignore: bool = True) -> tuple[DataFrame, DataFrame]:
    """(read files as path, content, encoding, text; skipped files as path, reason). Executors list and open the paths, so they share the folder."""
    found = listed(spark, roots, exclude, gitignore)
    loaded = _loaded(spark, found.filter("reason is null"))
    skipped = found.filter("reason is not null").select("path", "reason")
    gone = loaded.filter("content is null").select("path", F.lit("unreadable").alias("reason"))
    binary = loaded.filter("encoding = 'binary'").select("path", F.lit("binary").alias("reason"))
    return loaded.filter("content is not null and encoding <> 'binary'"), skipped.unionByName(binary).unionByName(gone)


def file_stream(spark: SparkSession, roots: list[str], exclude: list[str] = (), gitignore: bool = True) -> DataFrame:
    """Files that appear or change in folders, as path, content, encoding, text; names and endings as of ``files``, binary ones left out."""
    spark.dataSource.register(folders.FolderSource)
    found = spark.readStream.format(folders.NAME).options(**_options(spark, roots, exclude, gitignore)).load()
    return _loaded(spark, found.filter("reason is null")).filter("content is not null and encoding <> 'binary'")


def _contents(batches: Iterator[pa.RecordBatch], repository: str) -> Iterator[tuple[str, bytes]]:
    """Contents of blobs, one at a time from one git process."""
    with subprocess.Popen(["git", "-C", repository, "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE) as run:
        for batch in batches:
            for path, blob in zip(batch.column("path").to_pylist(), batch.column("blob").to_pylist(), strict=True):
                run.stdin.write(f"{blob}\n".encode())
                run.stdin.flush()
                size = int(run.stdout.readline().split(b" ")[2])
                content = run.stdout.read(size)
                run.stdout.read(1)
                yield path, content
        run.stdin.close()


def _blobs(batches: Iterator[pa.RecordBatch], repository: str) -> Iterator[pa.RecordBatch]:
    yield from _batches(_contents(batches, repository))


def staged(spark: SparkSession, repository: str) -> DataFrame:
    """Added, changed and moved files as the index holds them: path, content, encoding, text. Tasks read the list and the blobs."""
    spark.dataSource.register(folders.IndexSource)
    names = spark.read.format(folders.INDEX).option("repository", os.path.abspath(repository)).load()
    parts = spark.sparkContext.defaultParallelism
    return decoded(names.repartition(parts).mapInArrow(partial(_blobs, repository=os.path.abspath(repository)), _READ))


def text_source(spark: SparkSession, text, name: str = "<stdin>") -> DataFrame:
    """One text as a table; what is no string becomes one."""
    return spark.createDataFrame([(name, "" if text is None else str(text))], "path string, text string")


def _suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]*)\z", 1))


def readable(path: Column) -> Column:
    """``is_readable`` for paths that are already in a table."""
    name = F.regexp_extract(path, r"([^/]*)\z", 1)
    return name.isin(*sorted(NAMES)) | name.rlike(r"(?i)^\.env(?:\.|\z)") | _suffix(path).isin(*sorted(ENDINGS))




def pair(spark: SparkSession, a: str, b: str) -> DataFrame:
    """Two files as the copies of one text (path_a, path_b, text_a, text_b), both read as UTF-8."""
    texts = []
    for path in (a, b):
        with open(path, "rb") as f:
            texts.append(f.read().decode("utf-8", "replace"))
    return spark.createDataFrame([(a, b, *texts)], "path_a string, path_b string, text_a string, text_b string")


def differs_from_index(repository: str, path: str) -> bool:
    """Whether the working copy of a staged file has other changes, which a rewrite would mix with the staged ones."""
    return subprocess.run(["git", "-C", repository, "diff", "--quiet", "--", path]).returncode != 0
