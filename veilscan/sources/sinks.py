"""Reports: JSON, SARIF, CI annotations, Markdown, terminal text, rewritten files.

Rows are made by native expressions. Whole reports are written by tasks through
the data source of ``reports``, and files are rewritten by the tasks that clean
them, so neither findings nor texts pass through the driver.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dims import SEVERITIES
from ..operators.scan import sanitized, scan_keys
from . import reports

TOOL = "veilscan"
#: SARIF levels, security severities and annotation commands by severity.
LEVELS = ("note", "note", "warning", "error", "error")
SECURITY = ("1.0", "3.0", "5.0", "8.0", "9.5")
COMMANDS = ("notice", "notice", "warning", "error", "error")
#: Most positions in a JSON report, differences of a comparison, and offsets in Markdown.
MOST_POSITIONS, MOST_DIFFERENCES, MOST_OFFSETS = 200, 200, 40


def _pick(values: tuple, severity: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), severity)


def one_line(text: Column, most: int) -> Column:
    """White space as single spaces, cut to ``most`` with three dots."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most - 3), F.lit("..."))).otherwise(flat)


def line_and_column(text: Column, offset: Column) -> tuple[Column, Column]:
    """1-based line and column of a UTF-16 offset; lines end at line feeds alone."""
    before = F.decode(F.substring(F.encode(text, "UTF-16BE"), F.lit(1), (2 * offset).cast("int")), "UTF-16BE")
    last = F.substring_index(before, "\n", -1)
    return (F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1).cast("int"), (F.octet_length(F.encode(last, "UTF-16BE")) / 2 + 1).cast("int")


def located(files: DataFrame, path: str = "path", text: str = "text", ignore: tuple[str, ...] = ()) -> DataFrame:
    """A row for each finding: path, rank, line, column, level and what reports say of it."""
    rows = scan_keys(files, path, text=text, ignore=ignore).select(F.col(path).alias("path"), F.posexplode("findings").alias("rank", "f"))
    labels = F.array_join(F.transform("f.intents", lambda x: x["label"]), ", ")
    message = F.concat_ws(
        " -- ", "f.title", F.when(F.col("f.count") > 1, F.concat(F.lit("x"), F.col("f.count"))), F.when(F.col("f.decoded") != "", F.concat(F.lit('Decoded: "'), one_line(F.col("f.decoded"), 200), F.lit('"'))),
        F.when(F.size("f.intents") > 0, F.concat(F.lit("reads as "), labels)), F.when(F.col("f.reference") != "", F.concat(F.lit("("), F.col("f.reference"), F.lit(")"))),
    )
    return rows.select(
        F.replace("path", F.lit("\\"), F.lit("/")).alias("path"), "rank", _pick(LEVELS, F.col("f.severity")).alias("level"), message.alias("message"), labels.alias("intent_labels"), "f.*"
    )


def _json(text: Column) -> Column:
    """A string as JSON."""
    listed = F.to_json(F.array(text))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def sarif_results(found: DataFrame) -> DataFrame:
    """``located`` findings with ``value``, the SARIF result of each, and ``rule``, what its rule would be if it is the first of its id."""
    region = F.struct(F.col("line").alias("startLine"), F.col("column").alias("startColumn"), (F.col("column") + 1).alias("endColumn"))
    place = F.struct(F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    result = F.struct(
        F.col("id").alias("ruleId"), "level", F.struct(F.col("message").alias("text")).alias("message"), F.array(place).alias("locations"), F.struct(F.concat_ws(":", "id", "path", "line", "column").alias(TOOL)).alias("partialFingerprints")
    )
    name = F.array_join(F.transform(F.split("id", "-"), lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 1 << 30))), "")
    properties = F.struct(F.array(F.lit("security"), F.lit("unicode")).alias("tags"), _pick(SECURITY, F.col("severity")).alias("security-severity"))
    full = F.substring(F.coalesce(F.nullif("detail", F.lit("")), "title"), 1, 900)
    rule = F.struct(
        "id", name.alias("name"), F.struct(F.col("title").alias("text")).alias("shortDescription"), F.struct(full.alias("text")).alias("fullDescription"), F.struct("level").alias("defaultConfiguration"), properties.alias("properties")
    )
    return found.withColumns({"value": F.to_json(result), "rule": F.to_json(rule)})


def sarif_rules(files: DataFrame, path: str = "path", text: str = "text", ignore: tuple[str, ...] = ()) -> DataFrame:
    """id, path, rank, level, rule: the first finding of each id, by path and rank, which its rule is made from."""
    rows = sarif_results(located(files, path, text, ignore))
    first = rows.groupBy("id").agg(F.min_by(F.struct("path", "rank", "level", "rule"), F.struct("path", "rank")).alias("first"))
    return first.select("id", "first.*")


def _write(rows: DataFrame, kind: str, target: str, layout: str, **options: str) -> None:
    """Rows of ``reports.ROWS`` as a report, by path. They are few beside the texts, and kept on disk so that sorting reads no text twice."""
    spark = rows.sparkSession
    spark.dataSource.register(reports.Report)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kept = rows.persist(StorageLevel.DISK_ONLY)
    try:
        ordered = kept.repartitionByRange(parts, "path", "rank").sortWithinPartitions("path", "rank")
        ordered.write.format(reports.NAME).mode("append").options(kind=kind, layout=layout, tool=TOOL, **options).save(target)
    finally:
        kept.unpersist()


def write_sarif(files: DataFrame, target: str, path: str = "path", text: str = "text", ignore: tuple[str, ...] = (), version: str = "0.1.0", layout: str = "file") -> None:
    """A SARIF 2.1.0 log, or a folder of them: a rule from the first finding of each id, a result for each finding at its first place."""
    found = sarif_results(located(files, path, text, ignore))
    rows = found.select(F.lit("results").alias("section"), "path", "rank", "severity", "value", F.col("id").alias("rule_id"), "rule")
    _write(rows, "sarif", target, layout, version=version)


def _escaped(text: Column, also: str = "") -> Column:
    for ch in "%\r\n" + also:  # the percent sign first
        text = F.replace(text, F.lit(ch), F.lit(f"%{ord(ch):02X}"))
    return text


def annotations(files: DataFrame, path: str = "path", text: str = "text", ignore: tuple[str, ...] = ()) -> DataFrame:
    """path, rank, command: a workflow command for each finding."""
    rows = located(files, path, text, ignore)
    samples = one_line(F.array_join(F.slice("samples", 1, 3), "  "), 160)
    said = F.concat_ws(
        " -- ", F.concat("title", F.when(F.col("count") > 1, F.concat(F.lit(" (x"), F.col("count"), F.lit(")"))).otherwise("")),
        F.when(F.col("decoded") != "", F.concat(F.lit("decoded: "), _json(one_line(F.col("decoded"), 200)))),
        F.when(F.col("intent_labels") != "", F.concat(F.lit("reads as: "), F.col("intent_labels"))), F.when(F.size("samples") > 0, samples),
    )
    title = F.concat(F.lit(f"{TOOL} "), _pick(SEVERITIES, F.col("severity")), F.lit(": "), F.col("id"))
    command = F.concat(F.lit("::"), _pick(COMMANDS, F.col("severity")), F.lit(" file="), _escaped(F.col("path"), ":,"), F.lit(",line="), F.col("line"), F.lit(",col="), F.col("column"), F.lit(",title="), _escaped(title, ":,"), F.lit("::"), _escaped(said))
    return rows.select("path", "rank", command.alias("command"))


def json_rows(files: DataFrame, path: str = "path", text: str = "text", ignore: tuple[str, ...] = ()) -> DataFrame:
    """path, severity, json: the report of each text as one JSON object."""
    found = F.transform(
        "findings",
        lambda f: F.struct(
            f["id"].alias("id"), f["title"].alias("title"), _pick(SEVERITIES, f["severity"]).alias("severity"), f["count"].alias("count"), F.slice(f["positions"], 1, MOST_POSITIONS).alias("positions"), f["decoded"].alias("decoded"),
            F.transform(f["intents"], lambda i: i["label"]).alias("intents"), f["reference"].alias("reference"),
        ),
    )
    stats = F.struct("codepoints", "units", "bytes", "visible", "hidden", F.col("benign_hidden").alias("benignHidden"), "confusables", F.col("n_findings").alias("findings"))
    rows = scan_keys(files, path, text=text, ignore=ignore)
    return rows.select(F.col(path).alias("path"), "severity", F.to_json(F.struct(F.col(path).alias("path"), F.col("label").alias("verdict"), stats.alias("stats"), found.alias("findings"))).alias("json"))


def write_json(files: DataFrame, target: str, skipped: DataFrame | None = None, path: str = "path", text: str = "text", ignore: tuple[str, ...] = (), all_files: bool = True, layout: str = "file") -> None:
    """The whole report as one object, or a folder of them: files, those that were skipped and why, the worst severity; ignored files are only counted."""
    none = F.lit(None).cast("string")
    rest = [none.alias("rule_id"), none.alias("rule")]
    rows = json_rows(files, path, text, ignore).filter(F.lit(all_files) | (F.col("severity") >= 0))
    rows = rows.select(F.lit("files").alias("section"), "path", F.lit(0).alias("rank"), "severity", F.col("json").alias("value"), *rest)
    if skipped is not None:
        ignored = F.col("reason") == "git-ignored"
        said = F.when(~ignored, F.to_json(F.struct("path", "reason")))
        rows = rows.unionByName(skipped.select(F.when(ignored, "gitignored").otherwise("skipped").alias("section"), "path", F.lit(0).alias("rank"), F.lit(-1).alias("severity"), said.alias("value"), *rest))
    _write(rows, "json", target, layout, labels=json.dumps(["CLEAN", *SEVERITIES]))


def comparison_json(compared: DataFrame) -> DataFrame:
    """The input's columns of ``operators.scan.compare`` as one JSON object a pair."""
    copy = lambda c: F.struct(f"{c}.hidden", f"{c}.signature", F.transform(f"{c}.payloads", lambda p: F.struct(p["id"].alias("id"), p["decoded"].alias("decoded"))).alias("payloads"))
    cut = F.transform(F.slice("differences", 1, MOST_DIFFERENCES), lambda d: F.struct(d["at"].alias("at"), d["context"].alias("context"), d["a"].alias("a"), d["b"].alias("b")))
    body = F.struct(F.lit(1).alias("version"), "relation", F.col("same_visible").alias("sameVisible"), F.col("same_bytes").alias("sameBytes"), F.col("differing_codepoints").alias("differingCodepoints"), F.array(copy("copy_a"), copy("copy_b")).alias("copies"), cut.alias("differences"))
    return compared.withColumn("json", F.to_json(body))


def markdown(row) -> str:
    """The report of one scanned row."""
    out = ["# Hidden-text report", "", f"- verdict: {row['label']}", *(f"- {k.replace('_', ' ')}: {row[k]}" for k in ("codepoints", "visible", "hidden", "benign_hidden")), ""]
    for f in row["findings"]:
        out += [f"## [{SEVERITIES[f['severity']]}] {f['title']}", "", f"- occurrences: {f['count']}"]
        out += [f"- {name}: {f[k]}" for name, k in (("reference", "reference"), ("encoding", "scheme")) if f[k]]
        if f["positions"]:
            out.append("- offsets: " + ", ".join(map(str, f["positions"][:MOST_OFFSETS])) + (", ..." if len(f["positions"]) > MOST_OFFSETS else ""))
        out += ["", f["detail"] or "", ""]
        out += ["Decoded payload:", "", "```", f["decoded"], "```", ""] if f["decoded"] else []
        out += ["Reads as: " + ", ".join(i["label"] for i in f["intents"]), ""] if f["intents"] else []
    return "\n".join(out if row["findings"] else [*out, "No findings."])


def safe_path(path: str) -> str:
    """A path that cannot steer a terminal or pass for a workflow command."""
    shown = re.sub(r"[\x00-\x1f\x7f-\x9f]", lambda m: f"\\x{ord(m[0]):02x}", path)
    return f"./{shown}" if shown.startswith("::") else shown


def terminal(row, path: str) -> str:
    """One scanned row for a person."""
    out = [f"{safe_path(path)}: {row['label']}"]
    for f in row["findings"]:
        out.append(f"  {SEVERITIES[f['severity']]:8} {f['title']} ({f['count']})")
        if f["decoded"]:
            out.append(f"           decoded: {json.dumps(' '.join(f['decoded'].split())[:160])}")
        out += [f"           {s}" for s in f["samples"][:4]]
    return "\n".join(out)


def exit_code(worst: int | None, fail_on: str | None = None, sarif: bool = False) -> int:
    """1 if the scan reaches ``fail_on`` (HIGH unless given; a SARIF run fails only if it is given); 2 for an unknown level."""
    if fail_on is not None and fail_on.upper() not in SEVERITIES:
        return 2
    if sarif and fail_on is None:
        return 0
    return int((-1 if worst is None else worst) >= SEVERITIES.index((fail_on or "HIGH").upper()))


#: Byte-order marks that a rewritten file keeps.
MARKS = {"utf-16le": b"\xff\xfe", "utf-16be": b"\xfe\xff", "utf-8": b""}


def rewrite(path: str, text: str, encoding: str) -> None:
    """Put a cleaned text back in the file's own encoding; the file is replaced whole or not at all."""
    temporary = f"{path}.{os.getpid()}.part"
    with open(temporary, "wb") as f:
        f.write(MARKS[encoding] + text.encode(encoding))
    os.replace(temporary, path)


def _put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, kind, text in zip(batch.column("path"), batch.column("encoding"), batch.column("text"), strict=True):  # one text at a time becomes Python's
            to = path.as_py()
            os.makedirs(os.path.dirname(to), exist_ok=True)
            rewrite(to, text.as_py() or "", kind.as_py())
        yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])


#: Texts that a task which writes files is handed at a time.
AT_A_TIME = 500


def write_files(texts: DataFrame) -> int:
    """Each (path, encoding, text) as a file of its own, null texts as empty ones, written by tasks; returns how many. Of rows that repeat a path, one stays."""
    conf, name = texts.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(name)
    conf.set(name, AT_A_TIME)  # thousands of long texts at once are most of what a task holds
    try:
        return texts.select("path", "encoding", "text").mapInArrow(_put, "n long").agg(F.sum("n")).first()[0] or 0
    finally:
        conf.set(name, before)


def _rewrite(batches: Iterator[pa.RecordBatch], refuse) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        paths = batch.column("path").to_pylist()
        refused = [bool(refuse(p)) for p in paths]
        for path, kind, text, no in zip(paths, batch.column("encoding").to_pylist(), batch.column("sanitized").to_pylist(), refused, strict=True):
            if not no:
                rewrite(path, text, kind)
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(refused, pa.bool_())], ["path", "refused"])


def fix(files: DataFrame, refuse=lambda path: False, **options) -> DataFrame:
    """Rewrite in place what sanitizing changes in (path, encoding, text); returns path and refused, a row for each file that changes or that ``refuse`` keeps as it is.

    The tasks that clean rewrite, each file whole or not at all, so a task that
    runs again finds done what it did. The rows are kept on disk by Spark; if an
    executor is lost after that, those of files it had rewritten may be missing,
    as nothing is left to change in them.
    """
    clean = sanitized(files, "path", keep=("encoding",), **options)
    changed = clean.filter(~F.col("text").eqNullSafe(F.col("sanitized"))).select("path", "encoding", "sanitized")
    done = changed.mapInArrow(partial(_rewrite, refuse=refuse), "path string, refused boolean").persist(StorageLevel.DISK_ONLY)
    done.count()
    return done
