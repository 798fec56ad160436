"""Corpus-scale reading: every text of a table, as findings, verdicts, statistics, clean copies and comparisons.

A native prefilter parts the texts that cannot hold a finding from the others;
only the others leave the JVM, in Arrow batches, so that neither a shuffle nor
Python touches plain text. Where the text itself is not returned, one pass over
the source does it. All functions defined here are row by row and legal on
streams; those of ``cells`` sort a text's characters by windows and are not.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import document, native
from ..functions.dims import INTENTS, SEVERITIES, VERDICT_LINES, VERDICTS, intent_pattern, intents_of
from .cells import cells, marks, payloads, stacks, views  # noqa: F401  the parts of a scan that windows compute

_finding = pa.struct([
    ("id", pa.string()), ("title", pa.string()), ("severity", pa.int32()), ("kind", pa.string()), ("count", pa.int32()), ("positions", pa.list_(pa.int32())), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
    ("decoded", pa.string()), ("scheme", pa.string()), ("intents", pa.list_(pa.struct([("label", pa.string()), ("match", pa.string())]))), ("reference", pa.string()), ("samples", pa.list_(pa.string())), ("detail", pa.string()), ("line", pa.int32()), ("column", pa.int32()),
])
FINDING = "struct<id: string, title: string, severity: int, kind: string, count: int, positions: array<int>, spans: array<struct<start: int, end: int>>, decoded: string, scheme: string, intents: array<struct<label: string, match: string>>, reference: string, samples: array<string>, detail: string, line: int, column: int>"
STATS = ("codepoints", "units", "bytes", "visible", "hidden", "benign_hidden", "confusables", "n_findings")
_row = pa.struct([("severity", pa.int32()), ("findings", pa.list_(_finding)), *((s, pa.int64()) for s in STATS)])
ROW = f"severity int, findings array<{FINDING}>, " + ", ".join(f"{s} long" for s in STATS)


def finding_row(f: document.Finding, reading: document.Reading) -> dict:
    line, column = reading.line_and_column(f.positions[0] if f.positions else 0)
    return asdict(f) | {"line": line, "column": column, "spans": [{"start": a, "end": b} for a, b in f.spans], "intents": [{"label": a, "match": b} for a, b in f.intents]}


def read_row(text: str | None, ignore: frozenset = frozenset()) -> dict:
    reading = document.Reading(text)
    stats = reading.stats()
    kept = [f for f in reading.findings if f.id not in ignore]
    stats["n_findings"] = stats.pop("findings")  # counts what was found, ignored or not
    return {"severity": max((f.severity for f in kept), default=-1), "findings": [finding_row(f, reading) for f in kept]} | stats


def _read_suspects(batches: Iterator[pa.RecordBatch], ignore: frozenset) -> Iterator[pa.RecordBatch]:
    """Rows with _t, null for a plain text, and _n and _b, its length and bytes."""
    kinds = [("severity", pa.int32()), ("findings", pa.list_(_finding)), *((s, pa.int64()) for s in STATS)]
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            plain = dict.fromkeys(STATS, 0) | {"severity": -1, "findings": []}
            rows = [plain | {"codepoints": n, "units": n, "bytes": b, "visible": n} if t is None else read_row(t, ignore) for t, n, b in zip(*(part.column(c).to_pylist() for c in ("_t", "_n", "_b")), strict=True)]
            kept = part.drop_columns(["_t", "_n", "_b"])
            yield pa.RecordBatch.from_arrays([*kept.columns, *(pa.array([r[k] for r in rows], kind) for k, kind in kinds)], [*kept.schema.names, *(k for k, _ in kinds)])


def _labelled(df: DataFrame) -> DataFrame:
    at = F.greatest("severity", F.lit(0))
    return df.withColumns({"label": F.get(F.array(*map(F.lit, VERDICTS)), at), "line": F.get(F.array(*map(F.lit, VERDICT_LINES)), at)})


def scan_keys(df: DataFrame, *keep: str, text: str = "text", ignore: tuple[str, ...] = ()) -> DataFrame:
    """As ``scan``, with the columns ``keep`` and without the text: one pass over the source, in which plain texts go to Python as nulls."""
    base = df.select(*keep, native.codepoints(F.col(text)).alias("_n"), native.utf8_bytes(F.col(text)).alias("_b"), F.when(native.suspect(F.col(text)), F.col(text)).alias("_t"))
    schema = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in keep) + ROW
    return _labelled(base.mapInArrow(partial(_read_suspects, ignore=frozenset(ignore)), schema))


def _of_suspects(text: str, read, schema: str, kind: pa.StructType):
    """A column of what ``read`` makes of each suspect text, null for plain ones. Python sees nulls for these, and other columns stay in the JVM."""

    @F.arrow_udf(schema)
    def column(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else read(t) for t in texts.to_pylist()], kind)

    return column(F.when(native.suspect(F.col(text)), F.col(text)))


def scan(df: DataFrame, text: str = "text", ignore: tuple[str, ...] = (), keep: tuple[str, ...] | None = None) -> DataFrame:
    """Every row of ``df`` (or the columns ``keep``) with severity, label, line, findings and statistics. Findings named in ``ignore`` are left out of both findings and verdict."""
    base = df.select(*keep, text) if keep is not None else df
    dropped, n, zero = frozenset(ignore), native.codepoints(F.col(text)), F.lit(0).cast("long")
    plain = {"severity": F.lit(-1), "findings": F.array().cast(f"array<{FINDING}>"), "codepoints": n, "units": n, "bytes": native.utf8_bytes(F.col(text)), "visible": n} | dict.fromkeys(STATS[4:], zero)
    read = base.withColumn("_veilscan_read", _of_suspects(text, lambda t: read_row(t, dropped), ROW, _row))
    return _labelled(read.select(*base.columns, *[F.coalesce(f"_veilscan_read.{c}", v).alias(c) for c, v in plain.items()]))


def findings(df: DataFrame, key: str = "doc_id", text: str = "text", ignore: tuple[str, ...] = ()) -> DataFrame:
    """A row for each finding: the key, its rank in its text, and the finding's fields."""
    return scan_keys(df, key, text=text, ignore=ignore).select(key, F.posexplode("findings").alias("rank", "f")).select(key, "rank", "f.*")


def verdicts(df: DataFrame, key: str = "doc_id", text: str = "text", ignore: tuple[str, ...] = ()) -> DataFrame:
    return scan_keys(df, key, text=text, ignore=ignore).select(key, "severity", "label", "line", *STATS)


def worst(df: DataFrame, text: str = "text", ignore: tuple[str, ...] = ()) -> int:
    return scan_keys(df, text=text, ignore=ignore).agg(F.max("severity")).first()[0]


def summary(df: DataFrame, text: str = "text", ignore: tuple[str, ...] = ()) -> DataFrame:
    """One row: texts, those with findings, findings, hidden characters, and the worst severity (-1 for none, as for an empty table)."""
    read = scan_keys(df, text=text, ignore=ignore)
    n = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return read.agg(F.count("*").alias("n_texts"), F.count_if(F.col("severity") >= 0).alias("n_flagged"), n(F.size("findings")).alias("n_findings"), n("hidden").alias("hidden"), F.coalesce(F.max("severity"), F.lit(-1)).alias("worst"))


def gate(df: DataFrame, text: str = "text", fail_on: str = "HIGH", ignore: tuple[str, ...] = ()) -> bool:
    """Whether some text is at least as severe as ``fail_on``."""
    found = worst(df, text, ignore)
    return found is not None and found >= SEVERITIES.index(fail_on.upper())


_cleaned = pa.struct([("text", pa.string()), ("changes", pa.list_(pa.struct([("label", pa.string()), ("count", pa.int64())]))), ("removed", pa.int64()), ("clean", pa.bool_())])
CLEANED = "text string, changes array<struct<label: string, count: bigint>>, removed long, clean boolean"


def sanitized(df: DataFrame, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] | None = None, **options) -> DataFrame:
    """key, sanitized, changes (label, count), removed, clean; with ``keep`` the text and the columns it names, too; options as of ``document.sanitize``."""
    kept = () if keep is None else (text, *keep)
    read = df.select(key, text, *(keep or ()), _of_suspects(text, lambda t: document.sanitize(t, **options), CLEANED, _cleaned).alias("_veilscan_read"))
    none = F.array().cast("array<struct<label: string, count: bigint>>")
    return read.select(key, *kept, F.coalesce("_veilscan_read.text", text, F.lit("")).alias("sanitized"), F.coalesce("_veilscan_read.changes", none).alias("changes"), F.coalesce("_veilscan_read.removed", F.lit(0).cast("long")).alias("removed"), F.coalesce("_veilscan_read.clean", F.lit(True)).alias("clean"))


_copy = pa.struct([("hidden", pa.int64()), ("signature", pa.string()), ("payloads", pa.list_(pa.struct([("id", pa.string()), ("decoded", pa.string()), ("scheme", pa.string())])))])
_difference = pa.list_(pa.struct([("at", pa.int32()), ("context", pa.string()), ("a", pa.list_(pa.string())), ("b", pa.list_(pa.string())), ("diverge_at", pa.int32())]))
_compared = pa.struct([("relation", pa.string()), ("same_bytes", pa.bool_()), ("same_visible", pa.bool_()), ("differences", _difference), ("differing_codepoints", pa.int64()), ("copy_a", _copy), ("copy_b", _copy)])
_copy_sql = "struct<hidden: bigint, signature: string, payloads: array<struct<id: string, decoded: string, scheme: string>>>"
COMPARISON = f"relation string, same_bytes boolean, same_visible boolean, differences array<struct<at: int, context: string, a: array<string>, b: array<string>, diverge_at: int>>, differing_codepoints long, copy_a {_copy_sql}, copy_b {_copy_sql}"


def _compare(a: pa.Array, b: pa.Array) -> pa.Array:
    """Of a batch, only a thousand pairs are held as Python's strings."""
    parts = (zip(a.slice(at, 1000).to_pylist(), b.slice(at, 1000).to_pylist(), strict=True) for at in range(0, len(a), 1000))
    done = [pa.array([document.compare(x, y) for x, y in part], _compared) for part in parts]
    return pa.concat_arrays(done) if done else pa.array([], _compared)


def compare(pairs: DataFrame, a: str = "text_a", b: str = "text_b") -> DataFrame:
    """Every pair of copies with their relation: empty, identical, edited or marked, and where hidden runs differ. Texts go to Python and stay there; what is returned of a pair beside its comparison stays in the JVM."""

    @F.arrow_udf(COMPARISON)
    def column(a: pa.Array, b: pa.Array) -> pa.Array:
        return _compare(a, b)

    read = pairs.withColumn("_veilscan_read", column(F.col(a), F.col(b)))
    return read.select(*pairs.columns, "_veilscan_read.*")


_intents = [(label, intent_pattern(p, "re2")) for label, p in INTENTS]


def _intent_labels(texts: pa.Array) -> pa.Array:
    has = lambda pattern: pc.fill_null(pc.match_substring_regex(texts, pattern), False).to_numpy(zero_copy_only=False)
    found = np.stack([has(p) for _, p in _intents], axis=1)
    # the only two characters beyond ASCII that Arrow takes for letters of ASCII in the other case; these texts are read anew
    for i in np.nonzero(has("[\u017f\u212a]"))[0]:
        said = {label for label, _ in intents_of(texts[int(i)].as_py())}
        found[i] = [label in said for label, _ in _intents]
    ends = np.concatenate(([0], np.cumsum(found.sum(axis=1)))).astype(np.int32)
    return pa.ListArray.from_arrays(ends, pa.array([label for label, _ in _intents]).take(pa.array(np.nonzero(found)[1])))


def intents(text: str = "text") -> Column:
    """As ``native.intents``, for whole texts: Arrow's patterns take one step a character, those of the JVM try each word of a pattern from every place."""

    @F.arrow_udf("array<string>")
    def column(texts: pa.Array) -> pa.Array:
        return _intent_labels(texts)

    return column(F.col(text))


def rollup(df: DataFrame, *by: str, text: str = "text") -> DataFrame:
    """Texts by verdict, with subtotals over ``by``."""
    read = scan_keys(df, *by, text=text)
    return read.rollup(*by).agg(F.count("*").alias("n_docs"), F.count_if(F.col("severity") >= 0).alias("n_flagged"), F.max("severity").alias("worst"), F.sum("hidden").alias("hidden"))
