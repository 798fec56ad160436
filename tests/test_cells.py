"""The windows over characters of note, against the row-by-row reading of the same texts."""

import random
import time

import pytest

from veilscan.functions import codec, document
from veilscan.functions.dims import BIDI, PUA, POINTS
from veilscan.operators import cells

PARTS = [
    "a", "Zx ", "\u200b", "\u200c", "\u200d", "\u2060", "\ufeff", "\ufe0f", "\ufe0e", "\U000e0101", "\u2705", "\U0001f468", "\U0001f469", "\U0001f1f0", "5", "#", "\u0645", "\u06cc", "\u0915", "\u094d", "\u0301", "\u0302", "e", "\u202e", "\u2066", "\u00ad", "\x07", "\x00", "\ue001", "\ufdd0",
    "\U000f1234", "\u2028", "\u3000", "\u0435", "\uff52", "\ufb03", "\u4e00", "\u0416", "\n", "\U000e0041", "\u206a", "\ufffc", "\u034f", "\U0001d400",
]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    out = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 30))) for _ in range(400)]
    out += [None, "", " ", "plain", "\ufeffa\ufeff", "\u200d", "\U0001f468\u200b\u200d\u200b\U0001f469", "\u0645\u200b\u200c\u200bx", "a\u200b" * 40 + "b", "x" * 50 + "\u200b" + "y" * 3 + "\u200c\u200c z\u200b"]
    out += ["e" + "\u0301" * 5 + "a" + "\u0302" * 5, "e\u0301\u200b\u0301\u200b", "\u0301" * 14 + "\u200b", "e" + "\u0301" * 4 + "\u200b" * 100_000 + "\u0301" * 9, "word " * 30_000 + "\u200b"]
    for said in ("recipient=07", "caf\u00e9 \u2603", "ab", "abc"):
        out += [codec.encode_zero_width(said), "x" + codec.encode_zero_width(said, 0x200C, 0x200B) + "y", "\u2705" + codec.encode_variation_selectors(said)]
        out.append("".join(chr((0x200B, 0x200D, 0x200C, 0x2060)[b >> shift & 3]) for b in said.encode() for shift in (0, 2, 4, 6)))
    return out + ["".join(rng.choice("\u200b\u200c") for _ in range(rng.randint(1, 70))) for _ in range(60)] + ["".join(rng.choice("\u200b\u200c\u2060\ufeff") for _ in range(rng.randint(1, 40))) for _ in range(60)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, offset int, gap string").repartition(3).cache()


def test_cells(docs, texts):
    got = {}
    for r in cells.cells(docs).collect():
        got.setdefault(r.doc_id, []).append(tuple(r)[1:])
    for key, text in enumerate(texts):
        read = document.Reading(text)
        want = [(m.at, read.unit(m.at), m.cp, chr(m.cp), m.point.kind, m.point.abbr, m.point.severity, m.hidden, m.benign, None, None, None) for m in read.marks]
        want += [(i, read.unit(i), ord(read.text[i]), read.text[i], None, None, None, False, False, *c) for i, c in read.lookalikes]
        assert sorted(got.get(key, []), key=repr) == sorted(want, key=repr), ascii(text)[:300]


def test_marks(docs, texts):
    got = {}
    for r in cells.marks(docs).collect():
        got.setdefault(r.doc_id, []).append((r.at, r.context, r.cps, r.abbrs))
    for key, text in enumerate(texts):
        want = [(r["at"], r["context"], r["cps"], r["abbrs"]) for r in document.Reading(text).hidden_runs()]
        assert sorted(got.get(key, [])) == want, ascii(text)[:300]


def test_views(docs, texts):
    got = {r.doc_id: (r.visible_text, r.human_text) for r in cells.views(docs).collect()}
    assert got == {key: ((read := document.Reading(t)).visible_text, read.human_text) for key, t in enumerate(texts)}


def test_stacks(docs, texts):
    got = {r.doc_id: (r.severity, r.depth, r.offset) for r in cells.stack_findings(docs).collect()}
    want = {key: (f.severity, f.count, f.positions[0]) for key, t in enumerate(texts) for f in document.Reading(t).findings if f.id == "combining-stack"}
    assert got == want
    assert len(want) == 3


def test_payloads(docs, texts):
    got = {(r.doc_id, r.id): (r.decoded, r.scheme) for r in cells.payloads(docs).collect()}
    want = {(key, f.id): (f.decoded, f.scheme) for key, t in enumerate(texts) for f in document.Reading(t).findings if f.id in ("zero-width", "variation-selectors") and f.decoded}
    assert got == want
    assert {s for _, s in want.values()} >= {None, "binary, MSB-first", "binary, MSB-first, inverted", "base-4, LSB-first"}


def test_rows_that_repeat_a_key_are_texts_of_their_own(spark):
    df = spark.createDataFrame([(1, "a\u200b"), (1, "a\u200b"), (None, "\u200bb")], "doc_id long, text string")
    assert sorted(cells.cells(df).select("doc_id", "i").collect(), key=str) == [(1, 1), (1, 1), (None, 0)]
    assert sorted(cells.marks(df).select("doc_id", "at").collect(), key=str) == [(1, 1), (1, 1), (None, 0)]
    assert sorted((r.doc_id or 0, r.visible_text) for r in cells.views(df).collect()) == [(0, "b"), (1, "a"), (1, "a")]


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    for read in (cells.cells, cells.marks, cells.views, cells.stacks, cells.payloads):
        assert read(none).collect() == []


def test_table_of_characters():
    """A row for each named character and twin, none twice, private use by rule."""
    rows = cells.point_rows()
    assert len({r[0] for r in rows}) == len(rows)
    assert {cp for cp, kind, *_ in rows if kind} >= set(POINTS)
    assert PUA not in {r[1] for r in rows}
    assert BIDI in {r[1] for r in rows}


def test_no_python_worker(docs):
    for read in (cells.cells, cells.marks, cells.views, cells.stacks, cells.payloads):
        plan = read(docs)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan
        assert "Arrow" not in plan


def test_a_long_text_of_marks_takes_no_longer_than_many_short_ones(spark):
    df = spark.createDataFrame([(1, "a\u200b" * 200_000 + "z" * 500_000)], "doc_id long, text string")
    cells.marks(df.limit(0)).collect()
    began = time.perf_counter()
    assert cells.marks(df).count() == 200_000
    assert time.perf_counter() - began < 30


def test_quick_passes_find_what_the_patterns_say(spark):
    from pyspark.sql import functions as F

    from veilscan.functions import native
    from veilscan.functions.dims import HIDDEN_KINDS, class_of

    rng, parts = random.Random(6), ["a", "B ", "ü", "ß", "ƿ", "ǀ", "​", "­", "е", "\r\n", "\x07", "\U000e0041", "\U0001f600", "$1", "\\", ""]
    rows = [("".join(rng.choice(parts) for _ in range(rng.randint(0, 9))),) for _ in range(1500)] + [(None,)]
    t, hidden = F.col("text"), class_of(*HIDDEN_KINDS)
    quick = [native.without(t, hidden), native.holds(t, f"[{hidden}]"), native.n_plain_letters(t), native.beyond_ascii(t)]
    slow = [F.regexp_replace(t, f"[{hidden}]", ""), t.rlike(f"[{hidden}]"), F.regexp_count(t, F.lit("[A-Za-z]")), F.regexp_replace(t, "[^\\x{80}-\\x{10FFFF}]", "")]
    for r in spark.createDataFrame(rows, "text string").select(F.array(*[c.cast("string") for c in quick]).alias("q"), F.array(*[c.cast("string") for c in slow]).alias("s")).collect():
        assert r.q == r.s
