"""Sweeps over spans against plain loops, and over texts against the row-by-row reading."""

import random
import time

import pytest

from veilscan.functions import document
from veilscan.operators import spans


def _intervals(rng, n):
    return [(a := rng.randint(0, 60), a + rng.randint(1, 12)) for _ in range(n)]


def test_outside(spark):
    rng, rows, want = random.Random(2), [], []
    for text in range(60):
        items, held = _intervals(rng, rng.randint(0, 12)), _intervals(rng, rng.randint(0, 6))
        rows += [(text, False, a, b, i) for i, (a, b) in enumerate(items)] + [(text, True, a, b, None) for a, b in held]
        want += [(text, i) for i, (a, b) in enumerate(items) if not any(a < d and c < b for c, d in held)]
    df = spark.createDataFrame(rows, "text long, is_span boolean, start int, end int, nr int").repartition(3)
    assert sorted((r.text, r.nr) for r in spans.outside(df, "is_span", "text").collect()) == sorted(want)


def test_outermost(spark):
    rng, rows, want = random.Random(4), [], []
    for text in range(60):
        some = _intervals(rng, rng.randint(0, 12))
        rows += [(text, a, b) for a, b in some]
        reach = -1
        for a, b in sorted(some, key=lambda x: (x[0], -x[1])):
            if a >= reach:
                want.append((text, a, b))
            reach = max(reach, b)
    assert sorted(tuple(r) for r in spans.outermost(spark.createDataFrame(rows, "text long, start int, end int"), "text").collect()) == sorted(want)


HOSTS = ["\u0430.", "bc.org", "p\u0430yp\u0430l.com", "-", "_", "@", ".", "x", "1.", "xn--a.com", "\u044e.com", "\u04c0.com", "\u0663\u0430.com", "\u0430-b.c\u043e", " ", "/", "\u0430pple", "\u00b5s", "5\u03bcs", "\u03bcm", "\u0418x"]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(8)
    return ["".join(rng.choice(HOSTS) for _ in range(rng.randint(1, 9))) for _ in range(1500)] + [None, "", "\u0430" * 30_000, "\u0430." * 30_000, "b\u0430 " * 20_000, "\U0001f600 \u0430pple p\u0430yp\u0430l.com \u0251b \u0430b"]


def test_mixed_words(spark, texts):
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, start int").repartition(3)
    got = {}
    for r in spans.mixed_words(df).collect():
        got.setdefault(r.doc_id, []).append(r.offset)
    for key, text in enumerate(texts):
        want = [f.positions for f in document.Reading(text).findings if f.id == "mixed-script"]
        assert sorted(got.get(key, [])) == (want[0] if want else []), ascii(text)[:200]


def test_host_of_a_run(spark):
    rng = random.Random(6)
    runs = ["".join(rng.choice(["a", "b1", "-", ".", "_", "@", "cd", "\u0436", "."]) for _ in range(rng.randint(1, 9))) for _ in range(800)]
    got = spark.createDataFrame([(r,) for r in runs], "run string")
    got = spans.with_host(got, "run").collect()
    for r in got:
        found = list(document.hosts(r.run))
        assert r.host == (r.run[found[0][0] : found[0][1]] if found and found[0][0] == 0 else ""), r.run


def test_hundred_thousand_hosts_in_a_text(spark):
    text = "p\u0430yp\u0430l.com \u0430pple " * 100_000
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.perf_counter()
    assert spans.mixed_words(df).count() == 100_000
    assert time.perf_counter() - began < 30


def test_spectrum_and_folds(spark):
    text = "\ufeffab" + "\u200b" * 70 + "\u200b\u200c" + "\U000e0041" * 3 + "\u0435" + "\u00a0" * 64 + "\u2028" * 70 + "x" * 100
    df = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "plain")], "doc_id long, text string")
    assert sorted((r.i, r.kind, r.benign, r.n, r.shown, r.folded) for r in spans.folded(df).collect()) == [(0, "zero-width", True, 1, 1, 0), (3, "zero-width", False, 72, 48, 24), (75, "tags", False, 3, 3, 0), (79, "space", False, 64, 48, 16), (143, "line-break", False, 70, 70, 0)]
    read, best = document.Reading(text), {}
    loud = [(m.at, m.cp, spans.EXCUSED if m.benign else spans.LOUDNESS[m.point.kind]) for m in read.marks] + [(i, ord(text[i]), spans.DRAWN_ALIKE) for i, _ in read.lookalikes]
    for columns in (1, 7, 64, 1000):
        best = {}
        for i, cp, priority in sorted(loud):
            bucket = min(columns - 1, int(i / (len(text) / columns)))
            if bucket not in best or priority > best[bucket][2]:
                best[bucket] = (i, cp, priority)
        assert {r.bucket: (r.i, r.cp, r.priority) for r in spans.spectrum(df, columns).collect()} == best


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    for read in (spans.mixed_words, spans.spectrum, spans.folded):
        assert read(none).collect() == []
        assert "Python" not in read(none)._jdf.queryExecution().executedPlan().toString()
