import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from veilscan.llm import ngram_join as J
from veilscan.llm.components import components


def shingles(text, k=5):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def brute(rows):
    """rows: (id, text) -> a list of (id, size, component) in the same order."""
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    by = {}
    for i, s in enumerate(sets):
        if rows[i][0] is not None:
            for x in s:
                by.setdefault(x, []).append(i)
    near = {tuple(sorted((a, b))) for v in by.values() for n, a in enumerate(v) for b in v[:n]}
    for a, b in near:
        both = len(sets[a] & sets[b])
        if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            up[root(a)] = root(b)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[root(i)] = min(least.get(root(i), key), key)
    return [(key, len(sets[i]), None if key is None else least[root(i)]) for i, (key, _) in enumerate(rows)]


def check(spark, rows, parts=3):
    df = spark.createDataFrame([(a, b, "x") for a, b in rows], "doc_id long, text string, class string").repartition(parts)
    order = lambda x: [(v is not None, v) for v in x]
    got = sorted([(r.doc_id, r.n_shingles, r.component_id) for r in J.join(df).collect()], key=order)
    want = sorted(brute(rows), key=order)
    assert got == want, [(g, w) for g, w in zip(got, want) if g != w][:10]
    return want


def near_copies(rng, base, count, most):
    for _ in range(count):
        words = base[:]
        for _ in range(rng.randint(0, most)):
            at = rng.randrange(len(words))
            words[at : at + rng.randint(0, 2)] = [f"e{rng.randrange(10**6)}"]
        yield " ".join(words)


def test_links_of_planted_copies(spark):
    rng = random.Random(8)
    some = lambda n: [rng.choice("abcdefghij") + str(rng.randrange(60)) for _ in range(n)]
    texts = [None, "", " \t", "one", "one two", "One two", "a b c d e", "A b  c\nd e", "a b c d e f"]
    for n in (6, 9, 30, 60, 200):
        texts += near_copies(rng, some(n), 25, max(2, n // 20))
    line = " ".join(some(12))
    texts += [line + " " + " ".join(some(rng.randint(0, 40))) for _ in range(120)]
    rows = list(enumerate(texts)) + [(None, "one"), (3, "one"), (3, "another text of this id x y z"), (700, texts[40])]
    rng.shuffle(rows)
    want = check(spark, rows)
    assert len({w[2] for w in want}) < len(rows) - 40


def test_dense_lists_go_through_pivots(spark):
    rng = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    rows = list(enumerate(near_copies(rng, base, 220, 6)))
    rows += [(1000 + i, f"u{i} v{i} " + " ".join(base[:9])) for i in range(80)]
    check(spark, rows)


def test_divide_skip_is_counting():
    rng = np.random.default_rng(3)
    for _ in range(200):
        docs = {int(i): sorted(set(rng.integers(0, 40, rng.integers(1, 30)).tolist())) for i in rng.integers(0, 99, 12)}
        query = sorted(set(rng.integers(0, 40, 25).tolist()))
        need = {i: int(rng.integers(1, 14)) for i in docs}
        count = {i: len(set(query) & set(t)) for i, t in docs.items()}
        assert J.divide_skip(query, docs, need) == {i: c for i, c in count.items() if c >= need[i]}
    assert J.divide_skip([], {1: [2]}, {1: 1}) == {}


@pytest.mark.parametrize("shape", ["chain", "random", "none"])
def test_components(spark, shape):
    rng = random.Random(2)
    edges = {"chain": [(i, i + 1) for i in range(60)] + [(100, 90)], "random": [(rng.randrange(90), rng.randrange(90)) for _ in range(50)], "none": []}[shape]
    up = {v: v for e in edges for v in e}
    for _ in up:
        for a, b in edges:
            up[a] = up[b] = min(up[a], up[b])
    got = {r.v: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {v: m for v, m in up.items() if any(v in e and e[0] != e[1] for e in edges)}


@pytest.mark.parametrize("edges, writes", [([(1, i) for i in range(2, 40)] + [(50, 51)], 2), ([(1, 2), (2, 3)], 6)])
def test_rounds_end_when_the_stars_are_done(spark, monkeypatch, edges, writes):
    """Of graphs that are stars, and of one that is after a round, no round is run to see that nothing changes."""
    from veilscan.llm import components as C

    written, of = [], C.stored
    monkeypatch.setattr(C, "stored", lambda df: written.append(1) or of(df))
    got = {r.v: r.label for r in C.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {v: 50 if v >= 50 else min(map(min, edges)) for e in edges for v in e}
    assert len(written) == writes


def test_empty_table(spark):
    assert J.join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_whole_table_matches_brute_force(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    got = sorted(map(tuple, J.query(spark, d).collect()))
    assert got == sorted(brute(rows)) and any(r[0] != r[2] for r in got)


def test_whole_table_matches_sql(spark):
    d = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"create view documents as from '{d}/documents.parquet'")
    assert sorted(map(tuple, J.query(spark, d).collect())) == sorted(con.execute(J.SQL).fetchall())


@pytest.mark.parametrize("limits", [{"LONG": 3, "PART": 3}, {"PART": 2, "DENSE": 1, "POSTINGS": 5, "SEARCHED_TOKENS": 30, "SEARCHED": 2}])
def test_long_lists_small_parts_and_small_buckets_give_the_same(spark, monkeypatch, limits):
    """Limits that only large inputs reach, set so low that this one does."""
    for name, value in limits.items():
        monkeypatch.setattr(J, name, value)
    rng = random.Random(7)
    rows, shared = [], [f"s{i}" for i in range(30)]
    for group in range(4):
        base = [f"g{group}w{i}" for i in range(40)] + shared
        rows += [(len(rows) + i, t) for i, t in enumerate(near_copies(rng, base, 25, 3))]
    rows += [(len(rows) + i, " ".join(shared + [f"u{i}x{j}" for j in range(rng.randint(0, 9))])) for i in range(40)]
    rng.shuffle(rows)
    check(spark, rows)


def test_a_hub_and_a_hot_class(spark, monkeypatch):
    from veilscan.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 4)
    star = [(0, i) for i in range(1, 60)] + [(100 + i, 101 + i) for i in range(20)]
    got = {r.v: r.label for r in components(spark.createDataFrame(star, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(60)} | {i: 100 for i in range(100, 121)}
    check(spark, [(i, "one two three four five six") for i in range(50)] + [(60 + i, None) for i in range(20)] + [(None, "a b")] * 9)


def test_meet(spark, monkeypatch):
    from veilscan.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 3)
    rows = spark.createDataFrame([(k, i) for i, k in enumerate([1] * 9 + [2] * 9 + [3, 4, None, None])], "k int, i int")
    unique = spark.createDataFrame([(1, "a"), (3, "c"), (5, "e")], "k int, x string")
    for how in ("inner", "left"):
        assert sorted(map(str, common.meet(rows, unique, "k", how).collect())) == sorted(map(str, rows.join(unique, "k", how).collect()))
    whole = spark.createDataFrame([(1, "a", 9), (2, "b", 9), (3, "c", 1), (4, "d", 1)], "k int, x string, n int")
    assert sorted(map(str, common.meet(rows, whole, "k", counted="n").collect())) == sorted(map(str, rows.join(whole, "k").collect()))


def test_representatives_keep_columns_of_any_name_and_one_row_of_each_group(spark):
    a, b = "one two three four five six seven", "eight nine ten eleven twelve thirteen"
    rows = [(5, a, 1), (5, a, 2), (3, a.upper(), 3), (5, b, 4), (7, b + " ", 5), (8, None, 6), (8, "", 7), (None, a, 8), (9, "lone words", 9), (3, a, 10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _n int").withColumns({"_h": F.lit(1), "h": F.lit(2), "class": F.lit(3), "row": F.lit(4), "nth": F.lit(5), "_id": F.lit(6)})
    out = J.representatives(df)
    assert out.columns == df.columns
    got = sorted((r.doc_id, r.text) for r in out.filter("doc_id is not null and doc_id <> 8").collect())
    assert len(got) == 3 and got[1:] == [(5, b), (9, "lone words")] and got[0][0] == 3
    assert {r._n for r in out.collect()} >= {6, 7, 8} and {(r._h, r.h, r["class"], r.row, r.nth, r._id) for r in out.collect()} == {(1, 2, 3, 4, 5, 6)}
