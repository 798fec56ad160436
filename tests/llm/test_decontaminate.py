import random
import time

import duckdb  # noqa: F401
import pytest

from veilscan.llm import decontaminate as D


def slow_tiles(item, text, least):
    """The longest match is marked, again and again: of equal ones the first in the item, then in the text."""
    a, b, out = list(item), list(text), []
    while True:
        best = (0, 0, 0)
        for p in range(len(a)):
            for t in range(len(b)):
                k = 0
                while p + k < len(a) and t + k < len(b) and a[p + k] == b[t + k] is not None:
                    k += 1
                best = max(best, (k, -p, -t))
        k, p, t = best[0], -best[1], -best[2]
        if k < least:
            return out
        out.append((p, t, k))
        a[p : p + k] = [None] * k
        b[t : t + k] = [-1] * k


@pytest.mark.parametrize("seed", range(60))
def test_tiles_are_a_greedy_string_tiling(seed):
    rng = random.Random(seed)
    letters = rng.choice([1, 2, 3, 30])
    a = [rng.randrange(letters) for _ in range(rng.randint(0, 40))]
    b = [rng.randrange(letters) for _ in range(rng.randint(0, 60))]
    if a and rng.random() < 0.7:
        at = rng.randrange(len(a))
        b[rng.randint(0, len(b)) :] = a[at:] + a[:at]
    least = rng.choice([1, 3, 5])
    assert D.tiles(a, b, least) == slow_tiles(a, b, least)


def test_repeated_words_take_no_longer():
    began = time.perf_counter()
    assert D.tiles([7] * 300, [7] * 100_000) == [(0, 0, 300)]
    assert D.tiles([7] * 300, ([7] * 99 + [8]) * 1000) == [(0, 0, 99), (99, 100, 99), (198, 200, 99)]
    junk = [[7] * 9 + [100 + i] for i in range(30)]
    assert len(D.tiles(sum(junk, []), [7] * 50_000 + [9] * 50_000)) == 30
    assert time.perf_counter() - began < 10


def test_passages_are_caught_in_any_order_and_clean_texts_left(spark):
    rng = random.Random(1)
    some = lambda n: [f"{rng.choice('abcdefgh')}{rng.randrange(500)}" for _ in range(n)]
    items = [some(rng.randint(15, 60)) for _ in range(30)] + [some(3), []]
    docs, want = [], set()
    for i in range(120):
        words = some(rng.randint(0, 200))
        if i % 3 == 0:
            j = rng.randrange(30)
            item = items[j]
            how = rng.randrange(4)
            if how == 1:
                item = item[len(item) // 2 :] + some(3) + item[: len(item) // 2]
            elif how == 2:
                item = [w.upper() + "," for w in item]
            elif how == 3:
                item = item[: len(item) // 3]
            if how != 3:
                want.add((i, j))
            at = rng.randint(0, len(words))
            words[at:at] = item
        docs.append((i, " ".join(words), f"x{i}"))
    docs += [(500, " ".join(items[30]), None), (501, None, None), (502, "", None), (503, "?! ...", None), (504, "w " * 100_000 + " ".join(items[0]), None), (None, " ".join(items[1]), None)]
    want |= {(500, 30), (504, 0), (None, 1)}
    df = spark.createDataFrame(docs, "doc_id long, text string, item_id string").repartition(3)
    bench = spark.createDataFrame([(j, " ".join(x)) for j, x in enumerate(items)] + [(99, None)], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in D.found(df, bench).collect()} == want
    kept = D.clean(df, bench)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted({d[0] for d in docs if d[0] is not None} - {d for d, _ in want})


def test_large_benchmarks_go_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK_SEEDS", 20)
    bench = spark.createDataFrame([(j, " ".join(f"i{j}w{k}" for k in range(9))) for j in range(7)], "item_id long, text string")
    docs = spark.createDataFrame([(j, "x y z " + " ".join(f"i{j}w{k}" for k in range(9))) for j in range(8)], "doc_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in D.found(docs, bench).collect()) == [(j, j) for j in range(7)]
    assert D.clean(docs, bench).count() == 1


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert D.found(docs, bench).count() == 0 and D.clean(docs, bench).count() == 1
    assert D.found(none, docs.withColumnRenamed("doc_id", "item_id")).count() == 0


def brute(rows, items, threshold=0.6):
    """Pairs whose longest-first tiling, done word by word, covers enough."""
    bare = lambda t: [w for w in (w.strip(D._punctuation) for w in (t or "").encode().lower().split()) if w]
    out = set()
    split = [(i, bare(t)) for i, t in items]
    seeds = [(i, w, {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))}) for i, w in split if w]
    for key, text in rows:
        words = bare(text)
        here = {tuple(words[j : j + 5]) for j in range(len(words) - 4)}
        for i, item, s in seeds:
            if not s & here:
                continue
            total = sum(k for _, _, k in slow_tiles(item, words, 5))
            if total >= threshold * len(item):
                out.add((key, i))
    return out


def test_whole_table_matches_brute_force(spark):
    d = "/root/testdata/sf0.001"
    read = lambda t: [tuple(r)[:2] for r in spark.read.parquet(f"{d}/{t}.parquet").collect()]
    want = brute(read("documents"), read("benchmark"))
    assert {(r.doc_id, r.item_id) for r in D.query(spark, d).collect()} == want and want
