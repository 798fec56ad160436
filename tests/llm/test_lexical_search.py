import math
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from veilscan.llm import lexical_search as S

_term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def _terms(text):
    return _term.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, queries, most=50):
    read = [(key, Counter(_terms(text))) for key, text in docs]
    read = [(key, tf) for key, tf in read if tf]
    n_docs, n_terms = len(read), sum(sum(tf.values()) for _, tf in read)
    df = Counter(t for _, tf in read for t in tf)
    out = []
    for item, text in queries:
        found = []
        for key, tf in read:
            m = 50 + 50 * sum(tf.values()) * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * tf[t] // (1000 * tf[t] + 20 * m)) for t in set(_terms(text)) if t in tf)
            if score > 0:
                found.append((-score, key is None, key or 0))
        out += [(item, i, None if null else key, -score) for i, (score, null, key) in enumerate(sorted(found)[:most], 1)]
    return sorted(out, key=repr)


def _of(df):
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def tables():
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(60)] + ["\u00c9", "\u00e9", "\u65e5\u672c", "Ab", "aB"]
    share = 1 / np.arange(1, len(words) + 1)
    text = lambda n: " ".join(rng.choice(words, n, p=share / share.sum()))
    docs = [(int(i) * 7 % 1000, text(rng.integers(0, 60))) for i in range(400)]
    docs += [(None, text(20)), (None, text(20)), (5, "tie tie"), (4, "tie tie"), (4, "tie tie"), (2000, None), (2001, ""), (2002, "?!"), (2003, "long w3 " * 20_000), (2004, "x" * 50_000)]
    docs += [(3000 + i, "hot passage of a copied text w1") for i in range(150)]
    queries = [(i, text(8)) for i in range(12)] + [(50, "TIE"), (51, None), (52, "nowhere"), (53, "hot passage w1 w2"), (53, "w5 tie"), (None, "w7"), (54, " ".join(words))]
    return docs, queries


def test_ranks_equal_brute_force(spark, tables):
    docs, queries = tables
    frame = spark.createDataFrame([(k, t, 1, 2) for k, t in docs], "doc_id long, text string, rank int, item_id int").repartition(3)
    asked = spark.createDataFrame([(k, t, 1) for k, t in queries], "item_id long, text string, doc_id int")
    assert _of(S.search(frame, asked)) == brute(docs, queries)
    assert _of(S.search(frame, asked, most=3)) == brute(docs, queries, 3)


def test_small_shards_and_blocks_change_nothing(spark, tables):
    docs, queries = tables
    frame, asked = spark.createDataFrame(docs, "doc_id long, text string").repartition(2), spark.createDataFrame(queries, "item_id long, text string")
    assert _of(S.search(frame, asked, limits=S.Limits(docs=40, postings=100, terms=30))) == brute(docs, queries)


def test_blocks_are_cut_at_least_cost():
    rng = np.random.default_rng(1)
    for case in range(30):
        sizes = rng.integers(1, 900 if case < 2 else 60, rng.integers(1, 6))
        starts, scores = np.cumsum(sizes) - sizes, rng.integers(1, 1000, sizes.sum())
        cut = S.cut(scores, starts, sizes, 8, 4.0)
        for low, n in zip(starts, sizes, strict=True):
            s, ends = scores[low : low + n], [*(x - low for x in cut if low <= x < low + n), n]
            penalty = 4.0 * s.sum() / n
            least = [0.0]
            for i in range(1, n + 1):
                least.append(min(least[i - b] + b * s[i - b : i].max() + penalty for b in range(1, min(i, 8) + 1)))
            assert ends[0] == 0
            assert max(np.diff(ends)) <= 8
            assert abs(sum((b - a) * s[a:b].max() + penalty for a, b in zip(ends, ends[1:], strict=False)) - least[n]) < 1e-6


def _shard(rng, n, terms=6):
    lists = [np.sort(rng.choice(n, rng.integers(n // 4, n), replace=False)) for _ in range(terms)]
    tf = [np.where(rng.random(len(x)) < 0.02, 2, 1) for x in lists]
    row = {"doc_ids": np.arange(n), "lengths": np.where(np.arange(n) // 500 == 3, 5, rng.integers(200, 400, n)).astype("<i8").tobytes(), "terms": np.arange(terms, dtype=np.int32), "counts": np.array([len(x) for x in lists], np.int32), "docs": np.concatenate(lists).astype("<u4").tobytes(), "tfs": np.concatenate(tf).astype("<u4").tobytes()}
    return S.Shard(row, n, 200 * n, np.arange(100, 100 + terms * 500, 500))


def test_search_skips_blocks_and_loses_nothing():
    shard = _shard(np.random.default_rng(4), 5000)
    exact = np.zeros(5000, np.int64)
    np.add.at(exact, shard.doc, shard.score)
    ranked = np.lexsort((np.arange(5000), -exact))[:50]
    threshold = int(exact[ranked[-1]])
    read = []
    ranges, S._ranges = S._ranges, lambda low, high: read.append(int((high - low).sum())) or ranges(low, high)
    try:
        found, scores = shard.best(np.arange(6), threshold, 50)
    finally:
        S._ranges = ranges
    assert set(ranked) <= set(found.tolist())
    assert (exact[found] == scores).all()
    assert sum(read[1:]) < len(shard.doc) / 2  # postings of the blocks that were read


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert S.search(none, asked).collect() == []
    assert S.search(spark.createDataFrame([(1, "a")], "doc_id long, text string"), asked.limit(0)).collect() == []
    assert S.search(spark.createDataFrame([(1, "?"), (2, None)], "doc_id long, text string"), asked).collect() == []


def test_whole_table_equals_sql(spark):
    sf_dir = "/root/testdata/sf0.001"
    for name in ("documents", "benchmark"):
        duckdb.sql(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    assert _of(S.query(spark, sf_dir)) == sorted(duckdb.sql(f"SELECT item_id, rank, doc_id, score FROM ({S.SQL})").fetchall(), key=repr)
