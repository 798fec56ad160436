import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilscan.llm import source_mix as M


def brute_targets(sizes, weights):
    left, out = 1.5 * sum(sizes), [0.0] * len(sizes)
    while left > 1e-6:  # pour what is left by weight, again and again
        free = [i for i in range(len(sizes)) if out[i] < 2 * sizes[i] - 1e-9]
        weight = sum(weights[i] for i in free)
        poured = {i: min(left * weights[i] / weight, 2 * sizes[i] - out[i]) for i in free}
        for i, x in poured.items():
            out[i] += x
        left -= sum(poured.values())
    return out


def test_targets():
    rng = np.random.default_rng(1)
    for _ in range(100):
        sizes = rng.integers(0, 500, rng.integers(1, 9)).tolist()
        weights = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
        assert np.allclose(M.targets(sizes, weights), brute_targets(sizes, weights), atol=1e-4)
    assert M.targets([], []) == [] and M.targets([0, 0], [5, 2]) == [0, 0]


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 65, 1000, 4097])
def test_permutations(n):
    for key in (0, 5, 10**15):
        p = M.permuted(np.arange(n), n, key)
        assert sorted(p) == list(range(n))
        assert (M.permuted(p, n, key, back=True) == np.arange(n)).all()
    if n > 60:
        assert (M.permuted(np.arange(n), n, 1) != M.permuted(np.arange(n), n, 2)).any()


def rows(spark):
    rng = np.random.default_rng(7)
    out = [(i, " ".join(f"w{j}" for j in range(rng.integers(0, 60))), ["a", "b", "é", None, "z"][min(4, rng.integers(0, 9))], "x") for i in range(400)]
    out += [(900, None, "a", "x"), (901, "one", "lonely", "x"), (902, "", "void", "x"), (903, "word " * 3000, "b", "x"), (5, "again 1 2", "a", "x"), (5, "again 1 2", "a", "x"), (None, "no id", None, "x")]
    return spark.createDataFrame(out, "doc_id long, text string, source string, start string"), out


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_each_source_gives_its_target(spark):
    df, data = rows(spark)
    got = M.digest(df, block=16, slots=64).collect()
    assert sorted((r.doc_id or -1, r["size"]) for r in got) == sorted((d[0] or -1, size(d[1])) for d in data)
    names = sorted({d[2] for d in data}, key=lambda s: (s is None, s or ""))
    sizes = [sum(size(d[1]) for d in data if d[2] == s) for s in names]
    want = M.targets(sizes, [(5, 2, 1)[i % 3] for i in range(len(sizes))])
    by = {(s, t): [] for s, t in zip(sizes, want)}
    for r in got:
        assert 0 <= r.taken <= 2 * r["size"]
        by[r.source_size, r.target].append(r.taken)
    for (_, target), taken in by.items():
        assert sum(taken) == round(target)
    again = M.digest(df.repartition(7), block=16, slots=64).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_shards_mix_all_sources(spark):
    df, _ = rows(spark)
    met = M.mixed_pieces(df, block=16, slots=64).filter("words > 0")
    shards = met.groupBy("shard", "source").agg(F.countDistinct("pass", "block").alias("n")).collect()
    per = {}
    for r in shards:
        per.setdefault(r.shard, []).append(r.n)
    assert len(per) > 5 and all(sum(v) == 64 for s, v in per.items() if s < max(per))
    assert met.groupBy("source", "pass", "block").agg(F.countDistinct("shard").alias("n")).filter("n > 1").count() == 0


def words_by(rows_, *names):
    out = {}
    for r in rows_:
        key = tuple(r[n] for n in names)
        out[key] = out.get(key, 0) + (size(r["text"]) if "text" in r else r["taken"])
    return {k: v for k, v in out.items() if v}


def test_documents_of_the_mix(spark):
    df, data = rows(spark)
    for some in (df, df.filter("doc_id is not null")):
        out = M.mixed_documents(some, block=16)
        assert out.columns == df.columns
        taken = words_by((r.asDict() for r in M.digest(some, block=16).collect()), "doc_id")
        assert words_by((r.asDict() for r in out.collect()), "doc_id") == taken and len(taken) > 10
    assert M.cut_text(" a b  c\nd e", [(3, 1), (0, 2)]) == "a b\nd" and M.cut_text(" a b ", [(1, 1), (0, 1)]) == " a b "


def test_repeated_rows_give_what_the_digest_says(spark):
    text = " ".join(f"w{i}" for i in range(400))
    equal = spark.createDataFrame([(7, text, "a", 1)] * 3 + [(8, " ".join(f"v{i}" for i in range(50)), "a", 1)], "doc_id long, text string, source string, row int")
    for block in (16, 128):
        got = M.mixed_documents(equal, block=block).collect()
        digest = M.digest(equal, block=block).collect()
        assert sum(size(r.text) for r in got if r.doc_id == 7) == sum(r.taken for r in digest if r.doc_id == 7) <= 2 * 1200
        assert all(size(r.text) <= 400 for r in got)
    # one id and text in two sources, and rows that differ elsewhere
    two = spark.createDataFrame([(7, text, "a", 1), (7, text, "b", 2), (7, text, "b", 3), (9, text + " x", None, 4)], "doc_id long, text string, source string, row int")
    by = {(r.source, r.row): 0 for r in two.collect()}
    for r in M.mixed_documents(two).collect():
        by[r.source, r.row] += size(r.text)
    taken = sorted(r.taken for r in M.digest(two).collect())
    assert sorted(by.values()) == taken and all(v <= 2 * 401 for v in taken)


def test_clashing_and_odd_columns(spark):
    df, _ = rows(spark)
    odd = df.withColumns({c: F.lit(n) for n, c in enumerate(("_parts", "pass", "_key", "_h", "_id", "h", "key", "nth", "row", "parts", "name", "start", "shard"))}).withColumn("m", F.create_map(F.lit("a"), F.lit(1)))
    out = M.mixed_documents(odd, block=16)
    assert out.columns == odd.columns
    assert words_by((r.asDict() for r in out.collect()), "doc_id") == words_by((r.asDict() for r in M.digest(odd, block=16).collect()), "doc_id")
    assert {(r.h, r.nth, r.m["a"]) for r in out.collect()} == {(5, 7, 1)}


def test_shard_counts_add_up_whoever_asks():
    owed = np.array([1000, 0, 37, 5], np.int64)
    whole = list(M.shard_counts(owed, 64, 1, 0, 17))
    assert [s for s, _, _ in whole] == list(range(17)) and sum(c for _, _, c in whole).tolist() == owed.tolist()
    at = np.zeros(4, np.int64)
    for shard, first, count in whole:
        assert first.tolist() == at.tolist() and count.sum() == min(64, 1042 - 64 * shard)
        [(again, first_, count_)] = M.shard_counts(owed, 64, 1, shard, shard + 1)
        assert (again, first_.tolist(), count_.tolist()) == (shard, first.tolist(), count.tolist())
        at = at + count
    assert list(M.shard_counts(np.zeros(3, np.int64), 64, 1, 0, 5)) == []
    # a hundred billion slots: the tasks of one shard draw few numbers
    big = list(M.shard_counts(np.array([6 * 10**10, 4 * 10**10], np.int64), 1 << 16, 1, 777, 778))
    assert len(big) == 1 and big[0][2].sum() == 1 << 16 and abs(big[0][2][0] / (1 << 16) - 0.6) < 0.05


def test_too_many_sources_are_refused(spark, monkeypatch):
    df, _ = rows(spark)
    monkeypatch.setattr(M, "SOURCES", 1)
    with pytest.raises(ValueError):
        M.digest(df)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert M.digest(df).count() == 0


def test_whole_table(spark):
    got = M.query(spark, "/root/testdata/sf0.001").collect()
    by = {}
    for r in got:
        assert r.taken <= 2 * r["size"]
        by.setdefault((r.source_size, r.target), []).append(r.taken)
    assert all(sum(v) == round(t) for (_, t), v in by.items())
    source = {r.doc_id: r.source for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "source").collect()}
    targets = {source[r.doc_id]: r.target for r in got}
    assert len({(source[r.doc_id], r.target) for r in got}) == len(targets)
    assert abs(sum(targets.values()) - 1.5 * sum(r["size"] for r in got)) < 1e-3
