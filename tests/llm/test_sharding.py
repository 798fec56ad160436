import hashlib

import duckdb

from veilscan.llm import sharding as S


def brute(rows, limit):
    bits = {i: f"{int(hashlib.md5(str(i).encode()).hexdigest()[:16], 16):064b}" for i, _ in rows}
    out, todo = {}, [("", [i for i, _ in rows])]
    size = {i: len((t or "").encode()) for i, t in rows}
    while todo:
        name, ids = todo.pop()
        total = sum(size[i] for i in ids)
        if total <= limit or len(ids) == 1:
            out |= {i: (size[i], name, len(name), total, len(ids), total <= limit) for i in ids}
        else:
            for bit in "01":
                if part := [i for i in ids if bits[i][len(name)] == bit]:
                    todo.append((name + bit, part))
    return out


def test_against_splitting_one_bucket_at_a_time(spark):
    rows = [(i, "é" * (i % 97)) for i in range(600)] + [(1000, "x" * 9000), (1001, None)]
    for limit in (10, 500, 4000, 1 << 20):
        got = {r.doc_id: tuple(r)[1:] for r in S.shard(spark.createDataFrame(rows, "doc_id long, text string"), limit).collect()}
        assert got == brute(rows, limit)


def test_repeated_rows_part(spark):
    rows = spark.createDataFrame([(5, "0123456789", 1)] * 200 + [(None, None, 2)] * 3, "doc_id long, text string, shard int")
    got = S.shard(rows, 100).collect()
    assert len(got) == 203 and all(r.fits for r in got)
    by = {}
    for r in got:
        by[r.shard] = by.get(r.shard, 0) + r.bytes
    assert all(by[r.shard] == r.shard_bytes for r in got)


def test_empty_table(spark):
    assert S.shard(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_whole_table_matches_sql(spark):
    d = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"create view documents as from '{d}/documents.parquet'")
    want = sorted(con.execute(S.SQL).fetchall())
    assert sorted(map(tuple, S.query(spark, d).collect())) == want and len({r[2] for r in want}) > 2
