import hashlib
import random

import numpy as np
import pytest

from veilscan.llm import substring_dedup as S


def brute(rows):
    """rows: (id, text), all different; in the order of ids."""
    seen, out = set(), {}
    for key, text in sorted(rows):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - 99):
            s = raw[i : i + 100]
            if s in seen:
                gone[i : i + 100] = b"\1" * 100
            else:
                seen.add(s)
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        runs = sum(1 for i in range(len(gone)) if gone[i] and (i == 0 or not gone[i - 1]))
        out[key] = len(raw), sum(gone), runs, hashlib.sha256(kept).hexdigest()
    return out


def check(spark, rows):
    df = spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id long, text string, h int").repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.dedup(df).collect()}
    want = brute(rows)
    assert got == want, {k: (got.get(k), want[k]) for k in want if got.get(k) != want[k]}
    return want


def test_planted_repeats(spark):
    rng = random.Random(11)
    text = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    common = [text(rng.choice([98, 99, 100, 101, 130, 300, 1000])) for _ in range(8)]
    rows = [(i, "".join(rng.choice(common + [text(rng.randint(0, 80))] * 4) for _ in range(rng.randint(0, 6)))) for i in range(150)]
    rows += [(200, None), (201, ""), (202, "x" * 99), (203, "x" * 100), (204, "x" * 101), (205, "ab" * 3000), (206, "ab" * 70), (207, "é" * 500), (208, common[5] + "é" + common[5]), (209, common[6][1:]), (210, common[6][:-1] + "q")]
    want = check(spark, rows)
    assert sum(v[1] for v in want.values()) > 20_000


def test_long_texts_are_cut_without_loss(spark, monkeypatch):
    monkeypatch.setattr(S, "PIECE", 1500)  # for the worker-free parts below
    rng = random.Random(4)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(5000))
    parts = list(S._parts(iter([S.pa.RecordBatch.from_pydict({"doc_id": [1, 2], "h": [0, 0], "text": [passage, "y" * 40]})])))
    starts = sorted(s[2] + i for _, segs in parts for s in segs for i in range(s[3] - 99))
    assert starts == list(range(len(passage) - 99))


def test_buckets_are_equality():
    rng = np.random.default_rng(2)
    buf = rng.integers(97, 99, 4000).astype(np.uint8)
    buf[2000:2400] = buf[100:500]
    starts = np.arange(len(buf) - 99)
    got = S.string_buckets(buf, starts)
    raw = buf.tobytes()
    by = {}
    for i in starts:
        by.setdefault(raw[i : i + 100], []).append(i)
    for places in by.values():
        assert (got[places] == -1).all() if len(places) == 1 else len(set(got[places])) == 1 and got[places[0]] >= 0
    assert len(set(got[got >= 0])) == sum(len(p) > 1 for p in by.values())


def test_repeated_rows_and_nulls(spark):
    t = "".join(random.Random(1).choices("abcdefgh", k=260))
    rows = spark.createDataFrame([(None, t), (5, t), (5, t), (5, t + "!"), (7, None), (7, None)], "doc_id long, text string")
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.n_bytes, r.n_removed) for r in S.dedup(rows).collect())
    assert got == [(False, 0, 260, 0), (True, 5, 260, 260), (True, 5, 260, 260), (True, 5, 261, 260), (True, 7, 0, 0), (True, 7, 0, 0)]
    assert S.dedup(rows.filter("false")).count() == 0


def test_whole_table_matches_brute_force(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.query(spark, d).collect()}
    assert got == brute(rows)


def test_groups_without_a_repeated_string(spark):
    """Passages of 90 bytes share a gram and its sides, but no string of 100."""
    rng = random.Random(8)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    shared = [text(90) for _ in range(12)]
    rows = [(i, text(80) + shared[i % 12] + text(80)) for i in range(24)]
    want = check(spark, rows)
    assert all(v[1] == 0 for v in want.values())


def adversarial(rng):
    """One gram with many surroundings, and one string of 66 bytes that goes on in many ways."""
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    gram, long = text(40), text(90)
    rows = [(i, text(rng.randint(0, 90)) + gram + text(rng.randint(0, 90))) for i in range(60)]
    ways = [text(30) for _ in range(5)]
    rows += [(100 + i, text(60) + long + rng.choice(ways) + text(rng.randint(0, 60))) for i in range(80)]
    return rows + [(300 + i, text(20) + rows[rng.randrange(len(rows))][1] + text(20)) for i in range(40)]


@pytest.mark.parametrize("limits", [{}, {"SPREAD": 1}, {"SPREAD": 2, "GROUP": 1}, {"SETTLED": 2000, "SPREAD": 3, "GROUP": 4000}])
def test_frequent_grams_and_large_groups(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(S, name, value)
    want = check(spark, adversarial(random.Random(5)))
    assert sum(v[1] for v in want.values()) > 5000
