import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from veilscan.llm import packing as P
from veilscan.llm.token_output import default_tokenizer

PATH = default_tokenizer()


def places(slots, counts):
    """Every piece of a histogram and where the plan puts it: (length, sequence, offset)."""
    out = []
    for length in np.flatnonzero(counts).tolist():
        rows = np.flatnonzero(slots.length == length)
        ends = [*slots.first[rows][1:].tolist(), int(counts[length])]
        for r, end in zip(rows.tolist(), ends, strict=True):
            for i in range(end - int(slots.first[r])):
                out.append((length, int(slots.sequence[r] + i // slots.copies[r]), int(slots.offset[r] + i % slots.copies[r] * length)))
    return out


def check(found, size):
    """No two pieces overlap, none is cut off, and each sequence has no gap; returns the number of sequences."""
    by = defaultdict(list)
    for length, sequence, offset in found:
        by[sequence].append((offset, length))
    for held in by.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= size
    return len(by)


def brute_best_fit(lengths, size):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= n]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - n)
        else:
            rooms.append(size - n)
    return len(rooms)


@pytest.mark.parametrize("seed", range(12))
def test_plans_place_every_piece_once(seed):
    rng = np.random.default_rng(seed)
    size = int(rng.integers(4, 90))
    counts = np.zeros(size + 1, np.int64)
    some = rng.integers(1, size + 1, rng.integers(1, size + 1))
    counts[some] = rng.integers(0, 200, len(some))
    found = places(P.plan(counts, size), counts)
    assert Counter(x[0] for x in found) == Counter({n: int(c) for n, c in enumerate(counts) if c})
    used, lengths = check(found, size), [x[0] for x in found]
    least = max(-(-sum(lengths) // size), sum(2 * n > size for n in lengths))
    assert least <= used <= brute_best_fit(lengths, size) * 1.08 + 1  # few lengths, which few patterns fill


def test_fit_is_the_least_squares_optimum():
    """At the optimum no used pattern has a gradient and no unused one a positive one."""
    counts = np.array([0, 40, 10, 30, 5, 25, 60, 8, 0], float)
    made, weights = P.patterns(np.flatnonzero(counts[:8]), 8), np.ones(9)
    assert sorted(map(tuple, made.tolist())) == [(3, 3, 2), (4, 2, 2), (4, 3, 1), (4, 4, 0), (5, 2, 1), (5, 3, 0), (6, 1, 1), (6, 2, 0), (7, 1, 0)]
    x = P.fit(made, counts, weights)
    a = np.array([[row.count(n) for row in made.tolist()] for n in range(9)], float)
    a[0] = 0
    gradient = a.T @ (counts - a @ x)
    assert (x >= 0).all()
    assert gradient.max() < 1
    assert abs(gradient[x > 0]).max() < 1


def test_patterns_do_most_of_a_large_histogram():
    counts = np.zeros(2049, np.int64)
    counts[1:] = 1 + 50_000 // np.arange(20, 2068)
    made = P.patterns(np.flatnonzero(counts[:2048]), 2048)
    x = np.round(P.fit(made, np.append(counts[:2048], 0), np.ones(2049)))
    assert ((made > 0).sum(1) * x).sum() > 0.8 * counts[:2048].sum()
    used = check(places(P.plan(counts), counts), 2048)
    assert used <= -(-(counts * np.arange(2049)).sum() // 2048) * 1.002 + 1


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(2)
    out = [(i, " ".join(f"w{x}" for x in rng.integers(0, 99, rng.integers(0, 300)))) for i in range(200)]
    out += [(None, "null id"), (3, "again"), (3, "again"), (900, None), (901, ""), (902, "word " * 30_000), (903, "a " * 2047), (904, "a " * 2048), (905, "<|endoftext|> x")]
    return out + [(1000 + i, "a copy of one text") for i in range(200)]


def _pieces(rows, size=2048):
    tok = Tokenizer.from_file(PATH)
    out = []
    for key, text in rows:
        ids = tok.encode(text or "", add_special_tokens=False).ids + [0]
        out += [(key, i // size, i, len(part := ids[i : i + size]), zlib.crc32(np.array(part, "<u4").tobytes())) for i in range(0, len(ids), size)]
    return sorted(out, key=repr)


def _checked(got, rows, size=2048):
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=repr) == _pieces(rows, size)
    return check([(r.length, r.sequence_id, r.offset) for r in got], size)


def test_pieces_and_places(spark, rows):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "doc_id long, text string, length string, task int").repartition(3)
    for size in (2048, 50):
        cuts = P.cut(docs, PATH, size=size).withColumn("ids_crc32", F.crc32("ids"))
        used = _checked(P.pack(cuts, size).collect(), rows, size)
        assert used <= -(-sum(x[3] for x in _pieces(rows, size)) // size) * 1.02 + 1


def test_sequences_hold_the_ids_of_their_parts(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    back = []
    for r in P.sequences(docs, PATH).collect():
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == sum(p.length for p in r.parts) <= 2048
        back += [(p.doc_id, p.piece, p.piece * 2048, p.length, zlib.crc32(ids[p.offset : p.offset + p.length].tobytes())) for p in r.parts]
    assert sorted(back, key=repr) == _pieces(rows)


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert P.pack(P.cut(none, PATH)).collect() == []
    assert P.sequences(none, PATH).collect() == []


def test_whole_table(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    used = _checked(P.query(spark, sf_dir).collect(), rows)
    assert used <= -(-sum(x[3] for x in _pieces(rows)) // 2048) * 1.005 + 1
