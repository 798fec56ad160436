import hashlib
import random
from collections import Counter

import pytest
import sentencepiece
from tokenizers import Tokenizer

from veilscan.llm import token_alignment as T

A, B = T.default_tokenizers()
LETTERS = T.byte_letters()
TOK = Tokenizer.from_file(A)
TOK.encode_special_tokens = True
SP = sentencepiece.SentencePieceProcessor(model_file=B)
NAMES = {i: name for name, i in TOK.get_vocab(with_added_tokens=False).items()}
PARTS = ["a", "the", " ", "  ", "\n", "\t", "\r", "\u3000", "\u00a0", "\u00e9", "\ufb01", "\u2581", "<0x41>", "<|endoftext|>", "</s>", "'s", "123", "...", "\u65e5\u672c", "\U0001f642", "\x1c", "\x85", "\u200b", "word", "\n\n", "  \n ", "a.b", " x"]


def _b_bytes(i):
    return bytes([int(SP.id_to_piece(i)[3:5], 16)]) if SP.is_byte(i) else SP.id_to_piece(i).replace("\u2581", " ").encode()


def brute_groups(text):
    """Groups of one text, from tokens of the whole text."""
    if not text:
        return []
    a, b = TOK.encode(" " + text, add_special_tokens=False).ids, SP.encode(text)
    a_raw, b_raw = [bytes(LETTERS[c] for c in NAMES[i]) for i in a], [_b_bytes(i) for i in b]
    if b"".join(a_raw) != (" " + text).encode() or b"".join(b_raw) != (" " + text).encode():
        return []
    out, p, q, i, j = [], 0, 0, 0, 0
    x = y = 0
    while i < len(a):
        if x <= y:
            x, i = x + len(a_raw[i]), i + 1
        else:
            y, j = y + len(b_raw[j]), j + 1
        if x == y:
            out.append((a[p:i], b[q:j]))
            p, q = i, j
    if j < len(b) or q < len(b):
        out.append((a[p:], b[q:]))
    return [g for g in out if g[0] and g[1]]


def brute(rows):
    """The contract, document by document."""
    linked = []
    for _, text in rows:
        pairs = Counter()
        for a, b in brute_groups(text):
            pairs.update((x, y) for x in a for y in b)
        linked.append(pairs)
    count = Counter(pair for pairs in linked for pair in pairs)
    best = Counter()
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    out = []
    for (key, text), pairs in zip(rows, linked, strict=True):
        g = brute_groups(text)
        written = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in g)
        out.append((key, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(pairs.values()), sum(n for p, n in pairs.items() if count[p] == best[p[0]]), sum(n * count[p] for p, n in pairs.items()), hashlib.sha256(written.encode()).hexdigest() if written else ""))
    return sorted(out, key=repr)


COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def _of(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


def test_units_give_what_whole_texts_give():
    rng, known = random.Random(5), T.Aligner(A, B)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    want = [";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in brute_groups(t)) for t in texts]
    assert known.by_unit
    assert known.texts(*known.numbers(texts)) == want


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    some = [(i, "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 60)))) for i in range(150)]
    some += [(None, "null id here"), (3, "again, again"), (3, "again, again"), (200, None), (201, ""), (202, " "), (203, "word " * 30_000), (204, "x" * 50_000), (205, "\u2581 a"), (206, "a ")]
    return some + [(300 + i, "hot words of a passage, the hot words.") for i in range(80)]


def test_documents_of_every_kind(spark, rows):
    docs = spark.createDataFrame([(k, t, "clash", 1) for k, t in rows], "doc_id long, text string, chunk string, n_a int")
    assert _of(T.align(docs, A, B)) == brute(rows)


def test_small_limits_change_nothing(spark, rows):
    """Ids split over many tasks, rows of few documents, chunks of few, buffers that are given on, a worker that forgets."""
    rows = [r for r in rows if len(r[1] or "") < 1000]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute(rows)
    limits = T.Limits(chunk=16, entries=200, row=3, split=10, task=100, remembered=50, buffer=20)
    assert _of(T.align(docs, A, B, limits=limits)) == want


def test_streamed_ids_carry_over_batches():
    """Heads and postings of an id in batches of one to three rows, and a batch that begins in the middle of an id."""
    import numpy as np
    import pyarrow as pa

    heads = [(1, 0, 5, 4), (1, 0, 6, 2), (2, 0, 5, 1)]
    posts = {1: [(5, [0, 3], [1, 2]), (5, [7, 9], [1, 1]), (6, [3, 4], [5, 1])], 2: [(5, [0], [3])]}
    rows = []
    for a in (1, 2):
        rows += [(a, s, b, n, None, None, None) for a_, s, b, n in heads if a_ == a]
        rows += [(a, 0, b, len(d), 8, np.array(d, "<u2").tobytes(), np.array(t, "<u4").tobytes()) for b, d, t in posts[a]]
    schema = pa.schema([("a", pa.int32()), ("salt", pa.int32()), ("b", pa.int32()), ("n", pa.int64()), ("chunk", pa.int64()), ("docs", pa.binary()), ("times", pa.binary())])
    whole = pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)
    want = {0: (4, 4 + 3), 3: (2, 2 * 4 + 5 * 2), 7: (1, 4), 9: (1, 4), 4: (0, 2)}
    for size in (1, 2, 3, len(rows)):
        got = pa.Table.from_batches(list(T._cogroup((whole.slice(i, size) for i in range(0, len(rows), size)), T.Limits()))).to_pylist()
        found = {int(d): (int(n), int(t)) for r in got for d, n, t in zip(np.frombuffer(r["docs"], "<u2"), np.frombuffer(r["n_best"], "<i8"), np.frombuffer(r["count_sum"], "<i8"), strict=True)}
        assert found == want


def test_groups_are_the_texts_that_the_digest_is_of(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id is None, r.doc_id or 0, hashlib.sha256(r.groups.encode()).hexdigest() if r.groups else "") for r in T.groups(docs, A, B).collect())
    assert got == sorted((r[0] is None, r[0] or 0, r[-1]) for r in brute(rows))


def test_empty_table(spark):
    assert T.align(spark.createDataFrame([], "doc_id long, text string"), A, B).collect() == []


def test_whole_table(spark):
    sf_dir = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert _of(T.query(spark, sf_dir)) == brute(rows)
