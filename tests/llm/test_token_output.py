import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from veilscan.llm import token_output as T

PATH = T.default_tokenizer()
TEXTS = [None, "", " ", "Hello  world\n\nit's", "a<|endoftext|>b <|startoftext|>", "é ́ ΑΣ ᲀ\x1cx\x1f  y　z", "I'LL 123 ...?!\t\x0b w", "İstanbul ﬁ ΑΣ.", "Ünïcödé, straße. ÀÿªºµÞ, x., .,y a.b, 1st. 2, ΑΣ, don't, 's. İ. q\u0301, ﬁ.", "word " * 30_000]


def brute(texts):
    tok = Tokenizer.from_file(PATH)
    return [tok.encode(t or "", add_special_tokens=False).ids + [1] for t in texts]


def test_word_by_word_ids_equal_whole_text_ids():
    enc = T.Encoder(PATH)
    assert [np.frombuffer(x, enc.width).tolist() for x in enc.encode(TEXTS, 1)] == brute(TEXTS)


def test_added_tokens_are_told_by_case():
    texts = ["a <|ENDOFTEXT|> b", "a <|EndOfText|>.", "x<|STARTOFTEXT|>y Z.", "HELLO, <|endoftext|>. YES. <|ENDOFTEXT|>", "<|ENDOFTEXT|> \u00c9\u00c9. \u0391", "<|END OF TEXT|>", "plain A."]
    enc = T.Encoder(PATH)
    assert [np.frombuffer(x, enc.width).tolist() for x in enc.encode(texts, 1)] == brute(texts)


def test_round_trip(spark):
    rows = [(9 - i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "null id", "x"), (3, "again", "x"), (3, "again", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string")
    got = sorted(T.round_trip(docs, PATH).collect(), key=lambda r: r.start)
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    at = 0
    for r, (key, text, _), ids in zip(got, rows, brute([r[1] for r in rows]), strict=True):
        assert tuple(r) == (key, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), text
        at += len(ids)


def test_whole_table_matches_whole_text_encoding(spark):
    d = "/root/testdata/sf0.001"
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect())
    got = sorted(map(tuple, T.query(spark, d).collect()))
    at = 0
    for r, (key, _), ids in zip(got, rows, brute([r[1] for r in rows]), strict=True):
        assert r == (key, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_shuffled_reads_and_damage(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text number {i}") for i in range(50)], "doc_id long, text string")
    manifest = T.write(docs, PATH, f"file://{tmp_path}", shards=3)
    seen = []
    for m in manifest:
        reader = T.ShardReader(m["data"], m["index"])
        order = np.random.default_rng(1).permutation(len(reader))
        by_number = {int(i): reader[int(i)] for i in order}
        for i, (key, ids) in enumerate(reader):
            assert by_number[i][0] == key and (by_number[i][1] == ids).all()
            seen.append(key)
    assert seen == list(range(50))
    path = manifest[0]["data"].removeprefix("file://")
    raw = bytearray(open(path, "rb").read())
    raw[40] ^= 1
    open(path, "wb").write(raw)
    with pytest.raises(ValueError):
        list(T.ShardReader(manifest[0]["data"], manifest[0]["index"]))


def test_empty_table(spark):
    assert T.round_trip(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_shards_grow_with_the_table(spark, tmp_path, monkeypatch):
    """As many shards as bytes ask for, whatever Spark's setting; rows of one id in several of them stay in order."""
    rows = [(7, f"{i:03d} " + "word " * 50) for i in range(200)] + [(8, None), (6, "first")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(T, "SHARD_BYTES", 4000)
    manifest = T.write(docs, PATH, f"file://{tmp_path}/many")
    assert len(manifest) > 8
    assert max(x["n_records"] for x in manifest) < 150
    texts = sorted(rows, key=lambda r: (r[0], r[1] or ""))
    back = [(key, ids.tolist()) for x in manifest for key, ids in T.ShardReader(x["data"], x["index"])]
    assert back == [(key, ids) for (key, _), ids in zip(texts, brute([t for _, t in texts]), strict=True)]
    assert [len(T.ShardReader(x["data"], x["index"])) for x in manifest] == [x["n_records"] for x in manifest]
