"""Token ids as length-delimited binary records.

A shard is two files. The data file holds one frame per sequence:

    u64 length | u32 masked crc32 of the length | payload | u32 masked crc32 of the payload

with the payload u8 "has an id" | i64 document id | token ids, all little-endian.
Ids take two bytes if the vocabulary has at most 65,536 entries, else four. The
index file holds ``(u64 frame offset, u64 frame length)`` for each record, so
that a reader can fetch any record, in any order, with one seek. A checksum is
masked by rotating it right by 15 bits and adding a constant, so that checksums
of data that itself holds checksums stay sound.

Shards are ranges of document ids in ascending order, of about ``SHARD_BYTES`` of text
each (or as many as Spark shuffles into, if that is more); records and their index are
written as they come, so a task holds no more than a slice of its rows. A task writes files under
a name of its own and reports them only when they are whole, so a task that is
run again leaves the first files unread.

Defined cases: a null text is an empty one and gives the end id alone; null ids
come first; rows that repeat an id each have a record, ordered by text; an empty
table gives no shard and no rows. Other columns are not read.
"""

from __future__ import annotations

import functools
import math
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import own_folder, pieces, tidy

#: Fixed values of the frame format.
MASK_DELTA = 0xA282EAD8
LENGTH, CHECK, HEAD, INDEX = struct.Struct("<Q"), struct.Struct("<I"), struct.Struct("<?q"), struct.Struct("<QQ")
#: Bytes of text of a shard, so that shards and not tasks grow with a table; and the letters by which rows of one id are told apart when ranges are cut.
SHARD_BYTES, CUT = 256 << 20, 64
#: Words whose ids a worker remembers.
REMEMBERED = 600_000


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = LENGTH.pack(len(payload))
    return b"".join((length, CHECK.pack(masked(length)), payload, CHECK.pack(masked(payload))))


class Encoder:
    """Ids of texts by a tokenizer whose rules never join or part text across a space or line feed.

    The ids of a text are then those of its words in turn, and each distinct
    word is encoded once. ``plain`` says whether the tokenizer knows no case,
    parts marks from letters and ends each word with an id of its own.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.known: dict[str, bytes] = {}
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        if suffix:
            self.ends[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith(suffix)]] = True
        big, small, mark = self._ids(["STRASS\u00c9.", "strass\u00e9", "."])
        self.plain = bool(suffix) and big == small + mark
        # added tokens are found in the text as written: case tells them from words
        added = [re.escape(token.content) for token in self.tokenizer.get_added_tokens_decoder().values()]
        self.cased = "|".join([r"[^\x{00}-\x{FF}]", *(f"(?i:{token})" for token in added)])

    def _ids(self, words: list[str]) -> list[bytes]:
        return [np.array(x.ids, self.width).tobytes() for x in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _letters(self, words: list[str]) -> list[bytes]:
        """Ids of words of Latin-1 letters. Each ends with the first id that ends a word, so they go to the tokenizer as one text."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, self.width)
        stops = (np.flatnonzero(self.ends[ids]) + 1).tolist()
        if len(stops) != len(words) or stops[-1] != len(ids):
            return self._ids(words)
        raw, size = ids.tobytes(), self.width.itemsize
        return [raw[a * size : b * size] for a, b in zip([0, *stops], stops, strict=False)]

    def _learn(self, fresh: list[str]) -> None:
        plain = [w for w in fresh if self.plain and w.isalpha() and (w.isascii() or max(w) <= "\xff")]
        for at in range(0, len(plain), 4000):
            some = plain[at : at + 4000]
            self.known.update(zip(some, self._letters(some), strict=True))
        others = [w for w in fresh if w not in self.known]
        self.known.update(zip(others, self._ids(others), strict=True))

    def _words(self, texts: pa.Array) -> pa.ListArray:
        """The words of each text. For a ``plain`` tokenizer texts of Latin-1 that hold no added token, in whatever case, go without case, and a full stop or comma that ends a word of letters is a word of its own."""
        if self.plain:
            texts = pc.if_else(pc.match_substring_regex(texts, self.cased), texts, pc.utf8_lower(texts))
            texts = pc.replace_substring_regex(texts, r"([a-z\x{DF}-\x{F6}\x{F8}-\x{FF}])([.,])([ \n]|\z)", r"\1 \2\3")
        return pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")

    def encode(self, texts: list[str | None] | pa.Array, end_id: int) -> list[bytes]:
        """The ids of each text and the end id, ``width`` bytes each. Words are told apart by Arrow; Python sees each distinct one once a call."""
        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        words = self._words(texts)
        flat = words.flatten().dictionary_encode()
        distinct, number = flat.dictionary.to_pylist(), flat.indices.to_numpy()
        if len(self.known) > REMEMBERED:
            self.known.clear()
        self._learn([w for w in distinct if w not in self.known])
        ids = [self.known[w] for w in distinct]
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // self.width.itemsize
        start, length = np.cumsum(size) - size, size[number]
        before = np.cumsum(length) - length
        made = np.frombuffer(b"".join(ids), self.width)[np.repeat(start[number] - before, length) + np.arange(length.sum())].tobytes()
        ends = np.append(before, length.sum())[words.offsets.to_numpy() - words.offsets[0].as_py()] * self.width.itemsize
        end = np.array([end_id], self.width).tobytes()
        return [made[a:b] + end for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


@functools.lru_cache(1)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


MANIFEST = pa.schema([("shard", pa.int64()), ("data", pa.string()), ("index", pa.string()), ("n_records", pa.int64()), ("n_tokens", pa.int64())])


@tidy
def _write_shard(batches: Iterator[pa.RecordBatch], tokenizer: str, target: str, end_id: int) -> Iterator[pa.RecordBatch]:
    enc, out, index, at, records, tokens = None, None, None, 0, 0, 0
    name = f"{target}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
    for batch in pieces(batches, "text"):
        if out is None:
            enc = encoder(tokenizer)
            where, path = _open(name)
            where.create_dir(os.path.dirname(path), recursive=True)
            out, index = (where.open_output_stream(f"{path}.{kind}", compression=None, buffer_size=1 << 20) for kind in ("rec", "idx"))
        for key, ids in zip(batch.column("doc_id").to_pylist(), enc.encode(batch.column("text"), end_id), strict=True):
            data = frame(HEAD.pack(key is not None, key or 0) + ids)
            out.write(data)
            index.write(INDEX.pack(at, len(data)))
            at += len(data)
            records += 1
            tokens += len(ids) // enc.width.itemsize
    if out is not None:
        out.close()
        index.close()
        yield pa.RecordBatch.from_pylist([{"shard": TaskContext.get().partitionId(), "data": f"{name}.rec", "index": f"{name}.idx", "n_records": records, "n_tokens": tokens}], MANIFEST)


def write(docs: DataFrame, tokenizer: str, target: str, end_id: int = 1, doc_id: str = "doc_id", text: str = "text", shards: int | None = None) -> list[dict]:
    """Encode every text and write the shards to the folder ``target``, which all executors reach; returns a manifest entry for each shard, in order."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    if shards is None:
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0  # one number
        shards = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / SHARD_BYTES))
    # rows that repeat an id may be cut apart by their texts, which is the order of records too
    done = rows.repartitionByRange(shards, "doc_id", F.left("text", F.lit(CUT))).sortWithinPartitions("doc_id", "text").mapInArrow(partial(_write_shard, tokenizer=tokenizer, target=target, end_id=end_id), "shard long, data string, index string, n_records long, n_tokens long")
    return [r.asDict() for r in sorted(done.collect(), key=lambda r: r.shard)]  # a row for each shard


class ShardReader:
    """Records of one shard, in file order by iteration or in any order by number."""

    def __init__(self, data: str, index: str, width: str = "<u2"):
        where, path = _open(data)
        self.width, self.path, self.where = np.dtype(width), path, where
        self.index, self.file = index, None

    def _checked(self, raw: bytes) -> tuple[int | None, np.ndarray]:
        length, payload = raw[: LENGTH.size], raw[LENGTH.size + CHECK.size : -CHECK.size]
        if masked(length) != CHECK.unpack_from(raw, LENGTH.size)[0] or LENGTH.unpack(length)[0] != len(payload) or masked(payload) != CHECK.unpack(raw[-CHECK.size :])[0]:
            raise ValueError(f"{self.path}: a record is damaged")
        has, key = HEAD.unpack_from(payload)
        return key if has else None, np.frombuffer(payload, self.width, offset=HEAD.size)

    def __iter__(self) -> Iterator[tuple[int | None, np.ndarray]]:
        head = LENGTH.size + CHECK.size
        with self.where.open_input_stream(self.path, compression=None, buffer_size=1 << 20) as file:
            while start := file.read(head):
                if len(start) < head or masked(start[: LENGTH.size]) != CHECK.unpack_from(start, LENGTH.size)[0]:
                    raise ValueError(f"{self.path}: a record is damaged")
                yield self._checked(start + file.read(LENGTH.unpack_from(start)[0] + CHECK.size))

    def __getitem__(self, i: int) -> tuple[int | None, np.ndarray]:
        if self.file is None:
            self.file = self.where.open_input_file(self.path)
        at, length = self.entries[i]
        self.file.seek(int(at))
        return self._checked(self.file.read(int(length)))

    @functools.cached_property
    def entries(self) -> np.ndarray:
        where, path = _open(self.index)
        with where.open_input_stream(path, compression=None) as file:
            return np.frombuffer(file.read(), "<u8").reshape(-1, 2)

    def __len__(self) -> int:
        return len(self.entries)


RECORD = "doc_id long, start long, n_tokens long, ids_crc32 long"


@tidy
def _read_shards(batches: Iterator[pa.RecordBatch], width: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for entry in batch.to_pylist():
            rows, at = [], entry["start"]
            for key, ids in ShardReader(entry["data"], entry["index"], width):
                rows.append((key, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                at += len(ids)
                if len(rows) == 10_000:
                    yield _batch(rows)
                    rows = []
            yield _batch(rows)


def read(spark, manifest: list[dict], width: str = "<u2") -> DataFrame:
    """A row for each record, from the files: doc_id, start (ids of all records before it), n_tokens, ids_crc32 (of the ids as unsigned 32-bit numbers)."""

    starts = np.cumsum([0, *(x["n_tokens"] for x in manifest)]).tolist()
    entries = [(x["shard"], x["data"], x["index"], at) for x, at in zip(manifest, starts, strict=False)]
    listed = spark.createDataFrame(entries, "shard long, data string, index string, start long")
    return listed.repartitionByRange(max(1, len(entries)), "shard").mapInArrow(partial(_read_shards, width=width), RECORD)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "n_tokens", "ids_crc32"])


def width_of(tokenizer: str) -> str:
    return encoder(tokenizer).width.str


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Write ``docs`` to a new folder in the shared one and read the files back."""
    spark = docs.sparkSession
    manifest = write(docs, tokenizer, own_folder(spark, "tokens"), end_id)
    return read(spark, manifest, width_of(tokenizer))


def query(spark, sf_dir: str) -> DataFrame:
    """All ``documents`` through the files."""
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_tokenizer())
