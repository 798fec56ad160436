"""Exact removal of repeated 100-byte strings by bucket-pointer refinement.

A byte goes if a string of ``LENGTH`` bytes over it also starts earlier (in a
document of a smaller id, or further up in the same document).

The suffixes of a whole corpus are never sorted at once. Of the 32-byte grams in
each string of 100 bytes, the one whose hash is least is the string's anchor; as
the string alone decides which it is, equal strings have equal anchors at equal
places, and each string belongs to one anchor. Then buckets are refined:

1. The first buckets are the anchors' grams. Of all anchors only fingerprints
   are dealt out: of the gram, and of everything that the anchor's strings
   cover. Anchors that agree in both have the same strings, and all but the
   earliest are removed whole. This is done within each piece of input first, so
   a passage that a third of all documents share is dealt out once a piece.
2. Grams under which there are still different surroundings are refined by the
   bytes next to them: 34 to the left for the strings that reach so far,
   or to the right for the others. What shares a bucket comes together with its
   bytes, once.
3. There the strings are refined to their full length by bucket pointers: places
   start in buckets of 25 bytes, which are sorted on the buckets that places 25
   further on point to, and these again on themselves 50 further on. Buckets of
   one place are left alone.

No task holds more than its share: buckets of step 1 get ``SETTLED`` bytes of
text each, however many that makes; anchors of a gram that is frequent with
different surroundings are spread over all of them and stay open; and groups of
step 3 of more than ``GROUP`` bytes are not gathered, but their strings are
counted by 128-bit fingerprints, of which all but the first place go.

Buckets are known by 64-bit fingerprints of 25 bytes, four for a string, and by
48 bits each of a gram and its surroundings.

Defined cases: a null text is empty; ids are integers, or strings that are read as
such, and a null one is the smallest; rows that repeat
id and text are one document, whose result each of them gets; rows that repeat
the id alone are ordered by a hash of their text; an empty table gives no rows;
texts have no length bound, long ones being cut into overlapping parts. Other
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT_KEYS, meet, mixed, pieces, stored, tidy

LENGTH, GRAM, SIDE, QGRAM = 100, 32, 34, 25
#: Bytes of text whose anchors one task settles, different surroundings of a gram in a piece from which they are dealt over all tasks, and bytes of a group that one task refines.
SETTLED, SPREAD, GROUP = 1 << 25, 8, 1 << 23
#: Bytes of text that are worked on at once.
PIECE = 1 << 19
_place = 24  # bits of a place in a piece
_anchor = np.dtype([("g", "<u4"), ("g2", "<u2"), ("c", "<u4"), ("c2", "<u2"), ("doc", "<u2"), ("pos", "<u4"), ("lo", "u1"), ("hi", "u1")])
_doc = np.dtype([("id", "<i8"), ("h", "<i8")])
_bytes = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def grams(buf: np.ndarray, of: int = GRAM) -> np.ndarray:
    """Fingerprints of the ``of`` bytes from every place on: of 1, 2, 4 and so on, and at last of two runs that may overlap."""
    out, width = _bytes[buf], 1
    while width < of:
        step = min(width, of - width)
        i = width.bit_length() - 1
        out = out[: len(out) - step] * np.uint64(0xD6E8FEB86659FD93 + 2 * i) + out[step:]
        out = out ^ (out >> np.uint64(29 + i))
        width += step
    return mixed(out)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[tuple[int, int, int, int]]]]:
    """Pieces of text, as bytes and segments (id, h, place in the document, length); strings are not cut."""
    held, segments, size = [], [], 0
    for batch in pieces(batches, "text", PIECE):
        for key, h, text in zip(batch.column("doc_id").to_pylist(), batch.column("h").to_pylist(), batch.column("text").to_pylist(), strict=True):
            raw = (text or "").encode("utf-8", "surrogatepass")
            for at in range(0, len(raw) - LENGTH + 1, PIECE):
                part = raw[at : at + PIECE + LENGTH - 1]
                if size + len(part) > 3 * PIECE or len(segments) == 65_000:
                    yield np.frombuffer(b"".join(held), np.uint8), segments
                    held, segments, size = [], [], 0
                held.append(part)
                segments.append((key, h, at, len(part)))
                size += len(part)
        if size >= PIECE:
            yield np.frombuffer(b"".join(held), np.uint8), segments
            held, segments, size = [], [], 0
    if size:
        yield np.frombuffer(b"".join(held), np.uint8), segments


def anchors(buf: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each anchor: its gram's fingerprint, its surroundings', its segment, its place in ``buf``, and the first and last start of its strings."""
    g = grams(buf)
    least = (g & ~np.uint64((1 << _place) - 1)) | np.arange(len(g), dtype=np.uint64)
    width, of = 1, LENGTH - GRAM + 1
    while 2 * width <= of:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[: len(least) - (of - width)], least[of - width :])
    ends = np.cumsum(lengths)
    inside = np.ones(len(buf), bool)
    for k in range(1, LENGTH):  # the last starts of each segment have no whole string
        inside[ends - k] = False
    starts = np.flatnonzero(inside)
    at = (least[starts] & np.uint64((1 << _place) - 1)).astype(np.int64)
    run = np.flatnonzero(np.diff(at, prepend=-1))
    first, last = starts[run], starts[np.append(run[1:], len(starts)) - 1]
    at = at[run]
    around = mixed((last - first).astype(np.uint64))
    for i in range((2 * LENGTH - GRAM) // GRAM + 1):
        around = mixed(around * np.uint64(0xC2B2AE3D27D4EB4F) + g[np.minimum(first + GRAM * i, last + LENGTH - GRAM)])
    return g[at], around, np.searchsorted(ends, at, side="right"), at, first, last


#: Kinds of anchors: met by gram, met by gram and surroundings, and settled within their piece.
ANCHOR, OFTEN, AGAIN = range(3)


@tidy
def _deal(batches: Iterator[pa.RecordBatch], buckets: int, spread: int) -> Iterator[pa.RecordBatch]:
    """Anchors of each piece by bucket.

    A gram with ``spread`` different surroundings or more in a piece may be one
    that no task can hold, so its anchors are dealt out by gram and surroundings,
    and a witness, which has no strings (lo > hi), goes where those of other
    pieces meet, so that these stay open too.
    """
    for buf, segments in _parts(batches):
        lengths = np.array([s[3] for s in segments])
        gram, around, seg, at, first, last = anchors(buf, lengths)
        begins = np.cumsum(lengths) - lengths
        docs = np.array([(s[0], s[1]) for s in segments], _doc)
        base = np.array([s[2] for s in segments]) - begins
        order = np.lexsort((at + base[seg], docs["h"][seg], docs["id"][seg], around, gram))
        gram, around, seg, at, first, last = (x[order] for x in (gram, around, seg, at, first, last))
        again = np.append(False, (gram[1:] == gram[:-1]) & (around[1:] == around[:-1]))
        records = np.zeros(len(gram), _anchor)
        gram, around = gram >> np.uint64(16), around >> np.uint64(16)
        records["g"], records["g2"] = gram & np.uint64(0xFFFFFFFF), gram >> np.uint64(32)
        records["c"], records["c2"] = around & np.uint64(0xFFFFFFFF), around >> np.uint64(32)
        records["pos"], records["lo"], records["hi"] = at + base[seg], at - last, at - first
        new = np.append(True, gram[1:] != gram[:-1])[: len(gram)]
        of = np.cumsum(new) - 1
        often = (np.bincount(of, ~again) >= spread)[of] & ~again if len(gram) else again
        # what is settled here already needs no other place than its document's
        kind = np.where(again, AGAIN, np.where(often, OFTEN, ANCHOR))
        key = np.where(again, docs["h"][seg].astype(np.uint64), np.where(often, gram ^ (around << np.uint64(16)), gram))
        witness = np.flatnonzero(often & np.append(True, ~often[:-1] | new[1:])[: len(often)])
        told = records[witness]
        told["lo"], told["hi"] = 1, 0
        records, kind, key, seg = np.concatenate([records, told]), np.append(kind, np.full(len(told), ANCHOR)), np.append(key, gram[witness]), np.append(seg, seg[witness])
        bucket = (mixed(key) % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((seg, kind, bucket))
        cuts = np.flatnonzero(np.diff(bucket[order] * 3 + kind[order], prepend=-1))
        rows = []
        for some in np.split(order, cuts[1:]):
            used, local = np.unique(seg[some], return_inverse=True)
            part = records[some]
            part["doc"] = local
            rows.append({"bucket": int(bucket[some[0]]), "kind": int(kind[some[0]]), "docs": docs[used].tobytes(), "anchors": part.tobytes()})
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("docs", pa.binary()), ("anchors", pa.binary())]))


FOUND = "doc_id long, h long, settled boolean, key long, pos long, lo int, hi int"
_found = ["doc_id", "h", "settled", "key", "pos", "lo", "hi"]


def _found_rows(docs: np.ndarray, a: np.ndarray, settled: bool, key: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(a), 100_000):
        d, x = docs[at : at + 100_000], a[at : at + 100_000]
        k = np.zeros(len(x), np.int64) if key is None else key[at : at + 100_000].astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(d["id"]), pa.array(d["h"]), pa.array(np.full(len(x), settled)), pa.array(k), pa.array(x["pos"].astype(np.int64)), pa.array(x["lo"].astype(np.int32)), pa.array(x["hi"].astype(np.int32))], _found)


@tidy
def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All anchors of some buckets: removes those with the surroundings of an earlier one, and reports those that stay open, as those of frequent grams all do."""
    held: dict[int, list] = {ANCHOR: [], OFTEN: []}
    for batch in batches:
        for kind, docs, raw in zip(*(batch.column(c).to_pylist() for c in ("kind", "docs", "anchors")), strict=True):
            a = np.frombuffer(raw, _anchor)
            d = np.frombuffer(docs, _doc)[a["doc"]]
            if kind == AGAIN:
                yield from _found_rows(d, a, True)
            else:
                held[kind].append((a, d))
    for kind, parts in held.items():
        if not parts:
            continue
        a, d = (np.concatenate(x) for x in zip(*parts, strict=True))
        parts.clear()
        gram = a["g"].astype(np.uint64) | a["g2"].astype(np.uint64) << np.uint64(32)
        around = a["c"].astype(np.uint64) | a["c2"].astype(np.uint64) << np.uint64(32)
        order = np.lexsort((a["pos"], d["h"], d["id"], around, a["hi"], a["lo"], gram))
        a, d, gram, around = a[order], d[order], gram[order], around[order]
        again = np.append(False, (gram[1:] == gram[:-1]) & (around[1:] == around[:-1]) & (a["lo"][1:] == a["lo"][:-1]) & (a["hi"][1:] == a["hi"][:-1]))
        real = a["lo"] <= a["hi"]
        yield from _found_rows(d[again & real], a[again & real], True)
        a, d, gram, real = a[~again], d[~again], gram[~again], real[~again]
        same = gram[1:] == gram[:-1]
        open_ = real & ((kind == OFTEN) | np.append(same, False) | np.append(False, same))
        yield from _found_rows(d[open_], a[open_], False, gram[open_])


@tidy
def _zip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as bytes, packed to move less."""
    pack = zstandard.ZstdCompressor(level=1)
    for batch in pieces(batches, "text", PIECE):
        packed = [pack.compress((t or "").encode("utf-8", "surrogatepass")) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), pa.array(packed, pa.binary())], ["doc_id", "h", "z"])


SIDES = "key long, doc_id long, h long, start long, n int, bytes binary"


@tidy
def _sides(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes around open anchors, under a key of their gram and one side of it."""
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            out = []
            for row in batch.slice(at, 256).to_pylist():
                raw = unpack.decompress(row["z"], max_output_size=1 << 31)
                for x in row["open"]:
                    a, lo, hi = x["pos"], x["lo"], x["hi"]
                    for low, high, side in ((max(lo, SIDE), hi, raw[a - SIDE : a] if a >= SIDE else b""), (lo, min(hi, SIDE - 1), raw[a + GRAM : a + GRAM + SIDE])):
                        if low <= high:
                            key = int.from_bytes(hashlib.blake2b(side, digest_size=8, key=x["key"].to_bytes(8, "little"), person=b"left" if low >= SIDE else b"right").digest(), "little", signed=True)
                            out.append((key, row["doc_id"], row["h"], a - high, high - low + 1, raw[a - high : a - low + LENGTH]))
            columns = list(zip(*out, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["key", "doc_id", "h", "start", "n", "bytes"])


def string_buckets(buf: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Bucket numbers of the 100-byte strings at ``starts``: equal for equal strings, -1 for those that are alone.

    Bucket-pointer refinement: every place of ``buf`` points to its bucket, first
    that of its ``QGRAM`` bytes. A bucket of several places is refined by sorting
    them on the bucket that the place one bucket width further on points to, and
    places point to the refined buckets from then on, so each step sorts on what
    the step before it has refined and buckets grow from 25 bytes to 50 and 100.
    Buckets of one place are left alone.
    """
    pointer = np.unique(grams(buf, QGRAM), return_inverse=True)[1].astype(np.int64)
    width = QGRAM
    while width < LENGTH:
        reach, above = len(pointer) - width, int(pointer.max(initial=0)) + 1
        shared = np.flatnonzero(np.bincount(pointer)[pointer[:reach]] > 1)
        refined = np.unique(pointer[shared] * above + pointer[shared + width], return_inverse=True)[1]
        pointer = pointer[:reach].copy()
        pointer[shared] = above + refined
        width *= 2
    number = np.unique(pointer[starts], return_inverse=True)[1]
    return np.where(np.bincount(number)[number] > 1, number, -1)


STRINGS = "string binary, doc_id long, h long, start long"


@tidy
def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each string of groups that are too large for one task, by a 128-bit fingerprint."""
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            out = []
            for row in batch.slice(at, 2000).to_pylist():
                out += [(hashlib.blake2b(row["bytes"][i : i + LENGTH], digest_size=16).digest(), row["doc_id"], row["h"], row["start"] + i) for i in range(row["n"])]
            columns = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.binary(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["string", "doc_id", "h", "start"])


SPANS = "doc_id long, h long, start long, stop long"


@tidy
def _refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come in key order: strings under one key are compared, and the spans of those that start earlier elsewhere are returned."""
    held: list[tuple] = []
    size = 0

    def done(rows: list[tuple]) -> pa.RecordBatch:
        lengths = np.array([len(r[5]) for r in rows])
        begins = np.cumsum(lengths) - lengths
        n = np.array([r[4] for r in rows])
        row = np.repeat(np.arange(len(rows)), n)
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        number = string_buckets(np.frombuffer(b"".join(r[5] for r in rows), np.uint8), begins[row] + step)
        keep = number >= 0
        row, step, number = row[keep], step[keep], number[keep]
        ids, hs, begin = (np.array([r[i] for r in rows], np.int64) for i in (1, 2, 3))
        pos = begin[row] + step
        order = np.lexsort((pos, hs[row], ids[row], number))
        later = np.append(False, number[order][1:] == number[order][:-1])[: len(order)]  # empty if no string is repeated
        gone = np.sort(order[later])
        row, pos = row[gone], pos[gone]
        new = np.append(True, (row[1:] != row[:-1]) | (pos[1:] != pos[:-1] + 1)) if len(row) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(row)) - 1
        columns = (ids[row[first]], hs[row[first]], pos[first], pos[last] + LENGTH) if len(row) else [np.zeros(0, np.int64)] * 4
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["doc_id", "h", "start", "stop"])

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if size > PIECE and row[0] != held[-1][0]:
                yield done(held)
                held, size = [], 0
            held.append(row)
            size += len(row[5])
    if held:
        yield done(held)


RESULT = "doc_id long, h long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<start: long, stop: long>>"


@tidy
def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor()
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            out = []
            for row in batch.slice(at, 512).to_pylist():
                raw = unpack.decompress(row["z"], max_output_size=1 << 31)
                spans: list[list[int]] = []
                for x in sorted((x["start"], x["stop"]) for x in row["spans"] or ()):
                    if spans and x[0] <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], x[1])
                    else:
                        spans.append(list(x))
                kept, at_byte = hashlib.sha256(), 0
                for start, stop in spans:
                    kept.update(raw[at_byte:start])
                    at_byte = stop
                kept.update(raw[at_byte:])
                out.append((row["doc_id"], row["h"], len(raw), sum(b - a for a, b in spans), len(spans), kept.hexdigest(), [{"start": a, "stop": b} for a, b in spans]))
            columns = list(zip(*out, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "h", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"])


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the removed spans of bytes."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    smallest = F.lit(-(1 << 63)).cast("long")
    rows = docs.select(F.coalesce(F.col(doc_id).cast("long"), smallest).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("h"), F.col(text).alias("text"))
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    buckets = max(4, parts // 2, -(-size // SETTLED))
    dealt = rows.mapInArrow(partial(_deal, buckets=buckets, spread=SPREAD), "bucket int, kind int, docs binary, anchors binary")
    found = stored(dealt.repartitionById(buckets, F.col("bucket")).mapInArrow(_settle, FOUND))
    packed = rows.mapInArrow(_zip, "doc_id long, h long, z binary")
    open_ = found.filter("not settled").groupBy("doc_id", "h").agg(F.collect_set(F.struct("key", "pos", "lo", "hi")).alias("open"))
    once = packed.dropDuplicates(["doc_id", "h"])
    sides = stored(once.join(open_, ["doc_id", "h"]).mapInArrow(_sides, SIDES))
    large = sides.groupBy("key").agg(F.sum(F.octet_length("bytes")).alias("size")).filter(F.col("size") > GROUP).orderBy(F.desc("size")).limit(HOT_KEYS).select("key")
    few = sides.join(F.broadcast(large), "key", "left_anti")
    refined = few.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(_refine, SPANS)
    if not large.isEmpty():
        many = stored(sides.join(F.broadcast(large), "key").select(*sides.columns).mapInArrow(_strings, STRINGS))
        first = many.groupBy("string").agg(F.min(F.struct("doc_id", "h", "start")).alias("first"))
        later = meet(many, first, "string").filter(F.struct("doc_id", "h", "start") != F.col("first"))
        refined = refined.unionByName(later.select("doc_id", "h", "start", (F.col("start") + LENGTH).alias("stop")))
    settled = found.filter("settled").select("doc_id", "h", (F.col("pos") - F.col("hi")).alias("start"), (F.col("pos") - F.col("lo") + LENGTH).alias("stop"))
    spans = settled.unionByName(refined).groupBy("doc_id", "h").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    out = packed.join(spans, ["doc_id", "h"], "left").mapInArrow(_cut, RESULT)
    return out.withColumn("doc_id", F.nullif("doc_id", smallest)).drop("h")


def query(spark, sf_dir: str) -> DataFrame:
    """All ``documents``."""
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("removed")
