"""Mixing sources to target weights, by blocks of words.

Sources, in code point order and null last, have weights; together they are to
give ``share`` of all words, but none more than ``most`` times its own: what a
source cannot give is shared anew by the weights of the others.

Within each source the documents stand in an order of hashes, end to end, and
are cut into blocks of ``block`` words, so a document may lie in several blocks
and a block hold several documents. An output shard has a fixed number of slots.
The numbers of slots of the sources in each shard are drawn from multinomials
of what the sources owe, by halving the shards again and again, so that shares
hold in every shard up to chance and the totals exactly. A source's slots run through a pseudorandom permutation
of its block numbers (a keyed Feistel network that walks in cycles until it is in
range), one for each pass, and slots and blocks are joined by source and number.
The last slot of a source is cut to the words that are still owed, so a source
gives its target, rounded to a word, and no document goes in more often than
there are passes.

Word offsets are sums within hash buckets of a source on top of sums of buckets,
so that a source of any size is never gathered. The driver holds one line for
each source, of which there are ``SOURCES`` at most; the shards' counts are drawn
in the tasks.

Defined cases: a null text has no words and is never taken; a null source is a
source of its own; a source without words has the target 0; rows that repeat an
id, or all columns, are documents of their own (equal rows come to one task); an
id or source may be of any type; an empty table gives no rows; the same rows give
the same mix, however they are dealt out. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import mixed, pieces, stored, tidy

#: Weights of the query's sources, in turn, the share of all words that they give, and how often a word may be given.
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
#: Words in a block, slots in a shard, rows of a bucket, buckets of a source at most.
BLOCK, SLOTS, BUCKET_ROWS, BUCKETS = 128, 1 << 16, 1000, 4096
#: Sources that a mix may have. The driver and every task hold a line for each.
SOURCES = 100_000


def targets(sizes: list[int], weights: list[float], share: float = SHARE, most: float = MOST) -> list[float]:
    """Words that each source is to give."""
    out: list[float | None] = [None if s > 0 else 0.0 for s in sizes]
    total = share * sum(sizes)
    while True:
        left = total - sum(x for x in out if x is not None)
        free = [i for i, x in enumerate(out) if x is None]
        weight = sum(weights[i] for i in free)
        given = {i: left * weights[i] / weight for i in free}
        over = [i for i in free if given[i] > most * sizes[i]]
        if not over:
            return [given.get(i, x) for i, x in enumerate(out)]
        for i in over:
            out[i] = float(most * sizes[i])


def _halves(n: int) -> tuple[np.uint64, np.uint64]:
    bits = max(1, (max(2, n) - 1).bit_length() + 1 >> 1)
    return np.uint64(bits), np.uint64((1 << bits) - 1)


def permuted(i: np.ndarray, n: int, key: int, back: bool = False) -> np.ndarray:
    """The places of ``i`` under the permutation of range(n) that ``key`` names; ``back``: under its inverse."""
    bits, mask = _halves(n)
    keys = mixed(np.uint64(key) + np.arange(1, 5, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    out = i.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> bits, out[todo] & mask
        for k in keys[::-1] if back else keys:
            if back:
                left, right = right ^ (mixed(left + k) & mask), left
            else:
                left, right = right, left ^ (mixed(right + k) & mask)
        out[todo] = left << bits | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def _key(seed: int, source: int, pass_: int) -> int:
    return int(mixed(np.array([seed * 1_000_003 + source * 31 + pass_], np.uint64))[0])


def ledger(sizes: list[int], wanted: list[float], block: int, seed: int) -> list[dict]:
    """For each source its blocks and words, the slots that give its target, and the words of the last one if that is cut."""
    lines = []
    for s, (size, target) in enumerate(zip(sizes, wanted, strict=True)):
        n, give = -(-size // block), round(target)
        passes, rest = divmod(give, size) if size else (0, 0)
        count, last = passes * n, block
        if rest:
            tail = size - block * (n - 1)
            tail_at = int(permuted(np.array([n - 1]), n, _key(seed, s, passes), back=True)[0])
            k = -(-rest // block)
            if block * k - (block - tail) * (tail_at < k) < rest:
                k += 1
            before = block * (k - 1) - (block - tail) * (tail_at < k - 1)
            count, last = count + k, rest - before
        lines.append({"blocks": n, "size": size, "slots": count, "last": last, "cut": bool(rest)})
    return lines


def _drawn(owed: np.ndarray, room: int, rng: np.random.Generator) -> np.ndarray:
    """``room`` slots from a multinomial of what is owed; what a source cannot give is drawn anew from the others."""
    drawn = np.zeros_like(owed)
    while (short := room - int(drawn.sum())) > 0:
        left = owed - drawn
        drawn += np.minimum(rng.multinomial(short, left / left.sum()), left)
    return drawn


def shard_counts(owed: np.ndarray, slots: int, seed: int, begin: int, end: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For the shards from ``begin`` to ``end``: (shard, first slot number of each source, slots of each source).

    Shards are halved again and again, and the slots of the left half are drawn
    from a multinomial of what the sources owe in both, by a generator that the
    place of the halving names. So the counts of all shards add up to what is
    owed, and any task finds those of its shards alone.
    """

    def walk(low: int, high: int, at: np.ndarray, owed: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        if high <= begin or low >= end:
            return
        if high - low == 1:
            yield low, at, owed
            return
        middle = (low + high) // 2
        left = _drawn(owed, (middle - low) * slots, np.random.default_rng([seed, low, high]))
        yield from walk(low, middle, at, left)
        yield from walk(middle, high, at + left, owed - left)

    shards = -(-int(owed.sum()) // slots)
    if shards:
        yield from walk(0, shards, np.zeros_like(owed), owed)


SLOT = "shard int, source int, pass int, block long, words long"


@tidy
def _fill(batches: Iterator[pa.RecordBatch], lines: list[dict], block: int, slots: int, seed: int) -> Iterator[pa.RecordBatch]:
    """The block and the words of each slot of some shards."""
    owed = np.array([x["slots"] for x in lines], np.int64)
    for batch in batches:
        for shard_ in batch.column("id").to_pylist():
            for shard, first, count in shard_counts(owed, slots, seed, shard_, shard_ + 1):
                for s in np.flatnonzero(count).tolist():
                    line = lines[s]
                    for at in range(first[s], first[s] + count[s], 100_000):
                        j = np.arange(at, min(at + 100_000, first[s] + count[s]))
                        pass_, i = np.divmod(j, line["blocks"])
                        number = np.empty(len(j), np.int64)
                        for p in np.unique(pass_):
                            number[pass_ == p] = permuted(i[pass_ == p], line["blocks"], _key(seed, s, int(p)))
                        words = np.minimum(block, line["size"] - number * block)
                        if line["cut"]:
                            words[j == line["slots"] - 1] = line["last"]
                        n = len(j)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, shard, np.int32)), pa.array(np.full(n, s, np.int32)), pa.array(pass_.astype(np.int32)), pa.array(number), pa.array(words)], ["shard", "source", "pass", "block", "words"])


def _placed(docs: DataFrame, doc_id: str, text: str, source: str, weights, share: float, most: float, seed: int) -> tuple[DataFrame, list[int], list[float]]:
    """Each row with its source's number and its first word's offset there; sizes and targets of the sources."""
    spark = docs.sparkSession
    h = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    size = F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    rows = stored(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("name"), size.alias("size"), h.alias("h")).withColumn("r", F.xxhash64(F.lit(seed), "doc_id", "h")))
    stats = rows.groupBy("name").agg(F.sum("size").alias("size"), F.count("*").alias("n")).limit(SOURCES + 1).collect()
    if len(stats) > SOURCES:
        raise ValueError(f"a mix has at most {SOURCES} sources")
    stats.sort(key=lambda x: (x["name"] is None, x["name"] or ""))
    sizes = [x["size"] for x in stats]
    wanted = targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))], share, most)
    named = spark.createDataFrame([(x["name"], i, x["size"], t) for i, (x, t) in enumerate(zip(stats, wanted, strict=True))], f"name {rows.schema['name'].dataType.simpleString()}, source int, source_size long, target double")
    n = min(BUCKETS, max(1, -(-sum(x["n"] for x in stats) // BUCKET_ROWS)))
    rows = rows.join(F.broadcast(named), rows["name"].eqNullSafe(named["name"])).drop(named["name"]).withColumn("bucket", F.pmod("r", F.lit(n)).cast("int"))
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    ahead = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("source", "bucket", F.coalesce(F.sum("words").over(ahead), F.lit(0)).alias("base"))
    inside = Window.partitionBy("source", "bucket").orderBy("r", "h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(bases, ["source", "bucket"])
    return placed.select("doc_id", "h", "name", "source", "size", "source_size", "target", (F.col("base") + F.col("inside")).alias("start")), sizes, wanted


def mixed_pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS, share: float = SHARE, most: float = MOST, block: int = BLOCK, slots: int = SLOTS, seed: int = 1) -> DataFrame:
    """The mix: a row for each document's part of each slot, and one without slot for each part that is in no slot.

    doc_id, h (of the text), name (of the source), source (number), start, size, source_size, target,
    shard, pass, block, from (the part's first word in the document) and words.
    """
    spark = docs.sparkSession
    placed, sizes, wanted = _placed(docs, doc_id, text, source, weights, share, most, seed)
    lines = ledger(sizes, wanted, block, seed)
    shards = -(-sum(x["slots"] for x in lines) // slots)
    filled = spark.range(0, shards, 1, max(1, min(shards, 4096))).mapInArrow(partial(_fill, lines=lines, block=block, slots=slots, seed=seed), SLOT)
    numbers = F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.greatest("size", F.lit(1)) - 1) / block))
    parts = placed.withColumn("block", F.explode_outer(F.when(F.col("size") > 0, numbers)))
    inside = parts.withColumns({"low": F.greatest(F.col("start") - F.col("block") * block, F.lit(0)), "high": F.least(F.col("start") + F.col("size") - F.col("block") * block, F.lit(block))})
    met = inside.join(filled.hint("shuffle_merge"), ["source", "block"], "left").withColumn("words", F.greatest(F.least("high", F.coalesce("words", F.lit(0))) - F.col("low"), F.lit(0)))
    return met.withColumn("from", F.col("low") + F.col("block") * block - F.col("start")).drop("low", "high")


def digest(docs: DataFrame, **how) -> DataFrame:
    """Every row of ``docs``: doc_id, size, source_size, target (of its source), taken (words of it in the mix)."""
    keys = ["source", "start", "doc_id", "h", "size", "source_size", "target"]
    met = mixed_pieces(docs, **how)
    some = met.filter("size > 0").groupBy(keys).agg(F.sum("words").alias("taken"))
    none = met.filter("size = 0").select(*keys, F.lit(0).cast("long").alias("taken"))
    return some.unionByName(none).select("doc_id", "size", "source_size", "target", "taken")


_word = re.compile(r"[^\x20\x09-\x0D]+")


def cut_text(text: str, parts: list[tuple[int, int]]) -> str:
    """The text of some runs of words (first, count); all of it if they are all of it."""
    spans = [m.span() for m in _word.finditer(text)]
    merged: list[list[int]] = []
    for first, count in sorted(parts):
        if merged and merged[-1][1] == first:
            merged[-1][1] += count
        else:
            merged.append([first, first + count])
    if merged == [[0, len(spans)]]:
        return text
    return "\n".join(text[spans[a][0] : spans[b - 1][1]] for a, b in merged)


@tidy
def _texts(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = batch.schema.field("row").type.get_field_index(text)
        named = pa.RecordBatch.from_arrays([batch.column("row"), batch.column("parts"), batch.column("row").flatten()[at]], ["row", "parts", "text"])
        for some in pieces([named], "text"):
            made = [cut_text(t, [(p["from"], p["words"]) for p in parts]) for t, parts in zip(some.column("text").to_pylist(), some.column("parts").to_pylist(), strict=True)]
            arrays = some.column("row").flatten()
            arrays[at] = pa.array(made, pa.string())
            yield pa.RecordBatch.from_arrays(arrays, [f.name for f in some.schema.field("row").type])


def _hash_of_row(docs: DataFrame):
    """xxhash64 does not take maps."""
    return F.xxhash64(*[F.to_json(F.struct(F.col(f"`{f.name}`"))) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in docs.schema])


def mixed_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """The mix as rows like ``docs``: one for each pass in which words of a row are taken, with these words as its text.

    Rows are told apart by id, text and source, and those that repeat all three
    by their number among these, in the order of a hash of the whole row, so
    every row gives the words that ``digest`` says. Columns of any name are kept.
    """
    name = F.struct(F.col(source).alias("s"), F.col(doc_id).alias("i"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("h"))
    met = mixed_pieces(docs, doc_id, text, source, **how).filter("words > 0")
    takes = met.groupBy(F.struct(F.col("name").alias("s"), F.col("doc_id").alias("i"), "h").alias("key"), "start", "pass").agg(F.collect_list(F.struct("from", "words")).alias("parts"))
    takes = takes.withColumn("nth", F.dense_rank().over(Window.partitionBy("key").orderBy("start"))).drop("start", "pass")
    rows = docs.select(F.struct("*").alias("row"), name.alias("key"), _hash_of_row(docs).alias("g"))
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("key").orderBy("g"))).drop("g")
    return rows.join(takes, ["key", "nth"]).select("row", "parts").mapInArrow(partial(_texts, text=text), docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    """All ``documents``."""
    return digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))
