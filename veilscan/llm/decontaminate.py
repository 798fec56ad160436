"""Benchmark decontamination by greedy string tiling.

Texts are words without case (A-Z) and without punctuation at their ends. A
document and a benchmark item are compared if they share seeds, runs of
``SEED`` words (the whole item if it has fewer), that cover enough of the item
to reach the threshold, as every tile is made of seeds. Then the item is tiled:
running Karp-Rabin hashes find the longest matches of words that no tile has
yet, these are compared and marked, and the search goes on below their length
down to ``SEED``. Its time does not depend on how often words repeat. An item of which tiles cover ``threshold`` of the words is in the
document, in whatever order its passages stand.

The benchmark is the stated query set: it goes to all tasks in blocks of at most
``BLOCK_SEEDS`` words (or one item, if that is longer), 32 bytes each. A larger
benchmark takes a pass over the documents for each block; what a pass gives is
written before the next one starts, and its block is given back.

Defined cases: null and empty texts hold nothing, and items without words are in
no document; rows that repeat an id are judged each by its text; ids are integers, or strings
that are read as such; items that
repeat each count; an empty benchmark finds nothing. In ``found`` the named
columns alone are read; ``clean`` keeps all columns.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, discard, pieces, shingle_hashes, stored, tidy

SEED, THRESHOLD, BLOCK_SEEDS = 5, 0.6, 1_000_000
_punctuation = bytes(c for c in range(33, 127) if not chr(c).isalnum())
#: An odd number and its inverse modulo 2^64.
_base = 0x9E3779B97F4A7C15
_back = pow(_base, -1, 1 << 64)


class _Words(WordHashes):
    """Hashes of words without punctuation at their ends; 0 for those that are nothing else."""

    def __missing__(self, word: bytes) -> int:
        bare = word.strip(_punctuation)
        out = super().__missing__(bare) if bare else 0
        self[word] = out
        return out


def word_ids(text: str | None, known: _Words) -> np.ndarray:
    ids = known.of((text or "").encode("utf-8", "surrogatepass").lower().split())
    return ids[ids != 0]


class Running:
    """Karp-Rabin hashes of all runs of words of any length.

    The words go into one running sum, each times a power of a fixed odd number;
    a run's hash is what the sum gains over it, times the power that moves its
    first word to the front. Numbers wrap at 64 bits, where odd ones have inverses.
    """

    def __init__(self, words: np.ndarray):
        n = len(words)
        self.power, back = np.full(n, _base, np.uint64), np.full(n, _back, np.uint64)
        self.power[:1] = back[:1] = 1
        self.power, back = np.multiply.accumulate(self.power), np.multiply.accumulate(back)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * back, dtype=np.uint64)])
        self.marks = np.zeros(n + 1, np.int64)  # marked words before each place

    def mark(self, at: int, size: int) -> None:
        self.marks[at + 1 :] += np.minimum(np.arange(1, len(self.marks) - at), size)

    def free(self, s: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of the runs of ``s`` words without a mark, and their hashes."""
        at = np.flatnonzero(self.marks[s:] == self.marks[: len(self.marks) - s])
        return at, (self.sums[at + s] - self.sums[at]) * self.power[at]


def tiles(item: np.ndarray, text: np.ndarray, least: int = SEED) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (place in the item, place in the text, length), longest first, none overlapping; of equally long ones the first in the item, then in the text.

    The length of the longest match is searched by halves, as a match holds
    shorter ones, and then all matches of this length are marked. A search takes
    time in proportion to both lengths whatever they repeat, and there are no
    more of them than tiles of different length, which all lie in the item.
    """
    item, text = np.asarray(item, np.uint64), np.asarray(text, np.uint64)
    mine, other, out = Running(item), Running(text), []
    most = min(len(item), len(text))

    def met(s: int) -> bool:
        a, b = mine.free(s)[1], other.free(s)[1]
        return len(a) > 0 and len(b) > 0 and bool(np.isin(a, b).any())

    while most >= least and met(least):
        low, high = least, most
        while low < high:
            s = (low + high + 1) // 2
            low, high = (s, high) if met(s) else (low, s - 1)
        places, hashes = mine.free(low)
        theirs, others = other.free(low)
        order = np.argsort(others, kind="stable")
        others, end = others[order], 0
        first, last = (np.searchsorted(others, hashes, side=side) for side in ("left", "right"))
        for i in np.flatnonzero(first < last).tolist():
            p = int(places[i])
            if p < end:  # in the tile before
                continue
            at = theirs[order[first[i] : last[i]]]
            at = at[other.marks[at + low] == other.marks[at]]
            t = next((int(t) for t in at if np.array_equal(item[p : p + low], text[t : t + low])), None)
            if t is not None:
                mine.mark(p, low)
                other.mark(t, low)
                out.append((p, t, low))
                end = p + low
        most = low - 1
    return out


class Items:
    """Benchmark items of one block with an index of their seeds."""

    def __init__(self, rows: list[tuple], threshold: float):
        known = _Words()
        self.threshold, self.ids, self.words = threshold, [], []
        seeds, owner, place, size = [], [], [], []
        for key, text in rows:
            words = word_ids(text, known)
            if not len(words):
                continue
            k = min(SEED, len(words))
            s = shingle_hashes(words, k)
            seeds.append(s)
            owner.append(np.full(len(s), len(self.ids)))
            place.append(np.arange(len(s)))
            size.append(k)
            self.ids.append(key)
            self.words.append(words)
        self.lengths = sorted(set(size))
        none = np.zeros(0, np.int64)
        seeds, owner, place = (np.concatenate(x) if x else none for x in (seeds, owner, place))
        order = np.argsort(seeds, kind="stable")
        self.seeds, self.owner, self.place = seeds[order].astype(np.uint64), owner[order], place[order]

    def of(self, words: np.ndarray) -> list[dict]:
        """The items in a text of these words."""
        covered: dict[int, set] = defaultdict(set)
        for k in self.lengths:
            if len(words) < k:
                continue
            s = shingle_hashes(words, k)
            low = np.searchsorted(self.seeds, s)
            at = np.minimum(low, len(self.seeds) - 1)
            for seed in set(s[self.seeds[at] == s].tolist()):
                first = int(np.searchsorted(self.seeds, np.uint64(seed)))
                last = int(np.searchsorted(self.seeds, np.uint64(seed), side="right"))
                for i in range(first, last):
                    covered[int(self.owner[i])].update(range(int(self.place[i]), int(self.place[i]) + k))
        out = []
        for i in sorted(covered):
            item = self.words[i]
            if len(covered[i]) < self.threshold * len(item):
                continue
            found = tiles(item, words, min(SEED, len(item)))
            count = sum(k for _, _, k in found)
            if count >= self.threshold * len(item):
                out.append({"item_id": self.ids[i], "n_words": len(item), "covered": count, "coverage": count / len(item), "tiles": [{"item_word": p, "doc_word": t, "n": k} for p, t, k in found]})
        return out


FOUND = "doc_id long, item_id long, n_words long, covered long, coverage double, tiles array<struct<item_word: long, doc_word: long, n: long>>"
_found = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("n_words", pa.int64()), ("covered", pa.int64()), ("coverage", pa.float64()), ("tiles", pa.list_(pa.struct([("item_word", pa.int64()), ("doc_word", pa.int64()), ("n", pa.int64())])))])


@tidy
def _find(batches: Iterator[pa.RecordBatch], items) -> Iterator[pa.RecordBatch]:
    known = _Words()
    for batch in pieces(batches, "text"):
        rows = [{"doc_id": key} | x for key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True) for x in items.value.of(word_ids(text, known))]
        yield pa.RecordBatch.from_pylist(rows, _found)


@tidy
def _keep(batches: Iterator[pa.RecordBatch], text: str, items) -> Iterator[pa.RecordBatch]:
    known = _Words()
    for batch in pieces(batches, text):
        yield batch.filter(pa.array([not items.value.of(word_ids(t, known)) for t in batch.column(text).to_pylist()], pa.bool_()))


def blocks(benchmark: DataFrame, item_id: str, text: str, threshold: float) -> Iterator[Items]:
    held, seeds = [], 0  # of one block, and the one after it
    for row in benchmark.select(F.col(item_id), F.col(text)).toLocalIterator():
        size = len((row[1] or "").split())
        if held and seeds + size > BLOCK_SEEDS:
            yield Items(held, threshold)
            held, seeds = [], 0
        held.append((row[0], row[1]))
        seeds += size
    if held:
        yield Items(held, threshold)


def _passes(benchmark: DataFrame, item_id: str, text: str, threshold: float) -> Iterator[tuple[Items, bool]]:
    """Each block, and whether it is the only one."""
    made = blocks(benchmark, item_id, text, threshold)
    block, alone = next(made, None), True
    while block is not None:
        after = next(made, None)
        alone = alone and after is None
        yield block, alone
        block = after


def found(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """A row for each document and item that it holds: doc_id, item_id, n_words (of the item), covered, coverage, tiles."""
    spark, rows = docs.sparkSession, docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    out = spark.createDataFrame([], FOUND)
    for items, alone in _passes(benchmark, item_id, item_text, threshold):
        part = rows.mapInArrow(partial(_find, items=(held := spark.sparkContext.broadcast(items))), FOUND)
        if not alone:
            part = stored(part)
            held.destroy()
        out = out.unionByName(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that hold no item."""
    for items, alone in _passes(benchmark, item_id, item_text, threshold):
        before, held = docs, docs.sparkSession.sparkContext.broadcast(items)
        docs = docs.mapInArrow(partial(_keep, text=text, items=held), docs.schema)
        if not alone:
            docs = stored(docs)
            held.destroy()
            if hasattr(before, "stored_at"):
                discard(before)
    return docs


def query(spark, sf_dir: str) -> DataFrame:
    """Documents and the items of ``benchmark`` in them, from all ``documents``."""
    return found(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("tiles")
