"""Best-fit packing: as few sequences of bounded length as a corpus of token ids can fill.

Documents are cut into pieces of at most ``size`` ids, and pieces are packed by
patterns: a pattern is a handful of lengths, a plan says how often each pattern
is used. A plan depends on the histogram of lengths alone, so making it takes the
same time and memory for any number of documents:

1. Patterns of two and three lengths that fill a sequence exactly are enumerated,
   as far as the histogram has their lengths.
2. Counts are fitted to the histogram by non-negative least squares: in each round
   patterns that share no length, those of largest gradient first, are set to
   their optimum, which is exact coordinate descent. Few counts become positive.
3. Counts are rounded, the largest first, and never beyond what is left.
4. What is left of the histogram goes to the fullest sequence that has room, the
   longest first, for all pieces of a length at a time.

Tasks encode the texts and number the pieces of each length as they meet them.
Numbers of the tasks before are added by a join on (task, length), both of which
a row has by itself, so copies of one document meet no more rows than their task
has. A piece's number within its length gives its sequence and place by binary
search in the plan, which is broadcast: it has a few rows for each length,
whatever the number of pieces.

Defined cases: a null or empty text is the end id alone; null ids and rows that
repeat keep a row each (their pieces are packed like others); an empty table
gives no rows. Other columns are not read, so their names may clash. A text of
any length is read whole and cut.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import pieces, stored, tidy
from .token_output import default_tokenizer, encoder

SIZE = 2048
#: Rounds of the fit at most, and the share of a length's count that one more round has to move.
ROUNDS, STILL = 150, 1e-3
#: Weight of a residual of a length of a whole sequence; it falls with the length, as short pieces find room anywhere.
LONG_WEIGHT = 4.0


class Slots(NamedTuple):
    """Where pieces go. Rows are ordered by ``length`` and ``first``, the number of a length's first piece: piece ``first + i``
    goes to sequence ``sequence + i // copies``, at ``offset + (i % copies) * length``."""

    length: np.ndarray
    first: np.ndarray
    sequence: np.ndarray
    copies: np.ndarray
    offset: np.ndarray


def patterns(lengths: np.ndarray, size: int) -> np.ndarray:
    """All ways to fill a sequence with two or three of ``lengths``, as rows of descending lengths (0 for none)."""
    there = np.zeros(size + 1, bool)
    there[lengths] = True
    two = lengths[(lengths >= size - lengths) & there[size - lengths]]
    out = [np.stack([two, size - two, np.zeros_like(two)], 1)]
    for longest in lengths[(3 * lengths >= size) & (lengths < size)].tolist():
        second = lengths[(lengths <= longest) & (2 * lengths >= size - longest) & (lengths < size - longest)]
        second = second[there[size - longest - second]]
        out.append(np.stack([np.full_like(second, longest), second, size - longest - second], 1))
    return np.concatenate(out)


def fit(made: np.ndarray, counts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Non-negative counts of patterns whose pieces come nearest to ``counts`` (by length) in weighted least squares."""
    x, left, weights = np.zeros(len(made)), counts.astype(float), weights * (np.arange(len(counts)) > 0)
    if not len(made):
        return x
    # how often a pattern has each of its lengths, once for each distinct one
    times = np.ones(made.shape)
    times[made[:, 1] == made[:, 0], 0] += 1
    times[made[:, 1] == made[:, 0], 1] = 0
    same = made[:, 2] == made[:, 1]
    times[same & (times[:, 1] > 0), 1] += 1
    times[same & (times[:, 1] == 0), 0] += 1
    times[same, 2] = 0
    times[made == 0] = 0
    made = np.where(times > 0, made, 0)
    norm = (times**2 * weights[made]).sum(1)
    enough = STILL * counts.sum() / max(1, (counts > 0).sum())
    for _ in range(ROUNDS):
        gain = (times * weights[made] * left[made]).sum(1)
        step = np.maximum(gain / norm, -x)
        worth = step**2 * norm
        some = np.argsort(-worth)[: 8 * len(counts)]
        taken, moved = np.zeros(len(counts), bool), 0.0
        for p, lengths in zip(some.tolist(), made[some].tolist(), strict=True):
            if abs(step[p]) <= enough * 1e-3 or taken[lengths[0]] or taken[lengths[1]] or (lengths[2] and taken[lengths[2]]):
                continue
            taken[lengths] = True
            taken[0] = False
            x[p] += step[p]
            left[lengths] -= times[p] * step[p]
            moved = max(moved, abs(step[p]))
        if moved <= enough:
            break
    return x


class _Plan:
    """Sequences that are alike, in groups: a list of (length, copies), the room left and how many there are."""

    def __init__(self, counts: np.ndarray, size: int):
        self.left, self.size = counts.astype(np.int64), size
        self.closed: list[tuple[list[tuple[int, int]], int]] = []
        self.open: dict[int, list[tuple[list[tuple[int, int]], int]]] = defaultdict(list)

    def use(self, lengths: list[int], n: int) -> None:
        kinds = sorted(set(lengths), reverse=True)
        n = min([n, *(int(self.left[k]) // lengths.count(k) for k in kinds)])
        if n > 0:
            for k in kinds:
                self.left[k] -= n * lengths.count(k)
            self._keep([(k, lengths.count(k)) for k in kinds], self.size - sum(lengths), n)

    def _keep(self, held: list[tuple[int, int]], room: int, n: int) -> None:
        if n:
            (self.open[room] if room else self.closed).append((held, n))

    def _fill(self, held: list[tuple[int, int]], room: int, n: int, length: int) -> None:
        """Puts what is left of a length into ``n`` alike sequences, as much as each takes."""
        most = room // length
        full, rest = divmod(min(int(self.left[length]), n * most), most)
        self.left[length] -= full * most + rest
        self._keep([*held, (length, most)], room - most * length, full)
        if rest:
            self._keep([*held, (length, rest)], room - rest * length, 1)
        self._keep(held, room, n - full - (rest > 0))

    def best_fit(self) -> None:
        """The longest pieces first, each length into the least room that takes it, else into new sequences."""
        for length in np.flatnonzero(self.left)[::-1].tolist():
            while self.left[length]:
                rooms = [room for room, groups in self.open.items() if room >= length and groups]
                if rooms:
                    room = min(rooms)
                    held, n = self.open[room].pop()
                    self._fill(held, room, n, length)
                else:
                    self._fill([], self.size, math.ceil(int(self.left[length]) / (self.size // length)), length)

    def slots(self) -> Slots:
        used, rows, sequence = defaultdict(int), [], 0
        for held, n in [*self.closed, *(g for room in sorted(self.open) for g in self.open[room])]:
            offset = 0
            for length, copies in held:
                rows.append((length, used[length], sequence, copies, offset))
                used[length] += n * copies
                offset += length * copies
            sequence += n
        rows.sort()
        return Slots(*(np.array(x, np.int64) for x in zip(*rows, strict=True))) if rows else Slots(*(np.zeros(0, np.int64) for _ in range(5)))


def plan(counts: np.ndarray, size: int = SIZE) -> Slots:
    """Places for ``counts[n]`` pieces of each length n."""
    out = _Plan(counts, size)
    made = patterns(np.flatnonzero(counts[:size]), size)
    x = fit(made, np.append(counts[:size], 0), 1 + (LONG_WEIGHT - 1) * np.arange(size + 1) / size)
    for p in np.argsort(-x, kind="stable").tolist():
        if x[p] < 0.5:
            break
        out.use([k for k in made[p].tolist() if k], round(x[p]))
    out.best_fit()
    return out.slots()


PIECES = "doc_id long, piece int, start long, length int, ids binary, task long, nth long"
_pieces = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int32()), ("ids", pa.binary()), ("task", pa.int64()), ("nth", pa.int64())])


@tidy
def _cut(batches: Iterator[pa.RecordBatch], tokenizer: str, end_id: int, size: int) -> Iterator[pa.RecordBatch]:
    task, seen, enc = TaskContext.get().partitionId(), np.zeros(size + 1, np.int64), None
    for batch in pieces(batches, "text"):
        if not batch.num_rows:
            continue
        enc = enc or encoder(tokenizer)
        raw = enc.encode(batch.column("text"), end_id)
        tokens = np.fromiter(map(len, raw), np.int64, len(raw)) // enc.width.itemsize
        n = -(-tokens // size)
        row = np.repeat(np.arange(len(raw)), n)
        piece = np.arange(len(row)) - (np.cumsum(n) - n)[row]
        length = np.minimum(tokens[row] - piece * size, size)
        # pieces stand in the order of their texts, so their ids do too
        ids = np.frombuffer(b"".join(raw), enc.width).astype("<u4")
        offsets = np.append(0, np.cumsum(length) * 4).astype(np.int64)
        ids = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(row), [None, pa.py_buffer(offsets), pa.py_buffer(ids)]).cast(pa.binary())
        order = np.argsort(length, kind="stable")
        by = length[order]
        first = np.flatnonzero(np.append(True, by[1:] != by[:-1]))
        nth = np.empty(len(row), np.int64)
        nth[order] = seen[by] + np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row))))
        seen += np.bincount(length, minlength=size + 1)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(piece * size), pa.array(length.astype(np.int32)), ids, pa.array(np.full(len(row), task)), pa.array(nth)], schema=_pieces)


def cut(docs: DataFrame, tokenizer: str, end_id: int = 0, size: int = SIZE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A stored table of pieces: doc_id, piece, start, length, ids (unsigned 32-bit little-endian numbers), and the number ``nth`` of a piece of this length in its ``task``."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return stored(rows.mapInArrow(partial(_cut, tokenizer=tokenizer, end_id=end_id, size=size), PIECES))


def _place(batches: Iterator[pa.RecordBatch], slots: Slots) -> Iterator[pa.RecordBatch]:
    key = slots.length << 48 | slots.first  # ordered, as rows are
    for batch in batches:
        length, number = (batch.column(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in ("length", "_number"))
        at = np.searchsorted(key, length << 48 | number, side="right") - 1
        i = number - slots.first[at]
        out = batch.drop_columns(["_number"])
        sequence, offset = slots.sequence[at] + i // slots.copies[at], slots.offset[at] + i % slots.copies[at] * length
        yield pa.RecordBatch.from_arrays([*out.columns, pa.array(sequence), pa.array(offset)], [*out.schema.names, "sequence_id", "offset"])


def pack(cuts: DataFrame, size: int = SIZE) -> DataFrame:
    """The rows of ``cuts`` with sequence_id and offset. Read: length, and (task, nth), a piece's number among those of its length in its task; a stored table."""
    counts = cuts.groupBy("task", "length").agg(F.count("*").alias("n"))
    held = np.zeros(size + 1, np.int64)
    for length, n in counts.groupBy("length").agg(F.sum("n")).collect():  # at most ``size`` rows
        held[length] = n
    before = counts.select("task", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")).alias("_before"))
    other = [c for c in cuts.columns if c not in ("task", "nth")]
    numbered = cuts.join(before, ["task", "length"]).select(*other, (F.col("nth") + F.col("_before")).alias("_number"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in numbered.drop("_number").schema)
    return numbered.mapInArrow(partial(_place, slots=plan(held, size)), f"{schema}, sequence_id long, offset long")


def sequences(docs: DataFrame, tokenizer: str, end_id: int = 0, size: int = SIZE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The packed sequences: sequence_id, ids (unsigned 32-bit little-endian numbers) and parts (offset, length, doc_id, piece), in order. A sequence is ``size`` ids at most."""
    packed = pack(cut(docs, tokenizer, end_id, size, doc_id, text), size)
    parts = F.array_sort(F.collect_list(F.struct("offset", "length", "doc_id", "piece", "ids")))
    joined = F.aggregate("parts", F.lit(b""), lambda held, part: F.concat(held, part["ids"]))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select("sequence_id", joined.alias("ids"), F.transform("parts", lambda p: F.struct(p["offset"], p["length"], p["doc_id"], p["piece"])).alias("parts"))


def query(spark, sf_dir: str) -> DataFrame:
    """All ``documents``, packed: a row for each piece."""
    cuts = cut(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_tokenizer())
    digests = cuts.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), F.crc32("ids").alias("ids_crc32"), "task", "nth")
    return pack(digests)
