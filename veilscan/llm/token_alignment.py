"""Alignment of two tokenizers over a corpus: which ids of one stand where which ids of the other do, and how often.

Every text is encoded twice, by a byte-level BPE (A) and by a piece model with
byte fallback (B), with a space before it. Byte offsets at which tokens of both
end cut the tokens into groups; every token of A is linked with every token of B
of its group. A pair of ids counts the documents that hold it linked.

The pairs are counted by a cogroup of postings:

1. A task reads its texts in chunks of bounded size and writes
   postings: for each pair of the chunk the documents that hold it and how often,
   in rows of bounded length. Texts do not move.
2. The documents of each pair are added up (``heads``, a row for each distinct pair).
3. Heads and postings are shuffled by the id of A and sorted, heads first, by
   Spark's sort, which spills. A task streams them: the heads of an id give its
   counts and their maximum, then each posting gives its documents what the pair
   adds to them. Sums are combined in a buffer of bounded size before they leave.
4. What a task gives to the documents of a chunk is one row; rows are shuffled by chunk
   and summed by document. There are no more sums than postings.

An id with more than ``Limits.split`` postings is dealt out over several tasks, chunk by
chunk, and its heads go to each of them; how many, is broadcast for these ids
alone (at most one row for each id of A). A task holds the heads of one id.

Both tokenizers work unit by unit: a unit begins where a space or line feed
follows a character that is no white space. A never joins text across such a
place. B does not if no piece holds a space or line feed behind another
character, which is looked up in its vocabulary; if one does, texts are encoded
whole. Each distinct unit is encoded once in a worker, which remembers ``Limits.remembered``.

Defined cases: null and empty texts have no tokens (zeros, and '' for the
groups), and so have texts that the tokens of A or B do not give back byte for
byte; null ids and repeated rows each keep their row; an empty table gives no
rows. Other columns are not read, so their names may clash. A text of any length
is read whole; a group of p and q tokens takes time for its distinct pairs.
"""

from __future__ import annotations

import functools
import hashlib
import math
import os
import re
from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, stored, tidy



class Limits(NamedTuple):
    """What bounds memory; every choice gives the same result."""

    #: Documents of a chunk (at most 2^16), pairs with their documents after which one ends, documents in a row of postings.
    chunk: int = 1 << 15
    entries: int = 4_000_000
    row: int = 1024
    #: Postings of an id that go to one task, and of all ids that one task should get.
    split: int = 4_000_000
    task: int = 2_000_000
    #: Units that a worker remembers, and sums it holds before it gives them on.
    remembered: int = 300_000
    buffer: int = 2_000_000


#: Links of a group from which its pairs are told apart before they are written down.
LARGE = 256
#: The mark that stands for a space in a piece.
MARK = "\u2581"
_unit = re.compile(r"[ \n]\s*\S*(?:[^\S \n]\s*\S*)*")
_byte_piece = re.compile("<0x([0-9A-F]{2})>")


def byte_letters() -> dict[str, int]:
    """The letter that a byte-level vocabulary writes for each byte: printable Latin-1 stands for itself, the others follow from U+0100."""
    shown = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    others = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(others)}


class Numbers:
    """A growing array of numbers."""

    def __init__(self):
        self.held, self.n = np.zeros(1024, np.int64), 0

    def add(self, values: np.ndarray) -> None:
        if self.n + len(values) > len(self.held):
            self.held = np.concatenate([self.held[: self.n], np.zeros(max(len(values), self.n), np.int64)])
        self.held[self.n : self.n + len(values)] = values
        self.n += len(values)

    @property
    def all(self) -> np.ndarray:
        return self.held[: self.n]


class Aligner:
    """Tokens, groups and linked pairs of texts; units are remembered."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        letters = byte_letters()
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab(with_added_tokens=False).items():
            self.a_bytes[i] = bytes(letters.get(c, 0) for c in token)
        self.b_bytes = []
        names = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        for i, name in enumerate(names):
            raw = _byte_piece.fullmatch(name)
            self.b_bytes.append(bytes([int(raw[1], 16)]) if raw and self.b.is_byte(i) else name.replace(MARK, " ").encode())
        self.a_size, self.b_size = (np.array([len(x) for x in table], np.int64) for table in (self.a_bytes, self.b_bytes))
        self.space = self.b.piece_to_id(MARK)
        self.by_unit = not any(MARK in name.lstrip(MARK) or "\n" in name for name in names)
        self.names = [str(i) for i in range(max(len(self.a_bytes), len(self.b_bytes)))]
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.written: list[str] = []
        self.n_a, self.n_b, self.n_groups, self.n_links, self.bad, self.n_pairs = (Numbers() for _ in range(6))
        self.pairs, self.times = Numbers(), Numbers()

    def units(self, text: str | None) -> list[str]:
        if not text:
            return []
        return _unit.findall(" " + text) if self.by_unit else [" " + text]

    def _tokens(self, units: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        a = [x.ids for x in self.a.encode_batch_fast(units, add_special_tokens=False)]
        # B puts a space in front; a unit that begins otherwise loses it again
        b = self.b.encode([u[1:] if u[0] == " " else u for u in units], num_threads=1)
        for i, unit in enumerate(units):
            if unit[0] != " ":
                b[i] = b[i][1:]
            elif unit == " ":
                b[i] = [self.space]
        return a, b

    def _read_back(self, units: list[str], a: list[list[int]], b: list[list[int]]) -> np.ndarray:
        """Whether tokens of both give each unit back."""
        whole, raw = "".join(units).encode(), [self.a_bytes, self.b_bytes]
        if all(b"".join([table[i] for ids in tokens for i in ids]) == whole for table, tokens in zip(raw, (a, b), strict=True)):
            # the units' ends are right too if their sizes are
            size = [len(u.encode()) for u in units]
            if all([sum(map(len, map(table.__getitem__, ids))) for ids in tokens] == size for table, tokens in zip(raw, (a, b), strict=True)):
                return np.ones(len(units), bool)
        return np.array([all(b"".join(map(table.__getitem__, ids)) == unit.encode() for table, ids in zip(raw, (x, y), strict=True)) for unit, x, y in zip(units, a, b, strict=True)], bool)

    def learn(self, units: list[str]) -> None:
        """Reads new units; those with tokens are laid end to end, so that all their groups are cut at once."""
        a, b = self._tokens(units)
        good = self._read_back(units, a, b)
        if not good.all():
            a, b = ([ids if fine else [] for ids, fine in zip(tokens, good, strict=True)] for tokens in (a, b))
        n_a, n_b = (np.fromiter(map(len, tokens), np.int64, len(tokens)) for tokens in (a, b))
        flat_a, flat_b = (np.fromiter((i for ids in tokens for i in ids), np.int64) for tokens in (a, b))
        ends_a, ends_b = np.cumsum(self.a_size[flat_a]), np.cumsum(self.b_size[flat_b])
        _, last_a, last_b = np.intersect1d(ends_a, ends_b, assume_unique=True, return_indices=True)
        p, q = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
        first_a, first_b = last_a - p + 1, last_b - q + 1
        unit = np.searchsorted(np.cumsum(n_a), last_a, side="right")  # of each group; units without tokens have none
        count = lambda values=None: np.bincount(unit, values, len(units)).astype(np.int64)
        pair, times, size = self._pairs(flat_a, flat_b, first_a, first_b, p, q)
        for column, value in ((self.n_a, n_a), (self.n_b, n_b), (self.n_groups, count()), (self.n_links, count(p * q)), (self.bad, ~good), (self.n_pairs, count(size)), (self.pairs, pair), (self.times, times)):
            column.add(value)
        # a token's number, and what stands behind it: the groups' tokens of A, then those of B
        parts = np.empty(2 * (len(flat_a) + len(flat_b)), object)
        group_a, group_b = np.repeat(np.arange(len(p)), p), np.repeat(np.arange(len(q)), q)
        names = np.array(self.names, object)
        for flat, group, other, last, end in ((flat_a, group_a, first_b, last_a, "|"), (flat_b, group_b, last_a + 1, last_b, ";")):
            at = 2 * (np.arange(len(flat)) + other[group])
            behind = np.full(len(flat), ",", object)
            behind[last] = end
            parts[at], parts[at + 1] = names[flat], behind
        stops = np.cumsum(2 * (n_a + n_b)).tolist()
        parts = parts.tolist()
        begin = len(self.written)
        self.written += ["".join(parts[i : j - 1]) if j > i else "" for i, j in zip([0, *stops], stops, strict=False)]
        self.number.update(zip(units, range(begin, begin + len(units)), strict=True))

    def _pairs(self, flat_a, flat_b, first_a, first_b, p, q) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes of the linked pairs of all groups, how often each is linked, and how many codes a group has. Those of large groups are told apart."""
        size = p * q
        large = np.flatnonzero(size > LARGE)
        told = []
        for g in large.tolist():
            (x, m), (y, n) = (np.unique(flat[f : f + k], return_counts=True) for flat, f, k in ((flat_a, first_a[g], p[g]), (flat_b, first_b[g], q[g])))
            told.append(((x[:, None] * len(self.b_bytes) + y).ravel(), np.outer(m, n).ravel()))
            size[g] = len(told[-1][0])
        group = np.repeat(np.arange(len(p)), size)
        nth = np.arange(len(group)) - (np.cumsum(size) - size)[group]
        wide = q[group]
        wide[np.isin(group, large)] = 1 << 40  # read below
        pair = flat_a[first_a[group] + nth // wide] * len(self.b_bytes) + flat_b[np.minimum(first_b[group] + nth % wide, max(0, len(flat_b) - 1))]
        times = np.ones(len(pair), np.int64)
        starts = np.cumsum(size) - size
        for g, (codes, n) in zip(large.tolist(), told, strict=True):
            pair[starts[g] : starts[g] + size[g]], times[starts[g] : starts[g] + size[g]] = codes, n
        return pair, times, size

    def numbers(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The units of all texts, by number, and where each text's begin; unit numbers hold until ``forget``."""
        units, starts = [], [0]
        for text in texts:
            units += self.units(text)
            starts.append(len(units))
        known = self.number
        fresh = [u for u in dict.fromkeys(units) if u not in known]
        for at in range(0, len(fresh), 10_000):
            self.learn(fresh[at : at + 10_000])
        return np.fromiter(map(known.__getitem__, units), np.int64, len(units)), np.array(starts)

    def texts(self, units: np.ndarray, starts: np.ndarray) -> list[str]:
        """The groups of each text as ``a1,a2|b1;a3|b2,b3``; '' for one without tokens."""
        if not len(units):
            return [""] * (len(starts) - 1)
        bad, number, written = self.bad.all[units], units.tolist(), self.written
        return ["" if bad[i:j].any() else ";".join([written[u] for u in number[i:j]]) for i, j in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]

    def sums(self, units: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
        """Numbers of tokens, groups and links of each text, zero for one without tokens."""
        whole = lambda column: np.diff(np.append(0, np.cumsum(column.all[units]))[starts])
        good = whole(self.bad) == 0
        return {"good": good} | {name: whole(getattr(self, name)) * good for name in ("n_a", "n_b", "n_groups", "n_links")}

    def postings(self, units: np.ndarray, starts: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes of pairs, the texts that hold them and how often, each pair of a text once."""
        text = np.repeat(np.arange(len(good)), np.diff(starts))
        kept = good[text]
        key, n = np.unique(text[kept] * len(self.written) + units[kept], return_counts=True)
        text, unit = key // max(1, len(self.written)), key % max(1, len(self.written))
        size = self.n_pairs.all[unit]
        first = np.cumsum(self.n_pairs.all) - self.n_pairs.all
        at = np.repeat(first[unit] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        return combined(self.pairs.all[at], np.repeat(text, size), self.times.all[at] * np.repeat(n, size))


def combined(pair: np.ndarray, text: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of ``times`` by pair and text, in that order; there are at most 2^16 texts, and codes of pairs are products of two vocabularies."""
    key = pair << 16 | text
    order = np.argsort(key)
    key = key[order]
    new = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    return key[new] >> 16, key[new] & 0xFFFF, np.add.reduceat(times[order], new) if len(key) else times


@functools.lru_cache(1)
def aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


MADE = "chunk long, doc int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, a int, b int, n long, docs binary, times binary"
_sums = ("n_a", "n_b", "n_groups", "n_links")
_made = pa.schema([("chunk", pa.int64()), ("doc", pa.int32()), ("doc_id", pa.int64()), *((x, pa.int64()) for x in _sums), ("groups_sha256", pa.string()), ("a", pa.int32()), ("b", pa.int32()), ("n", pa.int64()), ("docs", pa.binary()), ("times", pa.binary())])


def _table(n: int, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(n, f.type) for f in _made], schema=_made)


def _binaries(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    offsets = np.append(0, ends * data.itemsize).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def _posted(chunk: int, held: list[tuple[np.ndarray, ...]], wide: int, row: int) -> Iterator[pa.RecordBatch]:
    pair, text, times = combined(*(np.concatenate(x) for x in zip(*held, strict=True)))
    new = np.append(True, pair[1:] != pair[:-1])
    run = np.flatnonzero(new)
    place = np.arange(len(pair)) - run[np.cumsum(new) - 1]
    starts = np.flatnonzero(place % row == 0)
    for some in np.array_split(starts, max(1, math.ceil(len(starts) / 8000))):
        low = int(some[0])
        after = np.searchsorted(starts, some[-1], side="right")
        high = int(starts[after]) if after < len(starts) else len(pair)
        ends = np.append(some[1:], high) - low
        ids = pair[some]
        n = len(some)
        yield _table(n, {"chunk": pa.array(np.full(n, chunk)), "a": pa.array((ids // wide).astype(np.int32)), "b": pa.array((ids % wide).astype(np.int32)), "n": pa.array(np.diff(np.append(0, ends))), "docs": _binaries(text[low:high].astype("<u2"), ends), "times": _binaries(times[low:high].astype("<u4"), ends)})


@tidy
def _read(batches: Iterator[pa.RecordBatch], a_path: str, b_path: str, limits: Limits) -> Iterator[pa.RecordBatch]:
    known, chunk, docs, held = None, TaskContext.get().partitionId() << 32, 0, []
    for batch in pieces(batches, "text"):
        for at in range(0, batch.num_rows, limits.chunk):
            part = batch.slice(at, limits.chunk)
            if known is None:
                known = aligner(a_path, b_path)
            if docs + part.num_rows > limits.chunk or sum(len(x[0]) for x in held) > limits.entries or len(known.number) > limits.remembered:
                if held:
                    yield from _posted(chunk, held, len(known.b_bytes), limits.row)
                chunk, docs, held = chunk + 1, 0, []
                if len(known.number) > limits.remembered:
                    known.forget()
            units, starts = known.numbers(part.column("text").to_pylist())
            sums = known.sums(units, starts)
            digests = [hashlib.sha256(x.encode()).hexdigest() if x else "" for x in known.texts(units, starts)]
            yield _table(part.num_rows, {"chunk": pa.array(np.full(part.num_rows, chunk)), "doc": pa.array(np.arange(docs, docs + part.num_rows, dtype=np.int32)), "doc_id": part.column("doc_id"), "groups_sha256": pa.array(digests, pa.string())} | {x: pa.array(sums[x]) for x in _sums})
            pair, text, times = known.postings(units, starts, sums["good"])
            if len(pair):
                held.append((pair, text + docs, times))
            docs += part.num_rows
    if held:
        yield from _posted(chunk, held, len(known.b_bytes), limits.row)


@tidy
def _written(batches: Iterator[pa.RecordBatch], a_path: str, b_path: str, limits: Limits) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text"):
        known = aligner(a_path, b_path)
        if len(known.number) > limits.remembered:
            known.forget()
        texts = known.texts(*known.numbers(batch.column("text").to_pylist()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "groups"])


GIVEN = "chunk long, docs binary, n_best binary, count_sum binary"
_given = pa.schema([("chunk", pa.int64()), ("docs", pa.binary()), ("n_best", pa.binary()), ("count_sum", pa.binary())])


class Given:
    """What documents get, added up in bounded memory. It is given on in a row for each chunk."""

    def __init__(self, most: int):
        self.most, self.held, self.n = most, [], 0

    def add(self, chunk, doc, best, total) -> bool:
        self.held.append((chunk, doc, best, total))
        self.n += len(doc)
        return self.n > self.most

    def take(self) -> Iterator[pa.RecordBatch]:
        if not self.n:
            return
        chunk, doc, best, total = (np.concatenate(x) for x in zip(*self.held, strict=True))
        self.__init__(self.most)
        order = np.lexsort((doc, chunk))
        chunk, doc = chunk[order], doc[order]
        new = np.flatnonzero(np.append(True, (chunk[1:] != chunk[:-1]) | (doc[1:] != doc[:-1])))
        best, total, chunk, doc = np.add.reduceat(best[order], new), np.add.reduceat(total[order], new), chunk[new], doc[new]
        first = np.flatnonzero(np.append(True, chunk[1:] != chunk[:-1]))
        ends = np.append(first[1:], len(chunk))
        yield pa.RecordBatch.from_arrays([pa.array(chunk[first]), _binaries(doc.astype("<u2"), ends), _binaries(best, ends), _binaries(total, ends)], schema=_given)


def _numbers(column: pa.Array, dtype: str) -> np.ndarray:
    """All numbers that the binaries of a column hold, one after another."""
    size = np.dtype(dtype).itemsize
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], dtype, (offsets[-1] - offsets[0]) // size, offsets[0])


RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"


@tidy
def _sum(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by chunk: its documents (docs null), and what they get."""
    chunk, held, sums = None, [], np.zeros((2, most), np.int64)

    def whole() -> Iterator[pa.RecordBatch]:
        for own in held:
            doc = own.column("doc").to_numpy()
            yield pa.RecordBatch.from_arrays([*(own.column(x) for x in ("doc_id", *_sums, "groups_sha256")), *(pa.array(x[doc]) for x in sums)], ["doc_id", *_sums, "groups_sha256", "n_best", "count_sum"])

    for batch in batches:
        of = batch.column("chunk").to_numpy()
        cuts = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else of
        for low, high in zip(cuts.tolist(), [*cuts[1:].tolist(), len(of)], strict=False):
            if of[low] != chunk:
                yield from whole()
                chunk, held = of[low], []
                sums[:] = 0
            part = batch.slice(low, high - low)
            own = part.column("docs").is_null()
            held.append(part.filter(own))
            given = part.filter(pc.invert(own))
            if given.num_rows:
                doc = _numbers(given.column("docs"), "<u2")
                for total, name in zip(sums, ("n_best", "count_sum"), strict=True):
                    np.add.at(total, doc, _numbers(given.column(name), "<i8"))
    yield from whole()


@tidy
def _cogroup(batches: Iterator[pa.RecordBatch], limits: Limits) -> Iterator[pa.RecordBatch]:
    """Rows sorted by a and salt, heads (without documents) first. Heads of the last id seen are carried from batch to batch."""
    keys, counts, given = np.zeros(0, np.int64), np.zeros(0, np.int64), Given(limits.buffer)
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        a, salt, b, n = (batch.column(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in ("a", "salt", "b", "n"))
        is_head = batch.column("docs").is_null().to_numpy(zero_copy_only=False)
        if (a[0], salt[0]) != last:
            keys, counts = keys[:0], counts[:0]
        # an id's parts come one after another and have equal heads, so a head may be there twice
        keys, first = np.unique(np.concatenate([keys, a[is_head] << 32 | b[is_head]]), return_index=True)
        counts = np.concatenate([counts, n[is_head]])[first]
        posted = np.flatnonzero(~is_head)
        if len(posted):
            of = keys >> 32
            new = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
            most = np.maximum.reduceat(counts, new)[np.searchsorted(of[new], of)]
            at = np.searchsorted(keys, a[posted] << 32 | b[posted])
            rows = batch.take(pa.array(posted)) if is_head.any() else batch
            size = n[posted]
            doc, times = _numbers(rows.column("docs"), "<u2").astype(np.int64), _numbers(rows.column("times"), "<u4").astype(np.int64)
            count = np.repeat(counts[at], size)
            if given.add(np.repeat(rows.column("chunk").to_numpy(), size), doc, times * np.repeat(counts[at] == most[at], size), times * count):
                yield from given.take()
        last = (a[-1], salt[-1])
        kept = keys >> 32 == a[-1]
        keys, counts = keys[kept], counts[kept]
    yield from given.take()


def _rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))


def default_tokenizers() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def groups(docs: DataFrame, a_path: str, b_path: str, doc_id: str = "doc_id", text: str = "text", limits: Limits = Limits()) -> DataFrame:
    """The groups of every document: doc_id, groups (``a1,a2|b1;a3|b2,b3``)."""
    return _rows(docs, doc_id, text).mapInArrow(partial(_written, a_path=a_path, b_path=b_path, limits=limits), "doc_id long, groups string")


def postings(docs: DataFrame, a_path: str, b_path: str, doc_id: str = "doc_id", text: str = "text", limits: Limits = Limits()) -> DataFrame:
    """A stored table of rows of two kinds: documents (a null) and the postings of a chunk's pairs."""
    return stored(_rows(docs, doc_id, text).mapInArrow(partial(_read, a_path=a_path, b_path=b_path, limits=limits), MADE))


def pair_counts(posted: DataFrame) -> DataFrame:
    """a, b, n: in how many documents each pair of ids is linked."""
    return posted.filter("a is not null").groupBy("a", "b").agg(F.sum("n").alias("n"))


def contributions(posted: DataFrame, heads: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """chunk, docs, n_best, count_sum: what the pairs of each task's ids add to documents of a chunk (numbers of 16 and 64 bits), several rows a chunk."""
    of_id = heads.groupBy("a").agg(F.sum("n").alias("n"))
    total = of_id.agg(F.sum("n")).first()[0] or 0
    salts = F.broadcast(of_id.filter(F.col("n") > limits.split).select("a", F.ceil(F.col("n") / limits.split).cast("int").alias("salts")))  # no more rows than A has ids
    parted = F.coalesce("salts", F.lit(1))
    mine = heads.join(salts, "a", "left").select("a", F.explode(F.sequence(F.lit(0), parted - 1)).alias("salt"), "b", "n", F.lit(None).cast("long").alias("chunk"), F.lit(None).cast("binary").alias("docs"), F.lit(None).cast("binary").alias("times"))
    theirs = posted.filter("a is not null").join(salts, "a", "left").select("a", F.pmod(F.hash("chunk"), parted).alias("salt"), "b", "n", "chunk", "docs", "times")
    rows = mine.unionByName(theirs).repartition(max(1, math.ceil(total / limits.task)), "a", "salt").sortWithinPartitions("a", "salt", F.col("docs").isNotNull(), "b")
    return rows.mapInArrow(partial(_cogroup, limits=limits), GIVEN)


def align(docs: DataFrame, a_path: str, b_path: str, doc_id: str = "doc_id", text: str = "text", limits: Limits = Limits()) -> DataFrame:
    """A row for each document: doc_id, n_a, n_b (tokens), n_groups, n_links, n_best (links whose pair no pair of the same id of A outnumbers),
    count_sum (of the pairs' counts, over links), groups_sha256."""
    posted = postings(docs, a_path, b_path, doc_id, text, limits)
    heads = stored(pair_counts(posted))
    own = posted.filter("a is null").select("chunk", "doc", "doc_id", *_sums, "groups_sha256")
    both = own.unionByName(contributions(posted, heads, limits), allowMissingColumns=True)
    return both.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(partial(_sum, most=limits.chunk), RESULT)


def query(spark, sf_dir: str) -> DataFrame:
    """All ``documents``, aligned."""
    return align(spark.read.parquet(f"{sf_dir}/documents.parquet"), *default_tokenizers())
