"""N-gram Jaccard join: T-occurrence search with DivideSkip.

Two documents link when 9 |A n B| >= 4 (|A| + |B|), which is a Jaccard
similarity of 0.8 or more of their sets of word shingles.

* Documents with equal sets are one class; only classes are compared.
* All tokens (hashes of shingles) have one order: those that are not known to be
  frequent by their hash, then the ``FREQUENT`` most frequent ones by their count
  (of all that ``COUNTED`` texts or more of some piece of input have).
  Any order gives the same result. A linked pair shares a token within the first
  n - ceil(0.8 n) + 1 of each set, the prefix, so only prefixes are dealt out as
  inverted lists, and lists of one class end there.
* A pair of a list is a candidate if what is left of both sets behind the token
  can reach the required overlap. A list with more candidate pairs than ``DENSE``
  for each member first compares its members to its pivot alone, the member
  nearest to the list's token; what is then in one component need not be
  compared, and all other pairs are candidates of the second round, in which a
  list is cut into parts of ``PART`` members that are compared two and two.
* Buckets of lists hold ``POSTINGS`` each, however many that makes. The list of
  a token that stands in more than ``LONG`` texts is in no bucket: its members
  are dealt out by their class, and meet its pivot by a join.
* The candidates of a query document are one T-occurrence search: the inverted
  lists of its tokens over the candidates are divided, the short ones are merged
  with a heap, and documents that can still reach the overlap are probed in the
  long ones by binary search. Searches with many candidates, or candidates with
  many tokens, go to several tasks.

The frequent tokens are the only thing that is broadcast; their number is fixed.
Tokens are 64-bit hashes, and classes are known by a 64-bit hash of their set.

Defined cases: a null text, or one without words, has no shingles and links to
nothing; with fewer than ``k`` words the whole sequence is the only shingle; a
null id is never linked; ids are integers, or strings that are read as such;
rows that repeat an id are texts of their own, each in the component of its text;
an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WordHashes, discard, meet, mixed, pieces, shingle_hashes, stored, tidy
from .components import components

#: Tokens in the frequency table, in how many documents of a piece one must stand to be counted, and the pairs a member may have in a list before pivots are used.
FREQUENT, COUNTED, DENSE = 1 << 20, 2, 4
#: Tokens that are counted together, 8 bytes each.
COUNTED_TOKENS = 4_000_000
#: Postings in a bucket, and texts from which a token's list is not gathered in one but dealt over all buckets.
POSTINGS, LONG = 400_000, 20_000
#: Members of a part of a dense list; parts are compared two and two.
PART = 256
#: Bits of the map of wanted documents that spares moving others, and candidates in one search and their tokens.
WANTED_BITS, SEARCHED, SEARCHED_TOKENS = 1 << 25, 256, 1_000_000
#: DivideSkip's weight of a long list.
MU = 0.0085


def token_sets(texts: list[str | None], k: int, known: WordHashes) -> list[np.ndarray]:
    """Distinct shingles of each text, as sorted 64-bit hashes."""
    out = []
    for text in texts:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        out.append(np.unique(shingle_hashes(known.of(words), k)) if words else np.zeros(0, np.uint64))
    return out


def class_of(tokens: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(tokens.tobytes())).view(np.int64))


def divide_skip(query: list, documents: dict, need: dict) -> dict:
    """T-occurrence search: of ``documents`` (id: sorted tokens), those that share at least ``need[id]`` tokens with ``query``, and how many."""
    lists = defaultdict(list)
    wanted = set(query)
    for key in sorted(documents):
        for token in documents[key]:
            if token in wanted:
                lists[token].append(key)
    if not lists:
        return {}
    by_length = sorted(lists.values(), key=len, reverse=True)
    least = min(need.values())
    n_long = max(0, min(len(by_length), least - 1, int(least / (MU * np.log(len(by_length[0]) + 1) + 1))))
    long, short = by_length[:n_long], by_length[n_long:]
    out, last, count = {}, None, 0

    def settle(key, count) -> None:
        t = need[key]
        if count < t - n_long:
            return
        for i, candidates in enumerate(long):
            if count + n_long - i < t:
                return
            at = bisect_left(candidates, key)
            count += at < len(candidates) and candidates[at] == key
        if count >= t:
            out[key] = count

    for key in heapq.merge(*short):
        if key == last:
            count += 1
        else:
            if last is not None:
                settle(last, count)
            last, count = key, 1
    if last is not None:
        settle(last, count)
    return out


KNOWN = "kind int, doc_id long, n long, class long, token long"


@tidy
def _known(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """A row for each document, with the hash of its text for a token, and one for each token that several texts of a piece have."""
    known, held, classes_held, size = WordHashes(200_000), [], set(), 0
    names = ["kind", "doc_id", "n", "class", "token"]

    def counted() -> pa.RecordBatch:
        """Sorts in place and copies only what repeats, as this is the most that a worker holds."""
        tokens = np.concatenate(held) if held else np.zeros(0, np.uint64)
        held.clear()
        tokens.sort()
        again = tokens[1:][tokens[1:] == tokens[:-1]]
        tokens, count = np.unique(again, return_counts=True)
        count = count + 1
        tokens, count = tokens[count >= COUNTED], count[count >= COUNTED]
        zeros = np.zeros(len(tokens), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.ones(len(tokens), np.int32)), pa.array(zeros), pa.array(count.astype(np.int64)), pa.array(zeros), pa.array(tokens.view(np.int64))], names)

    for batch in pieces(batches, "text"):
        sets = token_sets(batch.column("text").to_pylist(), k, known)
        classes = [class_of(s) if len(s) else 0 for s in sets]
        n = len(sets)
        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int32)), batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(classes, pa.int64()), batch.column("h")], names)
        for c, s in zip(classes, sets, strict=True):
            if c not in classes_held:
                classes_held.add(c)
                held.append(s)
                size += len(s)
        if size > COUNTED_TOKENS:
            yield counted()
            classes_held.clear()
            size = 0
    yield counted()


_entry = np.dtype([("t", "<u4"), ("t2", "<u2"), ("at", "<u2"), ("pos", "<u2")])
_member = np.dtype([("class", "<i8"), ("n", "<u4")])


@tidy
def _prefixes(batches: Iterator[pa.RecordBatch], k: int, frequent, buckets: int, most: int) -> Iterator[pa.RecordBatch]:
    """Postings of prefixes, for each piece and bucket of tokens; those of tokens with long lists go to buckets of classes instead."""
    known, (hot, rank) = WordHashes(200_000), frequent.value
    for batch in pieces(batches, "text"):
        sets = {class_of(s): s for s in token_sets(batch.column("text").to_pylist(), k, known) if len(s)}
        if not sets:
            continue
        tokens, owner, place, count = [], [], [], []
        for i, s in enumerate(sets.values()):
            n = len(s)
            often = np.zeros(n, np.int64)
            if len(hot):
                at = np.minimum(np.searchsorted(hot, s), len(hot) - 1)
                often = np.where(hot[at] == s, rank[at], 0)
                order = np.lexsort((s, often))
                s, often = s[order], often[order]
            size = n - (4 * n + 4) // 5 + 1
            tokens.append(s[:size])
            count.append(often[:size])
            owner.append(np.full(size, i))
            place.append(np.arange(size))
        tokens, owner, place, count = (np.concatenate(x) for x in (tokens, owner, place, count))
        members = np.array([(c, len(s)) for c, s in sets.items()], _member)
        entries = np.zeros(len(tokens), _entry)
        entries["t"], entries["t2"], entries["pos"] = tokens & np.uint64(0xFFFFFFFF), tokens >> np.uint64(32) & np.uint64(0xFFFF), np.minimum(place, 65_535)
        long = count > most
        spread = np.where(long, members["class"][owner].view(np.uint64), tokens & np.uint64(0xFFFFFFFFFFFF))
        bucket = 2 * (mixed(spread) % np.uint64(buckets)).astype(np.int64) + long
        order = np.lexsort((owner, bucket))
        rows = []
        for some in np.split(order, np.flatnonzero(np.diff(bucket[order], prepend=-1))[1:]):
            for at in range(0, len(some), 60_000):
                part = some[at : at + 60_000]
                used, local = np.unique(owner[part], return_inverse=True)
                e = entries[part]
                e["at"] = local
                rows.append({"bucket": int(bucket[part[0]]), "members": members[used].tobytes(), "entries": e.tobytes()})
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("bucket", pa.int32()), ("members", pa.binary()), ("entries", pa.binary())]))


def _possible(nx: np.ndarray, px: np.ndarray, ny: np.ndarray, py: np.ndarray) -> np.ndarray:
    """Whether a pair can reach its overlap if this is the first token that it shares."""
    return 9 * np.minimum(nx - px, ny - py) >= 4 * (nx + ny)


#: kind 0: a candidate pair (q, c) with c's size; 1: a member c of a dense list with its pivot q; 2: a member of a long list, whose pivot is not known yet.
LISTS = "kind int, q long, c long, token long, n long, pos long"
_lists = ["kind", "q", "c", "token", "n", "pos"]


def _list_rows(kind: int, q: np.ndarray | None, c: np.ndarray, token: np.ndarray | None = None, n: np.ndarray | None = None, pos: np.ndarray | None = None) -> pa.RecordBatch:
    zeros = np.zeros(len(c), np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(c), kind, np.int32)), *(pa.array((zeros if x is None else x).astype(np.int64)) for x in (q, c, token, n, pos))], _lists)


@tidy
def _lists_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidate pairs of the lists of some buckets, and the dense lists with their pivots (q). Odd buckets hold members of long lists, which go on as they are."""
    parts = []
    for batch in batches:
        for bucket, members, entries in zip(*(batch.column(c).to_pylist() for c in ("bucket", "members", "entries")), strict=True):
            e, m = np.frombuffer(entries, _entry), np.frombuffer(members, _member)
            made = (e["t"].astype(np.int64) | e["t2"].astype(np.int64) << 32, m["class"][e["at"]], m["n"][e["at"]].astype(np.int64), e["pos"].astype(np.int64))
            if bucket % 2:
                yield _list_rows(2, None, made[1], made[0], made[2], made[3])
            else:
                parts.append(made)
    if not parts:
        return
    token, cls, n, pos = (np.concatenate(x) for x in zip(*parts, strict=True))
    del parts
    same = np.sort(token)
    shared = np.unique(same[1:][same[1:] == same[:-1]])
    keep = shared[np.minimum(np.searchsorted(shared, token), max(0, len(shared) - 1))] == token if len(shared) else np.zeros(len(token), bool)
    token, cls, n, pos = (x[keep] for x in (token, cls, n, pos))
    order = np.lexsort((cls, n, pos, token))  # the pivot, nearest to the token, comes first
    token, cls, n, pos = (x[order] for x in (token, cls, n, pos))
    # copies of one class from several pieces
    seen = np.lexsort((cls, token))
    twice = np.zeros(len(token), bool)
    twice[seen[1:]] = (token[seen][1:] == token[seen][:-1]) & (cls[seen][1:] == cls[seen][:-1])
    token, cls, n, pos = (x[~twice] for x in (token, cls, n, pos))
    begin = np.flatnonzero(np.diff(token, prepend=-1))
    length = np.diff(np.append(begin, len(token)))
    pairs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def paired(x: np.ndarray, y: np.ndarray) -> None:
        """The smaller class asks."""
        swap = cls[x] > cls[y]
        x, y = np.where(swap, y, x), np.where(swap, x, y)
        pairs.append((cls[x], cls[y], n[y]))

    for m in np.unique(length):
        if m < 2:
            continue
        heads = begin[length == m]
        if m <= 2 * DENSE + 1:  # all pairs: DENSE for each member
            for i in range(m):
                for j in range(i + 1, m):
                    x, y = heads + i, heads + j
                    good = _possible(n[x], pos[x], n[y], pos[y])
                    paired(x[good], y[good])
            continue
        for head in heads:
            some = np.arange(head, head + m)
            few, found = [], 0
            for i in range(m - 1):
                x, y = head + i, some[i + 1 :]
                y = y[_possible(n[x], pos[x], n[y], pos[y])]
                few.append((np.full(len(y), x), y))
                found += len(y)
                if i and found > DENSE * m:
                    break
            if found <= DENSE * m:
                for x, y in few:
                    paired(x, y)
            else:
                x, y = few[0]  # the pivot asks
                pairs.append((cls[x], cls[y], n[y]))
                # a member too far from the token to link even with the shortest one is done with
                some = some[9 * (n[some] - pos[some]) >= 4 * (n[some] + n[some].min())]
                for at in range(0, len(some), 100_000):
                    part = some[at : at + 100_000]
                    yield _list_rows(1, np.full(len(part), cls[head]), cls[part], token[part], n[part], pos[part])
    if pairs:
        both = np.unique(np.stack([np.concatenate(x) for x in zip(*pairs, strict=True)], 1), axis=0)
        for at in range(0, len(both), 100_000):
            q, c, size = both[at : at + 100_000].T
            yield _list_rows(0, q, c, n=size)


@tidy
def _second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts of dense lists, two and two, with the label of each member: the candidate pairs with two labels, but for the pivot's."""
    held: list[np.ndarray] = []
    pairs: list[np.ndarray] = []

    def emitted() -> pa.RecordBatch:
        both = np.unique(np.concatenate(pairs), axis=0) if pairs else np.zeros((0, 3), np.int64)
        pairs.clear()
        return pa.RecordBatch.from_arrays([pa.array(x) for x in both.T.copy()], ["q", "c", "n"])

    def done(x: np.ndarray) -> None:
        _, low, high, part, q, c, n, pos, label = x
        for i in np.flatnonzero((part == low) & (c != q)):
            j = np.arange(i + 1, len(c)) if low[0] == high[0] else np.flatnonzero(part == high)
            j = j[(label[j] != label[i]) & (c[j] != q[j]) & _possible(n[i], pos[i], n[j], pos[j])]
            if len(j):
                pairs.append(np.stack([np.minimum(c[i], c[j]), np.maximum(c[i], c[j]), np.where(c[j] > c[i], n[j], n[i])], 1))

    for batch in batches:
        if not batch.num_rows:
            continue
        x = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("token", "low", "high", "part", "q", "c", "n", "pos", "label")])
        for some in np.split(x, np.flatnonzero(np.diff(x[:3]).any(axis=0)) + 1, axis=1):
            if held and (held[0][:3, 0] != some[:3, 0]).any():
                done(np.concatenate(held, axis=1))
                held = []
                if sum(map(len, pairs)) > 50_000:
                    yield emitted()
            held.append(some)
    if held:
        done(np.concatenate(held, axis=1))
    yield emitted()


@tidy
def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as packed bytes: a fraction of the size of their tokens."""
    pack = zstandard.ZstdCompressor(level=1)
    for batch in pieces(batches, "text"):
        rows = [pack.compress((t or "").encode("utf-8", "surrogatepass")) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, pa.binary())], ["doc_id", "packed"])


LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])


@tidy
def _search(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows in order of (q, block), the query's own before its candidates'."""
    query, key, found, known = [], None, [], WordHashes()
    unpack = zstandard.ZstdDecompressor()
    candidates: dict[int, list] = {}

    def done() -> None:
        if query and candidates:
            need = {c: -(-4 * (len(query) + len(t)) // 9) for c, t in candidates.items()}
            found.extend((key[0], c) for c in divide_skip(query, candidates, need))

    for batch in batches:
        for q, block, own, c, packed in zip(*(batch.column(x).to_pylist() for x in ("q", "block", "own", "c", "packed")), strict=True):
            if (q, block) != key:
                done()
                key, query, candidates = (q, block), [], {}
            got = token_sets([unpack.decompress(packed, max_output_size=1 << 31).decode("utf-8", "surrogatepass")], k, known)[0]
            if class_of(got) != c:  # a row of the same id with another text
                continue
            if own:
                query = got.tolist()
            else:
                candidates[c] = got.tolist()
        if len(found) > 10_000:
            yield pa.RecordBatch.from_pylist([{"a": a, "b": b} for a, b in found], LINK)
            found.clear()
    done()
    yield pa.RecordBatch.from_pylist([{"a": a, "b": b} for a, b in found], LINK)


def _wanted(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Drops most ``rows`` whose ``key`` is not in ``ids``, by a broadcast bitmap of ``WANTED_BITS``, before they move; keeps all whose key is there."""
    bit = F.pmod(F.xxhash64(key), F.lit(WANTED_BITS))
    part = lambda b: F.floor(b / 32_768).alias("part")
    maps = ids.select(bit.alias("b")).groupBy(part(F.col("b"))).agg(F.expr("bitmap_construct_agg(b % 32768)").alias("bits"))
    byte = F.expr("cast(conv(hex(substring(bits, cast((_b % 32768) div 8 as int) + 1, 1)), 16, 10) as int)")
    joined = rows.withColumn("_b", bit).withColumn("part", part(F.col("_b"))).join(F.broadcast(maps), "part")
    return joined.filter(byte.bitwiseAND(F.expr("shiftleft(1, cast(_b % 8 as int))")) != 0).drop("_b", "part", "bits")


def verified(pairs: DataFrame, texts: DataFrame, k: int, parts: int) -> DataFrame:
    """Of candidate pairs (q, c, and c's size n), the links (a, b)."""
    pairs = stored(pairs)
    blocks = F.greatest(F.ceil(F.count("*") / SEARCHED), F.ceil(F.sum("n") / SEARCHED_TOKENS)).cast("int").alias("blocks")
    sizes = stored(pairs.groupBy("q").agg(blocks, F.count("*").alias("asked")))
    dealt = meet(pairs, sizes, "q", counted="asked").select("q", "c", F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int").alias("block"))
    own = sizes.join(texts, sizes.q == texts["class"]).select("q", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(True).alias("own"), F.col("q").alias("c"), "packed")
    others = dealt.join(texts, dealt.c == texts["class"]).select("q", "block", F.lit(False).alias("own"), "c", "packed")
    rows = own.unionByName(others).repartition(parts, "q", "block").sortWithinPartitions("q", "block", F.desc("own"))
    links = stored(rows.mapInArrow(partial(_search, k=k), "a long, b long"))
    discard(pairs, sizes)
    return links


def _possible_pair(n: str, pos: str, m: str, at: str) -> Column:
    return 9 * F.least(F.col(n) - F.col(pos), F.col(m) - F.col(at)) >= 4 * (F.col(n) + F.col(m))


def _with_pivots(long: DataFrame) -> DataFrame:
    """Members of long lists with their list's pivot: q, and its size and place m and at."""
    long = stored(long.select("token", "c", "n", "pos").distinct())
    pivots = long.groupBy("token").agg(F.min(F.struct("pos", "n", "c")).alias("p"), F.min("n").alias("least"))
    met = meet(long, pivots, "token").filter(9 * (F.col("n") - F.col("pos")) >= 4 * (F.col("n") + F.col("least")))
    out = stored(met.select("token", F.col("p.c").alias("q"), "c", "n", "pos", F.col("p.n").alias("m"), F.col("p.pos").alias("at")))
    discard(long)
    return out


def _parted(dense: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of dense lists with more than one label, under each two parts (low, high) of their list of which they are in one."""
    more = stored(dense.join(labels, dense.c == labels.v, "left").select("token", "q", "c", "n", "pos", F.coalesce("label", "c").alias("label")))
    sizes = more.groupBy("token").agg(F.ceil(F.count("*") / PART).cast("int").alias("of"), F.min("label").alias("one"), F.max("label").alias("other"))
    sizes = sizes.filter("one <> other").select("token", "of")
    part = F.pmod(F.xxhash64("c"), F.col("of")).cast("int").alias("part")
    met = meet(more, sizes, "token").select("token", "q", "c", "n", "pos", "label", part, F.explode(F.sequence(F.lit(0), F.col("of") - 1)).alias("with"))
    return met.select("token", F.least("part", "with").alias("low"), F.greatest("part", "with").alias("high"), "part", "q", "c", "n", "pos", "label")


def _linked(docs: DataFrame, k: int, doc_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """A row for each row of ``docs`` (doc_id, n, class), and one for each class: class, its first row by doc_id and the hash h of its text, and the same of its component, as component_id and root (a class)."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    seen = stored(rows.withColumn("h", F.xxhash64("text")).mapInArrow(partial(_known, k=k), KNOWN))
    top = seen.filter("kind = 1").groupBy("token").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "token").limit(FREQUENT).toArrow()
    hot = top.column("token").to_numpy().view(np.uint64)
    order = np.argsort(hot)
    frequent = spark.sparkContext.broadcast((hot[order], top.column("n").to_numpy()[order]))
    members = seen.filter("kind = 0")
    # a fifth of a set and one more are its prefix
    postings = members.agg(F.sum(F.col("n") - F.floor((4 * F.col("n") + 4) / 5) + 1)).first()[0] or 0
    tasks = max(4, parts // 2, -(-postings // POSTINGS))
    linked = rows.filter("doc_id is not null")
    dealt = linked.mapInArrow(partial(_prefixes, k=k, frequent=frequent, buckets=4 * tasks, most=LONG), "bucket int, members binary, entries binary")
    lists = stored(dealt.repartition(tasks, "bucket").mapInArrow(_lists_of, LISTS))
    pairs, dense = lists.filter("kind = 0").select("q", "c", "n"), lists.filter("kind = 1").select("token", "q", "c", "n", "pos")
    long = None
    if not lists.filter("kind = 2").isEmpty():
        long = _with_pivots(lists.filter("kind = 2"))
        pairs = pairs.unionByName(long.filter(_possible_pair("n", "pos", "m", "at") & (F.col("c") != F.col("q"))).select("q", "c", "n"))
        dense = dense.unionByName(long.drop("m", "at"))
    pairs = pairs.distinct()
    classes = pairs.select(F.explode(F.array("q", "c")).alias("class")).unionByName(dense.select(F.col("c").alias("class"))).distinct()
    first = F.min(F.struct("doc_id", F.col("token").alias("h"))).alias("f")
    of_class = stored(members.filter("n > 0 and doc_id is not null").groupBy("class").agg(first).select("class", "f.*"))
    chosen = stored(classes.join(of_class.drop("h"), "class"))
    texts = _wanted(linked, chosen.select("doc_id"), "doc_id").mapInArrow(_packed, "doc_id long, packed binary")
    texts = stored(texts.join(chosen, "doc_id").select("class", "packed"))
    links = verified(pairs, texts, k, parts)
    if not dense.isEmpty():
        labels = components(links)
        second = _parted(dense, labels).repartition(parts, "token", "low", "high").sortWithinPartitions("token", "low", "high", "pos", "c").mapInArrow(_second, "q long, c long, n long").distinct()
        links = stored(links.unionByName(verified(second, texts, k, parts)))
    discard(lists, chosen, texts, *([long] if long is not None else []))
    # vertices in the order of their smallest id, so that a component's label holds its id
    vertex = of_class.select("class", F.struct("doc_id", "class").alias("v"))
    ends = links.join(vertex.select(F.col("class").alias("a"), F.col("v").alias("va")), "a").join(vertex.select(F.col("class").alias("b"), F.col("v").alias("vb")), "b")
    labels = components(ends.select(F.col("va").alias("a"), F.col("vb").alias("b")))
    found = labels.select("v.class", "label")
    by_class = of_class.join(found, "class", "left").select("class", "doc_id", "h", F.coalesce("label.doc_id", "doc_id").alias("component_id"), F.coalesce("label.class", "class").alias("root"))
    return members.select("doc_id", "n", F.when(F.col("n") > 0, F.col("class")).alias("class")), stored(by_class)


def join(docs: DataFrame, k: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row of ``docs``: doc_id, n_shingles, class (of equal sets; null for none), component_id (the smallest doc_id reachable by links)."""
    members, by_class = _linked(docs, k, doc_id, text)
    out = meet(members, by_class.select("class", "component_id"), "class", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), "class", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def representatives(docs: DataFrame, k: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` without near duplicates: one of each component, all that are linked to nothing.

    It is the row of the smallest id; of rows that repeat id and text, or id and
    set, one stays; rows without words or id all stay. Columns of any name are kept.
    """
    _, by_class = _linked(docs, k, doc_id, text)
    found = by_class.filter("class = root").select("doc_id", "h")
    rows = docs.select(F.struct("*").alias("row"), F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), F.coalesce(F.col(text).rlike(r"[^\x20\x09-\x0D]"), F.lit(False)).alias("said"))
    lone = F.col("doc_id").isNull() | ~F.col("said")
    one = rows.filter(~lone).join(found, ["doc_id", "h"], "left_semi")
    one = one.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id", "h").orderBy("doc_id"))).filter("nth = 1")
    return one.select("row.*").unionByName(rows.filter(lone).select("row.*"))


def query(spark, sf_dir: str) -> DataFrame:
    """All ``documents``: five words, a similarity of 0.8."""
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id")


#: The query by brute force: all pairs that share a shingle, and all that is reached from each document.
SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
), starts AS (
  SELECT doc_id, words, unnest(range(1, greatest(2, len(words) - 3))) AS i FROM w WHERE len(words) > 0
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ') AS s FROM starts
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM shared JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id WHERE 100 * k >= 80 * (x.n + y.n - k)
), reached(v, m) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT links.b, m FROM reached JOIN links ON links.a = v
)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id FROM (SELECT v AS doc_id, min(m) AS component_id FROM reached GROUP BY v) LEFT JOIN sizes USING (doc_id)
"""
