"""Sharding by extendible hashing.

A document's key is 128 bits: 64 of a hash of its id, and 64 of a hash of its
text and of its number among the rows that repeat both. The directory starts with one bucket; a bucket that
is larger than the byte limit is split on the next bit, and only it, until every
bucket fits. A shard is named by its bits.

The directory comes from byte sums over prefixes of ``STEP`` bits: all levels of
one step are summed from one aggregate, and the documents of buckets that still
do not fit at its last bit go on to the next step. Bytes are pre-aggregated in
the map tasks, so a hot prefix costs no more than another.

Defined cases: a null text has no bytes; a null id hashes like the empty string;
rows that repeat an id part on the bits of their text and number, and the shards are the same however the rows are dealt out; a document larger
than the limit ends as a shard of its own at the first bit that parts it from
all others, or at the last bit; an empty table has no shards. Other columns are
not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored

STEP, BITS = 16, 128
#: Parts in which rows of one id and text are counted.
WAYS = 256
LIMIT = 1 << 20


def key_bits(doc_id: Column) -> Column:
    """The first 64 bits of md5 of the decimal id, as a string of 0 and 1."""
    digits = F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 16)
    halves = [F.lpad(F.conv(F.substring(digits, at, 8), 16, 2), 32, "0") for at in (1, 9)]
    return F.concat(*halves)


def _row_bits(*of: Column) -> Column:
    return F.lpad(F.conv(F.hex(F.xxhash64(*of)), 16, 2), 64, "0")


def _numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with nth, which tells apart those of one id and text and is 0 for all others.

    Such rows are counted in ``WAYS`` parts each, and a part's numbers go on
    where those of the parts before it end.
    """
    again = rows.groupBy("k", "h").agg(F.count("*").alias("n")).filter("n > 1").select("k", "h")
    if again.isEmpty():
        return rows.withColumn("nth", F.lit(0).cast("long"))
    again = stored(again.withColumn("again", F.lit(True)))
    marked = rows.join(again, ["k", "h"], "left").withColumn("way", F.pmod("m", F.lit(WAYS)).cast("int"))
    some = marked.filter("again")
    sizes = some.groupBy("k", "h", "way").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(Window.partitionBy("k", "h").orderBy("way")) - F.col("n")).drop("n")
    inside = F.row_number().over(Window.partitionBy("k", "h", "way").orderBy("m"))
    counted = some.withColumn("inside", inside).join(before, ["k", "h", "way"]).withColumn("nth", F.col("before") + F.col("inside") - 1)
    return marked.filter("again is null").withColumn("nth", F.lit(0).cast("long")).select(*rows.columns, "nth").unionByName(counted.select(*rows.columns, "nth"))


def shard(docs: DataFrame, limit: int = LIMIT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row of ``docs``: doc_id, bytes, shard (its bits), depth, shard_bytes, shard_docs, fits."""
    rows = docs.select(F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("bytes"), F.col(doc_id).alias("doc_id"), key_bits(F.col(doc_id)).alias("k"), F.xxhash64(text).alias("h"), F.monotonically_increasing_id().alias("m"))
    # the row number is fixed by writing it before it is used
    left = _numbered(stored(rows))
    left = stored(left.select("doc_id", "bytes", F.concat("k", _row_bits(F.col("h"), F.col("nth"))).alias("bits")))
    found = []
    for at in range(0, BITS, STEP):
        prefix = F.substring("bits", 1, at + STEP)
        cells = left.groupBy(prefix.alias("cell")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n"))
        by_level = cells.select("cell", "bytes", "n", F.explode(F.sequence(F.lit(at), F.lit(at + STEP))).alias("depth"))
        sums = by_level.groupBy(F.substring("cell", F.lit(1), F.col("depth")).alias("shard"), "depth").agg(F.sum("bytes").alias("shard_bytes"), F.sum("n").alias("shard_docs"))
        last = at + STEP == BITS
        sums = stored(sums.withColumn("fits", (F.col("shard_bytes") <= limit) | (F.col("shard_docs") == 1) | (F.col("depth") == BITS)))
        # a leaf fits and its parent does not; a parent has two children, so no key is hot
        split = sums.filter(~F.col("fits")).select(F.col("shard").alias("parent"), (F.col("depth") + 1).alias("depth"))
        parent = F.substring("shard", F.lit(1), F.col("depth") - 1)
        leaves = sums.filter(F.col("fits") & (F.col("depth") > at)).withColumn("parent", parent).join(split, ["parent", "depth"], "left_semi").drop("parent")
        leaves = stored(leaves.unionByName(sums.filter(F.col("fits") & (F.col("depth") == at))))
        depths = sorted(r.depth for r in leaves.select("depth").distinct().collect())
        chains = cells.select("cell", F.explode(F.array(*map(F.lit, depths)) if depths else F.array().cast("array<int>")).alias("depth")).withColumn("shard", F.substring("cell", F.lit(1), F.col("depth")))
        leaf = stored(chains.join(leaves.drop("fits"), ["shard", "depth"]).select("cell", F.struct("shard", "depth", "shard_bytes", "shard_docs").alias("s")))
        placed = left.withColumn("cell", prefix).join(leaf, "cell", "left")
        found.append(placed.filter("s is not null").select("doc_id", "bytes", "s.shard", "s.depth", "s.shard_bytes", "s.shard_docs"))
        if last or leaf.count() == cells.count():
            break
        left = stored(placed.filter("s is null").select("doc_id", "bytes", "bits"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.withColumn("fits", F.col("shard_bytes") <= limit)


def query(spark, sf_dir: str) -> DataFrame:
    """All ``documents`` in shards of at most 1 MiB of text."""
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: The same by brute force: of all prefixes of a document's bits the shortest one whose bucket fits.
SQL = f"""
WITH rows AS (
  SELECT doc_id, coalesce(octet_length(encode(text)), 0)::BIGINT AS bytes,
    lpad(bin(('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT), 32, '0') || lpad(bin(('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 9, 8))::BIGINT), 32, '0') AS bits
  FROM documents
), chains AS (
  SELECT doc_id, bytes, d AS depth, substr(bits, 1, d) AS shard FROM rows, range(0, 65) t(d)
), sums AS (
  SELECT shard, depth, sum(bytes)::BIGINT AS shard_bytes, count(*) AS shard_docs FROM chains GROUP BY ALL
  HAVING sum(bytes) <= {LIMIT} OR count(*) = 1
), first AS (
  SELECT doc_id, any_value(bytes) AS bytes, arg_min(s, s.depth) AS s FROM (SELECT doc_id, bytes, struct_pack(shard, depth, shard_bytes, shard_docs) AS s FROM chains JOIN sums USING (shard, depth)) GROUP BY doc_id
)
SELECT doc_id, bytes, s.shard AS shard, s.depth::INT AS depth, s.shard_bytes AS shard_bytes, s.shard_docs AS shard_docs, s.shard_bytes <= {LIMIT} AS fits FROM first
"""
