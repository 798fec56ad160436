"""URL filtering by a sort-merge range join against nested host and path rules.

A host is turned into a canonical key: its labels from last to first, each
followed by U+0001, which no label holds. The urls of a rule's host and all its
subdomains then form one interval of keys, those that begin with the rule's
key, and intervals either nest or are apart. Urls and rules are dealt out into
the same ranges of keys, a rule to each range that its interval meets, and every
task walks through its range once in key order with a stack of the rules whose
interval is open. The stacked rules whose path begins the url's path fit; the
longest rule (host and path together, then host) wins, and of rules that are the
same but for the action, a block.

Ranges are cut at quantiles of (key, row hash), so urls of one hot host spread
over many tasks. Memory of a task: the open rules of one key. Rules need no
bound and are never broadcast.

Defined cases: a null url, or one without ``://``, has an empty host and path,
which only a rule with an empty host could fit; null rule fields count as empty;
equal urls are judged alike; with no rules every url gets the default verdict.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import tidy

#: The rules of the query, as (action, host, path).
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Keys that are sampled on the driver for each range that is cut.
SAMPLED = 60
LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "id string, host string, path string, rule string, verdict string"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host (A-Z lower-cased) and path of a url; both empty without ``://``."""
    whole = F.coalesce(url, F.lit(""))
    at = F.locate("://", whole)
    rest = F.when(at > 0, F.substring(whole, at + 3, F.length(whole))).otherwise("")
    host = F.regexp_extract(rest, r"\A[^/?#]*", 0)
    return F.translate(host, *LOWER), F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"\A[^?#]*", 0)


def key_of(host: Column) -> Column:
    """Labels from last to first, each ended by U+0001; the empty host has the empty key."""
    return F.when(host == "", "").otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "\x01"), F.lit("\x01")))


def _number_of(cuts: list[tuple[str, int]]):
    """For a (key, h) struct: how many of the sorted cuts are not greater, by their chunk's first and then within the chunk."""
    if not cuts:
        return lambda x: F.lit(0)
    struct = lambda c: F.struct(F.lit(c[0]).alias("key"), F.lit(c[1]).cast("long").alias("h"))
    wide = math.isqrt(len(cuts) - 1) + 1
    chunks = [cuts[i : i + wide] for i in range(0, len(cuts), wide)]
    heads, inside = F.array(*[struct(c[0]) for c in chunks]), F.array(*[F.array(*map(struct, c)) for c in chunks])

    def number(x: Column) -> Column:
        chunk = F.size(F.filter(heads, lambda c: c <= x)) - 1
        return F.when(chunk < 0, F.lit(0)).otherwise(chunk * wide + F.size(F.filter(F.get(inside, chunk), lambda c: c <= x)))

    return number


@tidy
def _sweep(batches: Iterator[pa.RecordBatch], default: str) -> Iterator[pa.RecordBatch]:
    """Rows of one range in key order, rules before the urls of the same key."""
    stack: list[tuple] = []  # (key, longest first order, path, rule, action)
    for batch in batches:
        out = []
        for key, is_url, row, host, path, action in zip(*(batch.column(c).to_pylist() for c in ("key", "is_url", "id", "host", "path", "action")), strict=True):
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if not is_url:
                stack.append((key, (len(host) + len(path), len(host), action == "block"), path, host + path, action))
                continue
            fits = [x for x in stack if path.startswith(x[2])]
            best = max(fits, key=lambda x: x[1], default=None)
            out.append((row, host, path, best and best[3], best[4] if best else default))
        columns = list(zip(*out, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], ["id", "host", "path", "rule", "verdict"])


def filter_urls(urls: DataFrame, rules: DataFrame, row_id: str = "page_id", url: str = "url", default: str = "allow", ranges: int | None = None) -> DataFrame:
    """Every row of ``urls`` judged by ``rules`` (action allow or block, host, path): row_id, host, path, rule, verdict."""
    ranges = ranges or int(urls.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    host, path = host_and_path(F.col(url))
    rows = urls.select(F.col(row_id).cast("string").alias("id"), host.alias("host"), path.alias("path"))
    rows = rows.select(key_of(F.col("host")).alias("key"), F.xxhash64("id", "path").alias("h"), F.lit(True).alias("is_url"), "id", "host", "path", F.lit(None).cast("string").alias("action"))
    place = F.struct(F.col("key"), F.col("h"))
    share = min(1.0, SAMPLED * ranges / max(1, rows.count()))
    seen = sorted(tuple(r) for r in rows.select("key", "h").sample(share, seed=7).collect())
    cuts = sorted({seen[len(seen) * i // ranges] for i in range(1, ranges)}) if seen else []
    at = _number_of(cuts)
    first = F.struct(F.col("key"), F.lit(-(1 << 63)).cast("long").alias("h"))
    last = F.struct(F.concat(F.col("key"), F.lit("\U0010ffff")).alias("key"), F.lit(-(1 << 63)).cast("long").alias("h"))
    named = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("action", "host", "path")]
    ruled = rules.select(*named).withColumn("host", F.translate("host", *LOWER)).distinct()
    ruled = ruled.select(key_of(F.col("host")).alias("key"), F.lit(0).cast("long").alias("h"), F.lit(False).alias("is_url"), F.lit(None).cast("string").alias("id"), "host", "path", "action")
    ruled = ruled.withColumn("range", F.explode(F.sequence(at(first), at(last))))
    both = rows.withColumn("range", at(place)).unionByName(ruled)
    dealt = both.repartitionByRange(len(cuts) + 1, "range") if cuts else both.coalesce(1)
    return dealt.sortWithinPartitions("range", "key", "is_url").drop("range").mapInArrow(partial(_sweep, default=default), SCHEMA).withColumn("id", F.col("id").cast(urls.schema[row_id].dataType)).withColumnRenamed("id", row_id)


def query(spark, sf_dir: str) -> DataFrame:
    """Every url of ``pages``."""
    rules = spark.createDataFrame(list(RULES), "action string, host string, path string")
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules)


_HOST = "translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL = f"""
WITH parts AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), hosts AS (
  SELECT page_id, {_HOST} AS host, regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM parts
), rules(action, rhost, rpath) AS (
  VALUES {", ".join(f"('{a}', '{h}', '{p}')" for a, h, p in RULES)}
), fits AS (
  SELECT page_id, arg_max(struct_pack(rule := rhost || rpath, action := action), length(rhost || rpath)) AS best
  FROM hosts JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id
)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.action, 'allow') AS verdict FROM hosts LEFT JOIN fits USING (page_id)
"""
