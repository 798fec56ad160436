"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, meet, stored


def components(links: DataFrame) -> DataFrame:
    """From links (a, b): (v, label) for every linked vertex, label being the smallest vertex that it reaches.

    Each round joins every edge's end to the least neighbour; sums are combined
    before they move, edges of a vertex with many meet its neighbour by a
    broadcast of bounded size, and all edges of a vertex are never gathered. The
    number of rounds grows with the logarithm of the longest chain. A round begins
    with what is around each vertex; if all that have a smaller neighbour have this
    one alone, and no larger, the stars are done and it holds the labels. Tables of
    a round are deleted when the next one is written.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    number = lambda kind: F.sum(F.expr(kind).cast("long"))
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        around = stored(both.groupBy("u").agg(F.min("v").alias("v"), number("v < u").alias("below"), number("v > u").alias("above")).select("u", F.least("u", "v").alias("m"), "below", "above"))
        if around.filter("below > 1 or below = 1 and above > 0").isEmpty():
            discard(edges)
            return around.select(F.col("u").alias("v"), F.col("m").alias("label"))
        # large star: a vertex's larger neighbours meet at the smallest of all of them and itself
        least = around.filter("above > 0").select(F.col("u").alias("v"), "m", "above")
        large = stored(meet(edges, least, "v", counted="above").select("u", F.col("m").alias("v")))
        # small star: a vertex's smaller neighbours and itself meet at the smallest of them
        down = stored(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")))
        ends = F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")
        after = stored(meet(large, down, "u", counted="n").select(ends).select("e.u", "e.v").filter("u <> v").distinct())
        discard(edges, around, large, down)
        edges = after
