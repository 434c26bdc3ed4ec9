"""Connected components by alternating star contraction, entirely in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import keep


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges(a, b)``; root is the smallest node that its links reach.

    Each round links every node's larger neighbours, then its smaller ones, to the
    smallest of them; the number of rounds grows with the logarithm of the longest
    path.  Hubs are spread by the partial aggregation.  Self-links and repeated
    links are allowed, nulls are ignored, no edge gives no row.
    """
    links = keep(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links", narrow=True)
    if links.isEmpty():
        return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    before = None
    while True:
        both = links.select("u", "v").unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        linked = large.join(small, "u")
        links = keep(linked.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionAll(small.select("u", F.col("m").alias("v"))).distinct(), "links", narrow=True)
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return links.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root").unionAll(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct().join(links.select(F.col("u").alias("node")), "node", "left_anti"))
        before = now
