"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from chronopanel.llm.common import stage


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of an edge, component being the smallest node.

    `edges` has two columns of one type, in any direction, repeats and loops included.
    A node that only has loops gets no row. Every round links each node to the smallest
    of its neighbours, which halves distances; rounds end when the edges stay the same.
    Minima are pre-aggregated before they move; only edges are shuffled, and every round
    is written to the shared folder.
    """
    a, b = edges.columns
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    now, before = stage(now, "edges"), None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first()
        if mark == before or mark[0] == 0:
            return _labelled(now)
        before = mark
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = stage(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")


def _labelled(stars: DataFrame) -> DataFrame:
    leaves = stars.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return leaves.unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
