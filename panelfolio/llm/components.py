"""Connected components by alternating large and small stars, each round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelfolio.llm.common import stage


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("node", "root")).alias("x")).first()
    return row["n"], row["x"]


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (node, root), longs in any order -> (node, root) for every node but the smallest of each component, root being
    the smallest. Minima of neighbours are partial aggregates, so a node with many edges is no large group."""
    now = stage(edges.select(F.greatest("node", "root").alias("node"), F.least("node", "root").alias("root")).where("node <> root").distinct(), "edges")
    mark = _mark(now)
    while True:
        both = now.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(now.select(F.col("root").alias("u"), F.col("node").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("node"), F.col("m").alias("root")).distinct()
        large = stage(large, "large-star")
        smallest = large.groupBy("node").agg(F.min("root").alias("m"))
        turned = large.join(smallest, "node").where("root <> m").select(F.col("root").alias("node"), F.col("m").alias("root"))
        now = stage(turned.unionByName(smallest.select("node", F.col("m").alias("root"))).distinct(), "small-star")
        before, mark = mark, _mark(now)
        if mark == before:
            return now
