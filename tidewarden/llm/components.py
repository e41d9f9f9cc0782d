"""Connected components of a graph in tables, in rounds of large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewarden.llm import common


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of edges (u, v) that isn't its component's least node; roots are least nodes.

    Only counts and a checksum come to the driver. A round is a written table, so lineage stays short and a lost
    executor repeats one round at most. The number of rounds grows with the logarithm of a component's diameter.
    """
    now, before = common.written(edges.where("u != v").select("u", "v").distinct(), "edges"), None
    while True:
        seen = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if seen == before or not seen[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        after = common.written(_small(_large(now)), "edges")
        common.dropped(now)
        now, before = after, seen
