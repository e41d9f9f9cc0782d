"""Recall and precision of rejections over labelled rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def recall_precision(rows: DataFrame, poison: str = "poison", rejected: str = "rejected") -> DataFrame:
    """One row: poison, rejected_poison, rejected, recall, precision (1 if nothing was rejected)."""
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    p, r = F.col(poison), F.col(rejected)
    sums = rows.agg(n(p).alias("poison"), n(p & r).alias("rejected_poison"), n(r).alias("rejected"))
    return sums.withColumn("recall", F.try_divide("rejected_poison", "poison")).withColumn("precision", F.when(F.col("rejected") == 0, 1.0).otherwise(F.try_divide("rejected_poison", "rejected")))


def by_class(rows: DataFrame, column: str = "class", rejected: str = "rejected") -> DataFrame:
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(rejected).cast("long")).alias("rejected"))
