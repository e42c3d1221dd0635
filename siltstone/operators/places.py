"""Exact places of rows in an order within their group, with no group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def places(rows: DataFrame, group: list[str], order: list[str], name: str = "place") -> DataFrame:
    """``rows`` with their place, from 0, in ``order`` within ``group``.

    Rows are dealt by ranges of (group, order) and written; a row's place is its place in its range and the sum of its group's rows in ranges
    before. Only rows equal in group and order share a range whatever their number; their places are any of theirs.
    """
    ranged = cut(rows.repartitionByRange(*group, *order).withColumn("range_", F.spark_partition_id()))
    before = Window.partitionBy(*group).orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy(*group, "range_").agg(F.count("*").alias("n_"))
    first = counts.select(*group, "range_", F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("first_"))
    within = F.row_number().over(Window.partitionBy(*group, "range_").orderBy(*order))
    placed = ranged.withColumn("nth_", within).join(first, [*group, "range_"])
    return placed.select(*rows.columns, (F.col("first_") + F.col("nth_") - 1).alias(name))
