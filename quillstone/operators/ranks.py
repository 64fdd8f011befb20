"""Ranks and running sums over a global order, without a one-task window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import materialize


def sums_before(rows: DataFrame, value: Column, order: Sequence[str], by: Sequence[str] = (), name: str = "before") -> DataFrame:
    """rows with the sum of value over the rows before each, in the order and
    within each group. Rows are laid out in ranges of (by, order); a range adds
    what the earlier ranges of its group hold, which is one row a range and group.
    The layout is written once, so both readings see the same ranges."""
    spread = rows.withColumn("__v", value).repartitionByRange(*by, *order).withColumn("__p", F.spark_partition_id())
    laid = materialize(spread, "ranges")
    parts = laid.groupBy("__p", *by).agg(F.sum("__v").alias("__s"))
    earlier = Window.partitionBy(*by).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("__p").alias("__q"), *[F.col(c).alias("__by_" + c) for c in by], F.coalesce(F.sum("__s").over(earlier), F.lit(0)).alias("__offset"))
    same = F.col("__p") == F.col("__q")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col("__by_" + c))
    within = Window.partitionBy("__p", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = laid.withColumn("__w", F.coalesce(F.sum("__v").over(within), F.lit(0))).join(parts, same)
    return placed.select(*rows.columns, (F.col("__w") + F.col("__offset")).alias(name))
