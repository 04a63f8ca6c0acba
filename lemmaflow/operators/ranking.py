"""Ranks and running sums over all rows of a table, without a window that has all of them in one task.

Rows are cut into ranges of the sort keys, numbered within each range, and the totals of the ranges before are added: one row for each range, so the only
window without a partition is over the list of ranges. Rows that are alike in all sort keys come in any order. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.durable import materialize

_WITHIN = 33  # bits of monotonically_increasing_id that count rows within a partition


def _in_ranges(df: DataFrame, keys: list[Column]) -> DataFrame:
    """``df`` sorted in ranges, stored once, with ``_range`` (rising with the keys) and ``_row`` (from 0 in each range)."""
    placed = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_id", F.monotonically_increasing_id())
    return materialize(placed.select(*df.columns, F.shiftright("_id", _WITHIN).alias("_range"), F.col("_id").bitwiseAND((1 << _WITHIN) - 1).alias("_row")), "ranges")


def _before(totals: DataFrame, *sums: str) -> DataFrame:
    """For each range the sums over all ranges before it."""
    w = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    return F.broadcast(totals.select("_range", *(F.coalesce(F.sum(c).over(w), F.lit(0).cast(totals.schema[c].dataType)).alias(c) for c in sums)))


def add_rank(df: DataFrame, keys: list[Column], name: str = "rank") -> DataFrame:
    """``df`` with the place (long, from 1) of each row in the order of ``keys``."""
    rows = _in_ranges(df, keys)
    offsets = _before(rows.groupBy("_range").agg(F.count("*").alias("_n")), "_n")
    return rows.join(offsets, "_range").withColumn(name, F.col("_n") + F.col("_row") + 1).drop("_range", "_row", "_n")


def add_running_sum(df: DataFrame, value: str, keys: list[Column], name: str) -> DataFrame:
    """``df`` with the sum of ``value`` over all rows up to each one in the order of ``keys``."""
    rows = _in_ranges(df, keys)
    offsets = _before(rows.groupBy("_range").agg(F.sum(value).alias("_n")), "_n")
    within = F.sum(value).over(W.partitionBy("_range").orderBy("_row").rowsBetween(W.unboundedPreceding, 0))
    return rows.join(offsets, "_range").withColumn(name, F.col("_n") + within).drop("_range", "_row", "_n")
