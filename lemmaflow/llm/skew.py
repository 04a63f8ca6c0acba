"""Joins of many rows with one row for each key, where a few keys may hold most of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEAVY, SALTS = 1000, 32


def heavy_keys(counts: DataFrame, key: str, least: int = 256) -> DataFrame:
    """The keys of ``counts(key, m)`` that have more than one part in HEAVY of all rows, so at most HEAVY keys, and ``least`` rows or more."""
    total = counts.agg(F.sum("m")).first()[0] or 0
    return counts.filter((F.col("m") * HEAVY > total) & (F.col("m") >= least)).select(key)


def join_by_key(rows: DataFrame, by_key: DataFrame, key: str, spread: str, heavy: DataFrame, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``by_key`` (a row for each key). Rows of the ``heavy`` keys are dealt to SALTS tasks each by a hash of ``spread``; these are at most HEAVY keys, so they may be broadcast."""
    marked = F.broadcast(heavy.select(F.col(key), F.lit(True).alias("heavy")))
    salts = F.when(F.col("heavy"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    left = rows.join(marked, key, "left").withColumn("salt", F.when(F.col("heavy"), F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")).otherwise(0)).drop("heavy")
    right = by_key.join(marked, key, "left").withColumn("salt", F.explode(salts)).drop("heavy")
    return left.join(right, [key, "salt"], how).drop("salt")
