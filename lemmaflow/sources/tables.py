"""Scans and registries of theorem and corpus records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def scan_json(spark: SparkSession, path: str, schema: str, max_count: int | None = None) -> DataFrame:
    """JSON lines by schema; blank and broken lines are left out."""
    rows = spark.read.schema(f"{schema}, _corrupt_record string").json(path, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt_record")
    rows = rows.filter("_corrupt_record is null").drop("_corrupt_record")
    return rows.limit(max_count) if max_count else rows


def tactic_theorems(records: DataFrame) -> DataFrame:
    return records.filter((F.col("proof_type") == "tactic") & (F.size("tactics") > 0))


def corpus_premises(files: DataFrame) -> DataFrame:
    """``files(path, premises array<struct>)`` -> a row for each premise with its file as def_path."""
    return files.select(F.col("path").alias("def_path"), F.explode("premises").alias("p")).select("def_path", "p.*")


def code_index(rows: DataFrame) -> DataFrame:
    """full_name -> code; the last one wins."""
    return rows.groupBy("full_name").agg(F.max_by("code", "seq").alias("code"))


def unique_premises(rows: DataFrame, aliases: list[str]) -> DataFrame:
    """The first row of each (name, def_path), the name being the first alias field that is set."""
    named = rows.select(F.coalesce(*aliases).alias("full_name"), "def_path", "seq")
    order = Window.partitionBy("full_name", "def_path").orderBy("seq")
    return named.withColumn("k", F.row_number().over(order)).filter("k = 1").drop("k")


def theorem_edges(records: DataFrame) -> DataFrame:
    """A row for each (theorem, tactic) with its premises."""
    return records.select("theorem", F.posexplode("tactics").alias("idx", "t")).select("theorem", "idx", "t.tactic", "t.premises")
