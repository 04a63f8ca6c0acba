"""Cutting lineage with tables in the folder that all executors share.

The folder is the session's ``spark.checkpoint.dir``. Only where it is unset (tests, a laptop)
a folder beside the warehouse is taken instead.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

ROWS_A_TASK = 10_000


def shared_dir(spark: SparkSession) -> str:
    """The shared folder, as a URI or path that Spark's readers and writers understand."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "stage", about_rows: int | None = None) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and return a scan of it.

    Later reads survive the loss of any executor and don't run the plan again. With ``about_rows``, a table of few rows is
    written by few tasks, however many partitions its shuffle has."""
    spark = df.sparkSession
    if about_rows is not None:
        df = df.coalesce(1 + about_rows // ROWS_A_TASK)
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder that an earlier round of a loop wrote and nothing reads any more."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def drop_table(df: DataFrame) -> None:
    """Delete what ``materialize`` wrote for ``df``."""
    files = df.inputFiles()
    if files:
        drop_path(df.sparkSession, files[0].rsplit("/", 1)[0])
