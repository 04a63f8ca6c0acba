"""Sending this package to the executors, which import its modules in their Python workers."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).parent.parent


def ship_package(spark: SparkSession) -> None:
    """Adds a zip of the package to the session's Python files, once for each Spark context. The driver serves it to executors itself."""
    context = spark.sparkContext
    if getattr(context, "_lemmaflow_shipped", False):
        return
    path = Path(tempfile.mkdtemp()) / "lemmaflow.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(PACKAGE.rglob("*.py")):
            z.write(f, f.relative_to(PACKAGE.parent))
    context.addPyFile(str(path))
    context._lemmaflow_shipped = True
