"""Sends the package to executors that do not have it installed."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SENT: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Adds a zip of the package's sources to the session's Python files, once for each application."""
    application = spark.sparkContext.applicationId
    if application not in _SENT:
        root = Path(__file__).resolve().parent.parent
        path = os.path.join(tempfile.mkdtemp(prefix="spark-"), f"{root.name}.zip")
        with zipfile.ZipFile(path, "w") as z:
            for source in sorted(root.rglob("*.py")):
                z.write(source, source.relative_to(root.parent))
        spark.sparkContext.addPyFile(path)
        _SENT.add(application)
    return spark
