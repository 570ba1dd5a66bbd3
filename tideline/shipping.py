"""Brings this package to the executors' Python, which may not find it by itself."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's sources once for each Spark application."""
    app = spark.sparkContext.applicationId
    if app in _sent:
        return
    top = Path(__file__).resolve().parent
    to = Path(tempfile.mkdtemp(prefix="tideline-")) / "tideline.zip"
    with zipfile.ZipFile(to, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, Path("tideline") / p.relative_to(top))
    spark.sparkContext.addPyFile(str(to))
    _sent.add(app)
