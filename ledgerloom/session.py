"""A session with the settings this engine expects. Everything also works in a session made elsewhere."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def session(app: str = "ledgerloom", **more: str) -> SparkSession:
    return SparkSession.builder.appName(app).config(map=SETTINGS | more).getOrCreate()


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package: a zip of it goes to the executors unless PYTHONPATH already leads there."""
    root = Path(__file__).resolve().parents[1]
    sc = spark.sparkContext
    if str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or "ledgerloom.zip" in sc._python_includes:
        return
    at = f"{tempfile.mkdtemp()}/ledgerloom.zip"
    with zipfile.ZipFile(at, "w") as z:
        for p in sorted((root / "ledgerloom").rglob("*.py")):
            z.write(p, p.relative_to(root))
    sc.addPyFile(at)
