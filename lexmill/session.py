"""Session helpers."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parent


def build_session(app: str = "lexmill", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings that the operators assume: UTC and adaptive execution."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors' Python workers, once per context."""
    context = spark.sparkContext
    if not getattr(context, "_lexmill_shipped", False):
        archive = Path(tempfile.mkdtemp(prefix="lexmill-")) / "lexmill.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for path in sorted(PACKAGE.rglob("*.py")):
                out.write(path, path.relative_to(PACKAGE.parent))
        context.addPyFile(str(archive))
        context._lexmill_shipped = True
    return spark
