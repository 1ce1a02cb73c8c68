"""Sends the library to executors that can't import it from where the driver does."""

from __future__ import annotations

import tempfile
import zipfile
from functools import wraps
from pathlib import Path

from pyspark.sql import SparkSession

_PACKAGE = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> None:
    """Adds the package to the session's files, once for each context."""
    context = spark.sparkContext
    if getattr(context, "_vellum_shipped", False):
        return
    archive = Path(tempfile.mkdtemp(prefix="vellum-")) / "vellum.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for file in sorted(_PACKAGE.rglob("*.py")):
            z.write(file, str(Path(_PACKAGE.name) / file.relative_to(_PACKAGE)))
    context.addPyFile(str(archive))
    context._vellum_shipped = True


def shipped(query):
    """The query, sending the library along first."""

    @wraps(query)
    def run(spark, sf_dir):
        ship(spark)
        return query(spark, sf_dir)

    return run
