"""Makes the package importable on the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from functools import wraps
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors once for each application, unless PYTHONPATH already leads to it (as for them)."""
    root = Path(__file__).resolve().parent
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    if str(root.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    path = f"{tempfile.mkdtemp(prefix='lexspan-')}/lexspan-package.zip"
    with zipfile.ZipFile(path, "w") as out:
        for file in sorted(root.rglob("*")):
            if file.suffix in (".py", ".tsv"):
                out.write(file, file.relative_to(root.parent))
    spark.sparkContext.addPyFile(path)


def shipped(query):
    """A query that ships the package first."""

    @wraps(query)
    def run(spark: SparkSession, sf_dir: str):
        ship(spark)
        return query(spark, sf_dir)

    return run
