"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. It is set here only where it is unset and all tasks run in this process, as in tests; on a cluster it has
    to be named."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        ctx = spark.sparkContext
        if ctx._jsc.sc().getCheckpointDir().isEmpty():
            if not (ctx.master == "local" or ctx.master.startswith("local[")):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            ctx.setCheckpointDir(tempfile.mkdtemp(prefix="lexspan-"))
        found = ctx._jsc.sc().getCheckpointDir().get()
    return found.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
