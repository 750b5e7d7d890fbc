"""Work that survives being killed: a batch goes slice by slice, and what a slice gave is committed by one rename.

A commit log is a folder of slices, each a folder of JSON lines. A run first leaves out the inputs that the log has, so it goes on where the one before
ended, whatever number of slices that had; a slice that was being written has no name yet and is done again."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspan.operators.manifest import pending


def _files(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def committed(spark: SparkSession, log: str, schema: str) -> DataFrame:
    """What the slices that were committed gave."""
    files, at = _files(spark, log)
    done = [str(x.getPath()) for x in files.listStatus(at) if x.getPath().getName().startswith("slice-")] if files.exists(at) else []
    return spark.read.schema(schema).json(done) if done else spark.createDataFrame([], schema)


def in_slices(inputs: DataFrame, work: Callable[[DataFrame], DataFrame], log: str, schema: str, by: str = "relative", slices: int = 16) -> DataFrame:
    """work(a slice of the inputs) for all that the log lacks, and then all rows of the log. work's rows must have `by` for each input that is
    done with; inputs without a row are tried again by the next run."""
    spark = inputs.sparkSession
    todo = pending(inputs, committed(spark, log, schema), by)
    for n in range(slices):
        part = f"{log}/_{uuid.uuid4().hex}"
        work(todo.where(F.pmod(F.xxhash64(by), F.lit(slices)) == n)).write.json(part)
        files, at = _files(spark, part)
        if not files.rename(at, spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{log}/slice-{uuid.uuid4().hex}")):
            raise OSError(f"{part} could not be renamed")
    return committed(spark, log, schema)
