"""Status records, counts, resuming and stopping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexspan.schema import STATUSES
from lexspan.work import new_path

# Fixed value: characters of an error in a record.
MOST_ERROR = 1500


def records(clips: DataFrame) -> DataFrame:
    """Manifest rows of clips(clip, relative, skipped, error, words_found, replacements, spliced, skipped_splice): skipped rows hold
    clip and status alone, clean ones empty lists, error rows the message."""
    n = F.coalesce(F.size("words_found"), F.lit(0))
    status = F.when(F.col("skipped"), "skipped").when(F.col("error").isNotNull(), "error").when(n > 0, "censored").otherwise("clean")
    rows = clips.withColumn("status", status)
    done = F.col("status").isin("censored", "clean")
    return rows.select(
        "clip",
        "status",
        F.when(done, F.coalesce("words_found", F.array().cast("array<string>"))).alias("words_found"),
        F.when(done, F.coalesce("replacements", F.array().cast("array<struct<word:string,replacement:string,start:double,end:double>>"))).alias("replacements"),
        F.when(F.col("status") == "error", F.left("error", F.lit(MOST_ERROR))).alias("error"),
        F.when(F.col("status") == "censored", F.col("spliced")).cast("int").alias("spliced"),
        F.when(F.col("status") == "censored", F.col("skipped_splice")).cast("int").alias("skipped_splice"),
        F.when(F.col("status") != "skipped", F.col("relative")).alias("relative"),
    )


def counts(manifest: DataFrame) -> DataFrame:
    """The number of rows of each status, zeros included."""
    spark = manifest.sparkSession
    every = spark.createDataFrame([(s,) for s in STATUSES], "status string")
    found = manifest.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    return every.join(found, "status", "left").select("status", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def marked(rows: DataFrame, order: str = "idx", failed: str = "failed", keep_going: bool = False) -> DataFrame:
    """Adds processed: rows up to the first failure, which is included. Its place is one aggregate, read as a scalar subquery, so
    there is neither a global sort nor a join."""
    if keep_going:
        return rows.withColumn("processed", F.lit(True))
    first = rows.where(failed).agg(F.min(order)).scalar()
    return rows.withColumn("processed", F.coalesce(F.col(order) <= first, F.lit(True)))


def until_failure(rows: DataFrame, order: str = "idx", failed: str = "failed", keep_going: bool = False) -> DataFrame:
    return marked(rows, order, failed, keep_going).where("processed").drop("processed")


def summary(rows: DataFrame, failed: str = "failed") -> DataFrame:
    """Of marked rows: processed, failed, succeeded, and parity_succeeded, which counts what was never reached as succeeded too."""
    bad = F.count_if(F.col("processed") & F.col(failed))
    done = rows.agg(F.count_if("processed").alias("processed"), bad.alias("failed"), F.count(F.lit(1)).alias("total"))
    return done.select("processed", "failed", (F.col("processed") - F.col("failed")).alias("succeeded"), (F.col("total") - F.col("failed")).alias("parity_succeeded"))


def pending(inputs: DataFrame, done: DataFrame, by: str = "relative") -> DataFrame:
    """Inputs without an output yet."""
    return inputs.join(done.select(by), by, "left_anti")


def first_n(rows: DataFrame, n: int | None, *order) -> DataFrame:
    """The first n rows; none or 0 is no limit."""
    if n is not None and n < 0:
        raise ValueError("a negative limit is not supported")
    return rows.orderBy(*order).limit(n) if n else rows


def numbered(rows: DataFrame, *order) -> DataFrame:
    """idx from 1 in the order given (which should have no ties), and the total. Rows are dealt by range and written, so that a
    number is the place within the range plus the rows of the ranges before; only the ranges' sizes, one row each, go to one task."""
    spark = rows.sparkSession
    path = new_path(spark, "numbered")
    dealt = rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    dealt.write.parquet(path)
    placed = spark.read.schema(dealt.schema).parquet(path)
    sizes = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    every = W.partitionBy(F.lit(0))
    before = sizes.select("_range", (F.sum("_n").over(every.orderBy("_range").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("_n")).alias("_before"), F.sum("_n").over(every).alias("total"))
    within = F.row_number().over(W.partitionBy("_range").orderBy(*order))
    return placed.join(F.broadcast(before), "_range").withColumn("idx", (within + F.col("_before")).cast("bigint")).drop("_range", "_before")


def dry_run(hits: DataFrame, files: DataFrame) -> DataFrame:
    """Each match as OK or MISSING."""
    seen = hits.join(files.select("clip", "filename").distinct().withColumn("there", F.lit(True)), ["clip", "filename"], "left")
    return seen.select("clip", "pos", "filename", F.when(F.col("there"), "OK").otherwise("MISSING").alias("state"))


def speech_counts(results: DataFrame) -> DataFrame:
    """results(state: done, skipped or failed): skipped ones count as successes too."""
    s = F.col("state")
    return results.agg(F.count_if(s.isin("done", "skipped")).alias("succeeded"), F.count_if(s == "failed").alias("failed"), F.count_if(s == "skipped").alias("skipped"))


def copied(manifest: DataFrame, copy_clean: bool) -> DataFrame:
    """Clips whose original is copied as it is: clean ones, if wanted."""
    return manifest.where((F.col("status") == "clean") & F.lit(copy_clean)).select("clip", "relative")
