"""JSON transcripts, matches and manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspan.functions.text import error_text, stem
from lexspan.schema import MANIFEST, MATCH_LIST, WORD_LIST


class NotAList(ValueError):
    """A file whose top level is not a list."""


def _lists(spark: SparkSession, path: str, shape: str, strict: bool) -> DataFrame:
    files = spark.read.option("wholetext", "true").text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value"))
    rows = files.select(stem(F.col("path")).alias("clip"), F.startswith(F.ltrim("value"), F.lit("[")).alias("is_list"), F.from_json("value", shape, {"mode": "PERMISSIVE"}).alias("items"))
    if strict and not rows.where(~F.col("is_list") | F.col("items").isNull()).isEmpty():
        raise NotAList(f"{path}: the top level of a file is not a list")
    return rows.select("clip", F.posexplode("items").alias("pos", "x")).withColumn("pos", F.col("pos").cast("bigint"))


def read_words(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Words of transcript files in list order; the clip is the file's stem. A missing file fails the read."""
    return _lists(spark, path, WORD_LIST, strict).where("x is not null").select("clip", "pos", "x.word", "x.start", "x.end")


def read_matches(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    return _lists(spark, path, MATCH_LIST, strict).where("x is not null").select("clip", "pos", "x.word", "x.start", "x.end", "x.replacement")


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """(clip, segments, error) of transcript files, as a recogniser gives them: a file that is no list, or cannot be read as one, is an error of its clip."""
    files = spark.read.option("wholetext", "true").text(path).select(stem(F.col("_metadata.file_path")).alias("clip"), F.col("value"))
    rows = files.select("clip", F.startswith(F.ltrim("value"), F.lit("[")).alias("is_list"), F.from_json("value", WORD_LIST, {"mode": "PERMISSIVE"}).alias("words"))
    fine = F.col("is_list") & F.col("words").isNotNull()
    words = F.filter("words", lambda w: w.isNotNull())
    return rows.select("clip", F.when(fine, F.array(F.struct(words.alias("words")))).alias("segments"), F.when(~fine, error_text(F.lit("NotAList"), F.concat(F.col("clip"), F.lit(" is not a list")))).alias("error"))


def as_json(rows: DataFrame, *fields: str) -> DataFrame:
    """One row a clip: its list in order as JSON text. A clip's words are one task's, as a file's are."""
    item = F.struct("pos", F.struct(*fields).alias("x"))
    return rows.groupBy("clip").agg(F.to_json(F.transform(F.sort_array(F.collect_list(item)), lambda i: i["x"])).alias("value"))


def write_words(words: DataFrame, path: str) -> None:
    """A folder clip=<clip> for each clip with its transcript as one text file."""
    as_json(words, "word", "start", "end").write.mode("overwrite").partitionBy("clip").text(path)


def write_matches(matches: DataFrame, path: str) -> None:
    as_json(matches, "word", "start", "end", "replacement").write.mode("overwrite").partitionBy("clip").text(path)


def read_clip_folders(spark: SparkSession, path: str, shape: str = WORD_LIST) -> DataFrame:
    """What write_words or write_matches wrote."""
    rows = spark.read.option("wholetext", "true").schema("value string, clip string").text(path)
    return rows.select("clip", F.posexplode(F.from_json("value", shape)).alias("pos", "x")).select("clip", F.col("pos").cast("bigint").alias("pos"), "x.*")


def write_manifest(rows: DataFrame, path: str) -> None:
    """JSON lines; what was there before is replaced."""
    rows.write.mode("overwrite").json(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).json(path)
