"""Media catalogues, devices and settings files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspan.functions.text import MEDIA, is_media, parent, path_key, relative, stem, suffix


def media(spark: SparkSession, root: str, extensions: tuple[str, ...] = MEDIA) -> DataFrame:
    """Files at or under root: path, rel, parent, stem, ext, length. Of a folder only those of the extensions (in either case), of a
    single file that one whatever its extension. Only metadata is read: the content column is pruned from the scan."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    plain = F.regexp_replace("path", r"^[A-Za-z]+:/*(?=/)", "")
    base = F.lit(root.split("://", 1)[-1] if "://" not in root else "/" + root.split("://", 1)[1].split("/", 1)[-1]).cast("string")
    base = F.regexp_replace(base, r"/+\z", "")
    single = plain == base
    rows = found.withColumn("rel", F.when(single, F.element_at(F.split(plain, "/"), -1)).otherwise(relative(plain, base)))
    rows = rows.where(single | is_media(F.col("rel"), extensions))
    return rows.select("path", "rel", parent(F.col("rel")).alias("parent"), stem(F.col("rel")).alias("stem"), suffix(F.col("rel")).alias("ext"), "length")


def in_path_order(rows: DataFrame, rel: str = "rel") -> DataFrame:
    """Sorted by path components, so a/b comes before a-b/x."""
    return rows.orderBy(path_key(F.col(rel)))


def settings(spark: SparkSession, path: str) -> DataFrame:
    """name and value of a settings file's lines: blank ones, # comments and those without = are skipped, quotes are stripped."""
    return setting_rows(spark.read.text(path))


def setting_rows(lines: DataFrame, line: str = "value") -> DataFrame:
    x = F.trim(F.col(line))
    rows = lines.where((x != "") & ~F.startswith(x, F.lit("#")) & F.contains(x, F.lit("=")))
    at = F.instr(x, F.lit("="))
    bare = F.regexp_replace(F.trim(F.substring(x, at + 1, F.length(x))), "^[\"']+|[\"']+$", "")
    return rows.select(F.trim(F.substring(x, F.lit(1), at - 1)).alias("name"), bare.alias("setting"))


def device(devices: DataFrame, wanted: str, to_record: bool) -> DataFrame:
    """The device of devices(index, name, inputs, outputs) that a number or a part of a name means: by number; else the first whose
    name holds it, in either case, and that can record (or play); else the first whose name holds it."""
    if wanted.strip().lstrip("+-").isdigit():
        return devices.where(F.col("index") == int(wanted))
    able = F.col("inputs" if to_record else "outputs") > 0
    holds = F.contains(F.lower("name"), F.lit(wanted.lower()))
    return devices.where(holds).orderBy(F.when(able, 0).otherwise(1), "index").limit(1)
