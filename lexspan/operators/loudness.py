"""Loudness of time ranges over decoded blocks of equal length. Either end of a range asks for the power of all samples before it, so a range is two
questions and two ragged ends, however long it is: samples are scanned once and never multiplied by the ranges that span them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspan.functions.signal import BLOCK, LEAST_MEASURED_S, RATE, gain_db, mean_volume_of, power_of
from lexspan.operators.scan import MOST, scan


def block_power(blocks: DataFrame) -> DataFrame:
    """Of blocks(clip, block_no, samples) each clip's mean volume in dB; null for silence."""
    by = blocks.groupBy("clip").agg(F.sum(power_of(F.col("samples"))).alias("p"), F.sum(F.size("samples")).alias("n"))
    return by.select("clip", mean_volume_of(F.col("p"), F.col("n")).alias("db"))


def range_volume(ranges: DataFrame, blocks: DataFrame, rate: int = RATE, block: int = BLOCK, most: int = MOST) -> DataFrame:
    """ranges(clip, pos, start, end) with db, the mean volume of blocks(clip, block_no, samples) between start and end; null where the
    range is too short to measure, silent or beyond the samples. A clip's blocks are numbered from 0 without holes, and only the last is short."""
    first = F.floor(F.col("start") * rate).cast("bigint")
    last = F.floor(F.col("end") * rate).cast("bigint")  # exclusive
    wide = ranges.select("clip", "pos", first.alias("first"), last.alias("last"), "start", "end").where((F.col("end") - F.col("start") > LEAST_MEASURED_S) & (F.col("last") > F.col("first")))
    # either end of a range is a number of samples from the clip's start; what lies before it is asked of the block that holds the last of them, in a
    # row behind that block. One ordered scan answers: samples go where their clip's scan is, and are joined with nothing
    ends = F.array(*(F.struct(F.lit(sign).alias("sign"), F.col(at).alias("at")) for sign, at in ((-1, "first"), (1, "last"))))
    sides = wide.select("clip", "pos", F.explode(ends).alias("x")).where("x.at > 0").withColumn("block_no", F.floor((F.col("x.at") - 1) / block))
    asked = sides.groupBy("clip", "block_no").agg(F.collect_list(F.struct("pos", "x")).alias("asked")).withColumn("kind", F.lit(1))
    known = blocks.select("clip", F.col("block_no").cast("bigint").alias("block_no"), "samples", F.lit(0).alias("kind"))
    both = scan(known.unionByName(asked, allowMissingColumns=True), "clip", ("block_no", "kind"), most)
    both = both.running_sum(F.when(F.col("kind") == 0, power_of(F.col("samples"))).otherwise(F.lit(0.0)), "p").running_sum(F.coalesce(F.size("samples"), F.lit(0)).cast("bigint"), "n")
    told = both.lagged(F.struct("block_no", "samples"), "before").rows.where("kind = 1").withColumn("own", F.when(F.col("before.block_no") == F.col("block_no"), F.col("before.samples")))
    told = told.select("clip", "block_no", "own", "p", "n", F.explode("asked").alias("a")).select("clip", "own", "p", "n", "a.pos", "a.x.sign", (F.col("a.x.at") - F.col("block_no") * block).cast("int").alias("size"))
    # the block's samples behind the place go off again; beyond a clip's last block there are none
    rest = F.when(F.size("own") > F.col("size"), F.slice("own", F.col("size") + 1, F.size("own") - F.col("size")))
    told = told.select("clip", "pos", (F.col("sign") * (F.col("p") - F.coalesce(power_of(rest), F.lit(0.0)))).alias("p"), (F.col("sign") * (F.col("n") - F.coalesce(F.size(rest), F.lit(0)))).alias("n"))
    by = told.groupBy("clip", "pos").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    # a difference of sums that is silence but for rounding is silence
    power = F.when(F.col("p") > 1e-9 * F.col("n"), F.col("p")).otherwise(F.lit(0.0))
    # merged, as what comes from exploded rows is more than a plan expects and would be broadcast
    return ranges.hint("merge").join(by.select("clip", "pos", mean_volume_of(power, F.col("n")).alias("db")), ["clip", "pos"], "left")


def gains(original: DataFrame, replacement: DataFrame) -> DataFrame:
    """The gain of each match from its range's volume, original(clip, pos, db), and its replacement's, replacement(clip, pos, db)."""
    both = original.hint("merge").join(replacement.select("clip", "pos", F.col("db").alias("replacement_db")), ["clip", "pos"], "left")
    return both.withColumn("gain_db", gain_db(F.col("db"), F.col("replacement_db")))
