"""Live muting as batch operators; the streaming forms give the same results. Times are whole microseconds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspan.functions.signal import BLOCK, LEAST_MUTE_S, RATE, tone_at
from lexspan.operators.scan import MOST, scan


_ORDER = ("now_us", "id")


def deadlines(hits: DataFrame, most: int = MOST) -> DataFrame:
    """hits(key, id, now_us, dur_us) with until_us, the running latest end of muting, and island, which counts from 1 the
    windows that do not touch. Keys of over `most` hits are scanned in segments of time."""
    least = F.lit(int(LEAST_MUTE_S * 1_000_000)).cast("bigint")
    rows = scan(hits, "key", _ORDER, most).running_max(F.col("now_us") + F.greatest(least, F.col("dur_us")), "until_us").lagged(F.col("until_us"), "_until")
    rows = rows.running_sum(F.when(F.col("now_us") >= F.col("_until"), 1).otherwise(0), "island").rows
    return rows.withColumn("island", (F.col("island") + 1).cast("bigint")).select(*hits.columns, "until_us", "island")


def windows(hits: DataFrame, most: int = MOST) -> DataFrame:
    """One row an island: key, island, from_us, until_us, n_hits."""
    return deadlines(hits, most).groupBy("key", "island").agg(F.min("now_us").alias("from_us"), F.max("until_us").alias("until_us"), F.count(F.lit(1)).alias("n_hits"))


def gate(blocks: DataFrame, hits: DataFrame, delay_us: int = 0, most: int = MOST, carried: tuple[str, ...] = ()) -> DataFrame:
    """blocks(key, id, now_us) with the `carried` columns and muted: whether a deadline set at or before the time that the block plays, `delay_us` after
    now_us, is later than it. Both go through one ordered scan, whose running maximum is the deadline, so no pair of block and hit is made."""
    least = F.lit(int(LEAST_MUTE_S * 1_000_000)).cast("bigint")
    marks = hits.select("key", "id", "now_us", F.lit(0).alias("kind"), (F.col("now_us") + F.greatest(least, F.col("dur_us"))).alias("until_us"))
    playing = blocks.select("key", "id", (F.col("now_us") + delay_us).alias("now_us"), F.lit(1).alias("kind"), F.lit(None).cast("bigint").alias("until_us"), *carried)
    both = scan(playing.unionByName(marks, allowMissingColumns=True), "key", ("now_us", "kind", "id"), most)
    seen = both.running_max(F.col("until_us"), "until").rows.where("kind = 1")
    return seen.select("key", "id", (F.col("now_us") - delay_us).alias("now_us"), *carried, F.coalesce(F.col("now_us") < F.col("until"), F.lit(False)).alias("muted"))


def sounded(blocks: DataFrame, beep: bool = False) -> DataFrame:
    """blocks(muted, samples) as they are heard: silence, or the tone, in place of each muted one's samples."""
    silence = F.transform("samples", lambda x: F.lit(0.0))
    tone = F.when(F.size("samples") > 0, F.transform(F.sequence(F.lit(1), F.size("samples")), lambda i: tone_at(i - 1))).otherwise(silence)
    return blocks.withColumn("samples", F.when(F.col("muted"), tone if beep else silence).otherwise(F.col("samples").cast("array<double>")))


def delayed(samples: DataFrame, delay: int, most: int = MOST) -> DataFrame:
    """samples(key, n, value) with out, the value `delay` samples before, 0.0 at first."""
    return scan(samples, "key", ("n",), most).shifted(F.col("value"), max(1, delay), "out", F.lit(0.0)).rows.select(*samples.columns, "out")


def delay_samples(seconds: float) -> int:
    return max(1, int(seconds * RATE))


def blocks_per_chunk(seconds: float = 1.0, block: int = BLOCK) -> int:
    """Blocks that fill a chunk: 16 of 1024 samples for 1.0 s."""
    return max(1, -(-int(seconds * RATE) // block))


def chunks(blocks: DataFrame, per_chunk: int, samples: int = BLOCK) -> DataFrame:
    """Tumbling chunks of equal blocks(key, n), n from 0: key, chunk, n_blocks, n_samples, first_sample (of the key's stream). A
    chunk that is not full is still in the buffer and gives no row."""
    by = blocks.groupBy("key", F.floor(F.col("n") / per_chunk).alias("chunk")).agg(F.count(F.lit(1)).alias("n_blocks"))
    rows = by.where(F.col("n_blocks") == per_chunk)
    return rows.select("key", "chunk", "n_blocks", (F.col("n_blocks") * samples).alias("n_samples"), (F.col("chunk") * per_chunk * samples).alias("first_sample"))


def sample_chunks(blocks: DataFrame, per_chunk: int) -> DataFrame:
    """Chunks of equal blocks(key, n, now_us, samples), n from 0, with their samples as one array: key, chunk, first_us, last_us, samples. A chunk that is
    not full gives no row."""
    by = blocks.groupBy("key", F.floor(F.col("n") / per_chunk).alias("chunk")).agg(F.sort_array(F.collect_list(F.struct("n", "samples"))).alias("parts"), F.min("now_us").alias("first_us"), F.max("now_us").alias("last_us"))
    return by.where(F.size("parts") == per_chunk).select("key", "chunk", "first_us", "last_us", F.flatten("parts.samples").alias("samples"))


def simulate(hits: DataFrame, clips: DataFrame) -> DataFrame:
    """By clip with matches: their number, the plain sum of their durations (overlaps count twice), and its share of duration_s."""
    by = hits.groupBy("clip").agg(F.count(F.lit(1)).alias("n_muted"), F.sum(F.col("end") - F.col("start")).alias("muted_s"))
    return by.join(clips.select("clip", "duration_s"), "clip").withColumn("share", 100 * F.col("muted_s") / F.nullif(F.col("duration_s"), F.lit(0.0)))


#: Blocks to a stretch of overlapping_blocks.
STRETCH = 64


def overlapping_blocks(ranges: DataFrame, blocks: DataFrame, length_us: int) -> DataFrame:
    """ranges(key, id, from_us, until_us) with the blocks(key, block_no) of equal length that they touch: each range names the stretches of 64 blocks that
    it touches, so the join is by equality, and of its two outer stretches the blocks that it does not reach go. Both sides are merged whatever their size:
    rows that an array is made into are many more than a plan expects, and must not be broadcast."""
    first, last = F.floor(F.col("from_us") / length_us), F.floor((F.col("until_us") - 1) / length_us)
    named = ranges.where("until_us > from_us").withColumn("_stretch", F.explode(F.sequence(F.floor(first / STRETCH), F.floor(last / STRETCH))))
    dealt = blocks.withColumn("_stretch", F.floor(F.col("block_no") / STRETCH))
    return named.hint("merge").join(dealt, ["key", "_stretch"]).where((F.col("block_no") >= first) & (F.col("block_no") <= last)).drop("_stretch")
