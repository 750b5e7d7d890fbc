"""The edited sound of a clip, block by block, from its timeline: segments get running output positions, and each stretch of output blocks names the
pieces of stretches of source blocks that it is made of, so joins are by equality and no clip is held whole. Samples are arrays of numbers; times are
samples of one rate. Changing the speed of speech and encoding are the adapters' work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspan.functions.signal import BLOCK, FADE_MS, RATE, fade, gap_fade_at, volume_written
from lexspan.operators.scan import MOST, scan

# What counts as silence around speech, and how much of it stays.
QUIET, KEPT_S = 10 ** (-45 / 20), 0.01
#: The number of a clip's own sound beside those of its matches.
OWN = -1
#: Samples to a stretch of blocks, about: short blocks are joined and put together by so many, as rows cost more than samples do.
STRETCH = 1024


def placed(timeline: DataFrame, rate: int = RATE, most: int = MOST) -> DataFrame:
    """The segments with n, their samples, and out_from, where they begin in the output."""
    n = F.greatest(F.lit(0), F.floor((F.col("src_end_ms") - F.col("src_start_ms")) * rate / 1000)).cast("bigint")
    rows = scan(timeline.withColumn("n", n), "clip", ("seq",), most).running_sum(F.col("n"), "out_from").rows
    return rows.withColumn("out_from", F.col("out_from") - F.col("n")).select(*timeline.columns, "n", "out_from")


def speech_bounds(speech: DataFrame, rate: int = RATE, block: int = BLOCK) -> DataFrame:
    """(clip, match_pos, from_, to_) of speech(clip, match_pos, block_no, samples): its samples without the silence before and after."""
    loud = F.filter(F.transform("samples", lambda x, i: F.when(F.abs(x) > QUIET, i)), lambda i: i.isNotNull())
    at = F.col("block_no") * block
    each = speech.select("clip", "match_pos", (at + F.array_min(loud)).alias("first"), (at + F.array_max(loud)).alias("last"), (at + F.size("samples")).alias("end"))
    by = each.groupBy("clip", "match_pos").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.max("end").alias("end"))
    kept = int(KEPT_S * rate)
    return by.where("first is not null").select("clip", "match_pos", F.greatest(F.lit(0), F.col("first") - kept).cast("bigint").alias("from_"), F.least("end", F.col("last") + 1 + kept).cast("bigint").alias("to_"))


def _zeros(n: Column) -> Column:
    return F.array_repeat(F.lit(0.0), n.cast("int"))


_WIDE = "array<double>"


def _slice(samples: Column, first: Column, n: Column) -> Column:
    """n samples from number `first` on, fewer where there are no more, none for null."""
    return F.coalesce(F.slice(samples, (first + 1).cast("int"), F.greatest(F.lit(0), n).cast("int")), F.array().cast(_WIDE))


def stretches(blocks: DataFrame, block: int, per: int) -> DataFrame:
    """(clip, of, stretch, samples) of blocks(clip, of, block_no, samples): `per` blocks as one array, in which a block's samples are in their places;
    what a missing or short block lacks is silent, but for the end."""
    samples = _slice(F.col("samples").cast(_WIDE), F.lit(0), F.lit(block))
    if per == 1:
        return blocks.select("clip", "of", F.col("block_no").cast("bigint").alias("stretch"), samples.alias("samples"))
    rows = blocks.select("clip", "of", F.floor(F.col("block_no") / per).cast("bigint").alias("stretch"), F.pmod("block_no", F.lit(per)).cast("int").alias("k"), samples.alias("samples"))
    by = rows.groupBy("clip", "of", "stretch").agg(F.sort_array(F.collect_list(F.struct("k", "samples"))).alias("each"), F.sum(F.size("samples")).alias("n"))
    last = F.element_at("each", -1)
    whole = (last["k"] + 1 == F.size("each")) & (F.col("n") - F.size(last["samples"]) == last["k"] * block)
    gapless = F.flatten(F.transform("each", lambda x: x["samples"]))
    filled = F.aggregate("each", F.array().cast(_WIDE), lambda a, x: F.concat(a, _zeros(x["k"] * block - F.size(a)), x["samples"]))
    return by.select("clip", "of", "stretch", F.when(whole, gapless).otherwise(filled).alias("samples"))


def render(timeline: DataFrame, blocks: DataFrame, speech: DataFrame, gains: DataFrame, rate: int = RATE, block: int = BLOCK, fade_ms: int = FADE_MS, most: int = MOST) -> DataFrame:
    """(clip, out_block, samples) of timeline(clip, seq, kind, src_start_ms, src_end_ms, match_pos), the clips' own blocks(clip, block_no, samples), their
    speech(clip, match_pos, block_no, samples) and gains(clip, match_pos, gain_db). Gaps fade out, but for the final one; speech loses the silence
    around it, gets its gain and fades, and is padded or cut to its match's length. What has no samples is silent; the last block may be short."""
    per = max(1, STRETCH // block)
    wide = per * block
    # merged, as what comes from exploded rows is more than a plan expects and would be broadcast
    heard = speech_bounds(speech, rate, block).hint("merge").join(gains.select("clip", "match_pos", "gain_db"), ["clip", "match_pos"], "left")
    segments = placed(timeline, rate, most).where("n > 0").hint("merge").join(heard, ["clip", "match_pos"], "left")
    is_speech, is_gap = F.col("kind") == "replacement", F.col("kind").isin("gap", "final")
    duration_ms = F.col("src_end_ms") - F.col("src_start_ms")
    closing = F.when(F.col("kind") == "gap", gap_fade_at(duration_ms, F.lit(fade_ms)))
    both = fade(F.lit(1.0), duration_ms / 1000, fade_ms)
    known = segments.select(
        "clip", "kind", "n", "out_from",
        F.when(is_speech, F.col("match_pos")).when(is_gap, F.lit(OWN)).cast("bigint").alias("of"),
        F.when(is_speech, F.col("from_")).otherwise(F.floor(F.col("src_start_ms") * rate / 1000)).cast("bigint").alias("first"),
        F.when(is_speech, F.coalesce("to_", F.lit(0))).cast("bigint").alias("limit"),
        F.when(is_speech & volume_written(F.col("gain_db")), F.pow(F.lit(10.0), F.bround("gain_db", 2) / 20)).otherwise(F.lit(1.0)).alias("level"),
        F.when(is_speech, both["length"]).otherwise(F.lit(fade_ms / 1000)).alias("fade_s"),
        F.when(is_speech, both["out_at"]).otherwise(closing).alias("out_at"),
    )
    out = known.withColumn("part", F.explode(F.sequence(F.floor(F.col("out_from") / wide), F.floor((F.col("out_from") + F.col("n") - 1) / wide))))
    out = out.withColumn("j", F.greatest(F.lit(0), F.col("part") * wide - F.col("out_from"))).withColumn("size", F.least("n", (F.col("part") + 1) * wide - F.col("out_from")) - F.col("j"))
    # what lies in a stretch of the output lies in one stretch of the source or two
    at = F.coalesce(F.col("first") + F.col("j"), F.lit(0))
    source = out.withColumn("at", at).withColumn("stretch", F.explode(F.sequence(F.floor(F.col("at") / wide), F.floor((F.col("at") + F.col("size") - 1) / wide))))
    begin, end = F.greatest("at", F.col("stretch") * wide), F.least(F.col("at") + F.col("size"), (F.col("stretch") + 1) * wide)
    pieces = source.withColumns({"begin": begin, "length": end - begin}).withColumn("j", F.col("j") + F.col("begin") - F.col("at"))
    # of a piece the first `plain` samples stay as they are (a gap's, up to its fade), what follows up to `sounding` gets its loudness, the rest is silent
    sounding = F.when(F.col("limit").isNull(), F.col("length")).otherwise(F.least("length", F.greatest(F.lit(0), F.col("limit") - F.col("begin"))))
    plain = F.when(F.col("kind") == "replacement", 0).when(F.col("out_at").isNull() | (F.col("fade_s") <= 0), F.col("length")).otherwise(F.least("length", F.greatest(F.lit(0), F.floor(F.col("out_at") * rate) - 1 - F.col("j"))))
    pieces = pieces.withColumns({"sounding": sounding.cast("int"), "plain": plain.cast("int")})
    named = lambda rows, of: rows.select("clip", of.cast("bigint").alias("of"), "block_no", F.col("samples").cast(_WIDE).alias("samples"))
    sounds = stretches(named(blocks, F.lit(OWN)).unionByName(named(speech, F.col("match_pos"))), block, per)
    met = pieces.hint("merge").join(sounds, ["clip", "of", "stretch"], "left")
    there = _slice(F.col("samples"), F.col("begin") - F.col("stretch") * wide, F.col("sounding"))

    def loudness(x: Column, i: Column) -> Column:
        t = (F.col("j") + F.col("plain") + i) / rate
        rising = F.when((F.col("kind") == "replacement") & (F.col("fade_s") > 0), F.least(F.lit(1.0), t / F.col("fade_s"))).otherwise(F.lit(1.0))
        falling = F.when(F.col("out_at").isNotNull() & (F.col("fade_s") > 0) & (t > F.col("out_at")), F.greatest(F.lit(0.0), 1 - (t - F.col("out_at")) / F.col("fade_s"))).otherwise(F.lit(1.0))
        return x * F.col("level") * rising * falling

    cut = met.select("clip", "part", "kind", "out_from", "j", "length", "plain", "level", "fade_s", "out_at", there.alias("there"))
    shaped = F.transform(_slice(F.col("there"), F.col("plain"), F.size("there") - F.col("plain")), loudness)
    own = F.concat(_slice(F.col("there"), F.lit(0), F.col("plain")), shaped, _zeros(F.col("length") - F.size("there")))
    made = cut.select("clip", "part", (F.col("out_from") + F.col("j")).alias("place"), own.alias("own"))
    by = made.groupBy("clip", "part").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("place", "own"))), lambda p: p["own"])).alias("samples"))
    numbers = F.sequence(F.lit(0), F.floor((F.size("samples") - 1) / block).cast("int"))
    each = by.select("clip", "part", "samples", F.explode(numbers).alias("k"))
    return each.select("clip", (F.col("part") * per + F.col("k")).alias("out_block"), F.slice("samples", F.col("k") * block + 1, block).alias("samples"))
