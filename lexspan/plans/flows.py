"""The file flow, the batch flow and the simulation, as one lazy lineage each with adapters at the edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspan.functions.signal import FADE_MS
from lexspan.functions.text import path_key
from lexspan.operators import live, loudness, manifest, match, timeline


def edit_plan(words: DataFrame, lexicon: DataFrame, clips: DataFrame, files: DataFrame | None = None, lead_in: int | None = None, blocks: DataFrame | None = None, spoken: DataFrame | None = None, fade_ms: int = FADE_MS) -> dict[str, DataFrame]:
    """From words and clips(clip, total_ms): hits, the distinct speech to make, the timeline, its fades, clips to copy as they are, and with the decoded
    blocks(clip, block_no, samples) and the loudness of the speech, spoken(clip, pos, db), each match's gain."""
    hits = timeline.with_ms(match.matches(match.timed(words), lexicon))
    used = timeline.available(hits, files) if files is not None else hits
    line = timeline.segments(used, clips, lead_in)
    plan = {} if blocks is None else {"gains": loudness.gains(loudness.range_volume(used.select("clip", "pos", "start", "end"), blocks), spoken if spoken is not None else used.select("clip", "pos", F.lit(None).cast("double").alias("db")))}
    return plan | {
        "hits": hits,
        "speech": match.speech_requests(hits),
        "timeline": line,
        "gap_fades": timeline.gap_fades(line, fade_ms),
        "replacement_fades": timeline.replacement_fades(line, fade_ms),
        "clean": match.clean_clips(clips.select("clip"), hits),
    }


def batch_manifest(inputs: DataFrame, done: DataFrame, segments: DataFrame, lexicon: DataFrame, files: DataFrame, skip_existing: bool = True) -> DataFrame:
    """The manifest of inputs(clip, relative): those with an output are skipped; segments(clip, segments, error) come from the
    recogniser."""
    have = done.select("relative").distinct().withColumn("skipped", F.lit(True))
    rows = inputs.join(have, "relative", "left").withColumn("skipped", F.coalesce("skipped", F.lit(False)) & F.lit(skip_existing))
    hits = timeline.with_ms(match.matches(match.timed(match.flatten(segments.where("error is null"))), lexicon))
    item = F.struct("pos", F.struct("word", "replacement", "start", "end").alias("x"))
    found = hits.groupBy("clip").agg(F.transform(F.sort_array(F.collect_list(item)), lambda i: i["x"]).alias("replacements"))
    found = found.withColumn("words_found", F.transform("replacements", lambda x: x["word"]))
    spliced = timeline.splice_counts(hits, files).select("clip", F.col("spliced"), F.col("skipped").alias("skipped_splice"))
    return manifest.records(rows.join(segments.select("clip", "error"), "clip", "left").join(found, "clip", "left").join(spliced, "clip", "left"))


def batch(segments: DataFrame, lexicon: DataFrame, files: DataFrame, done: DataFrame, skip_existing: bool = False, continue_on_error: bool = False) -> DataFrame:
    """The manifest of segments(clip, segments, error), in path order: up to the first error, which is included, or on to the end."""
    inputs = manifest.numbered(segments.select("clip", F.concat("clip", F.lit(".json")).alias("relative")), path_key(F.col("relative")), "clip")
    rows = batch_manifest(inputs.select("clip", "relative"), done, segments, lexicon, files, skip_existing)
    placed = rows.join(inputs.select("clip", "idx"), "clip").withColumn("failed", F.col("status") == "error")
    return manifest.until_failure(placed, keep_going=continue_on_error).drop("failed")


def simulate(segments: DataFrame, lexicon: DataFrame, clips: DataFrame) -> DataFrame:
    """The live filter over whole clips."""
    return live.simulate(match.live_hits(segments, lexicon), clips)
