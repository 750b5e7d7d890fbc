"""The edit timeline of a clip. Everything is ordered scans by clip; the state that an edit carries to the next is the last end time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexspan.functions.signal import FADE_MS, fade, gap_fade_at, lead_in_ms
from lexspan.functions.text import clean_word, clip_filename, concat_line, to_ms
from lexspan.operators.scan import MOST, scan


def with_ms(hits: DataFrame) -> DataFrame:
    """start_ms, end_ms and the generated file's name; missing times count as zero, missing replacements as empty."""
    start, end = to_ms(F.coalesce("start", F.lit(0.0))), to_ms(F.coalesce("end", F.lit(0.0)))
    return hits.withColumns({"start": F.coalesce("start", F.lit(0.0)), "start_ms": start, "end_ms": end}).withColumn("filename", clip_filename(F.col("start_ms"), F.col("end_ms"), F.coalesce("replacement", F.lit(""))))


def available(hits: DataFrame, files: DataFrame) -> DataFrame:
    """Matches whose file exists: files(clip, filename)."""
    return hits.join(files.select("clip", "filename"), ["clip", "filename"], "left_semi")


def missing(hits: DataFrame, files: DataFrame) -> DataFrame:
    return hits.join(files.select("clip", "filename"), ["clip", "filename"], "left_anti")


def splice_counts(hits: DataFrame, files: DataFrame) -> DataFrame:
    """By clip how many matches are spliced and how many skipped for want of a file, and whether the clip is fully censored."""
    seen = hits.join(files.select("clip", "filename").distinct().withColumn("there", F.lit(True)), ["clip", "filename"], "left")
    by = seen.groupBy("clip").agg(F.count_if("there").alias("spliced"), F.count_if(F.col("there").isNull()).alias("skipped"))
    return by.withColumn("fully_censored", F.col("skipped") == 0)


def padded(hits: DataFrame, lead_in: int | None = None, most: int = MOST) -> DataFrame:
    """prev_end (the end of the match before, 0 at first), pad (where the lead-in starts, not before prev_end) and lead_actual,
    which is negative where matches overlap. Clips of over `most` matches are scanned in segments of time."""
    rows = scan(hits, "clip", ("start", "pos"), most).lagged(F.col("end_ms"), "prev_end").rows.select(*hits.columns, "prev_end")
    rows = rows.withColumn("prev_end", F.coalesce("prev_end", F.lit(0)).cast("bigint"))
    rows = rows.withColumn("pad", F.greatest("prev_end", F.col("start_ms") - lead_in_ms(clean_word(F.col("word")), lead_in)))
    return rows.withColumn("lead_actual", F.col("start_ms") - F.col("pad"))


def gaps(rows: DataFrame) -> DataFrame:
    return rows.where("pad > prev_end").select("clip", "pos", F.col("prev_end").alias("gap_start"), F.col("pad").alias("gap_end"))


def silences(rows: DataFrame) -> DataFrame:
    return rows.where("lead_actual > 0").select("clip", "pos", F.col("pad").alias("silence_start"), F.col("start_ms").alias("silence_end"))


def final_gaps(hits: DataFrame, clips: DataFrame) -> DataFrame:
    """What remains after the last match (in order, not the latest end): one row for each of clips(clip, total_ms) that has a
    remainder, those without matches included."""
    last = hits.groupBy("clip").agg(F.max_by("end_ms", F.struct("start", "pos")).alias("last_end"))
    rows = clips.join(last, "clip", "left").withColumn("final_start", F.coalesce("last_end", F.lit(0)).cast("bigint"))
    return rows.where("final_start < total_ms").select("clip", "final_start", F.col("total_ms").alias("final_end"))


def _segment(kind: str, start: Column, end: Column, when: Column) -> Column:
    return F.when(when, F.struct(F.lit(kind).alias("kind"), start.alias("src_start_ms"), end.alias("src_end_ms")))


def segments(hits: DataFrame, clips: DataFrame, lead_in: int | None = None) -> DataFrame:
    """clip, seq, kind (gap, silence, replacement, final), src_start_ms, src_end_ms, match_pos: gap, silence and replacement for
    each match in order, then what remains of clips(clip, total_ms). A clip's end is one more row behind its matches, so matches and
    ends go through one shuffle and clips without matches need no outer join."""
    rows = hits.select("clip", F.lit(0).alias("last"), "start", "pos", "word", "start_ms", "end_ms", F.lit(None).cast("bigint").alias("total_ms"))
    ends = clips.select("clip", F.lit(1).alias("last"), F.col("total_ms").cast("bigint").alias("total_ms"))
    order = W.partitionBy("clip").orderBy("last", "start", "pos")
    both = rows.unionByName(ends, allowMissingColumns=True).withColumn("prev_end", F.coalesce(F.lag("end_ms").over(order), F.lit(0)).cast("bigint"))
    both = both.withColumn("pad", F.greatest("prev_end", F.col("start_ms") - lead_in_ms(clean_word(F.col("word")), lead_in)))
    is_match = F.col("last") == 0
    parts = F.array(
        _segment("gap", F.col("prev_end"), F.col("pad"), is_match & (F.col("pad") > F.col("prev_end"))),
        _segment("silence", F.col("pad"), F.col("start_ms"), is_match & (F.col("start_ms") > F.col("pad"))),
        _segment("replacement", F.col("start_ms"), F.col("end_ms"), is_match),
        _segment("final", F.col("prev_end"), F.col("total_ms"), ~is_match & (F.col("total_ms") > F.col("prev_end"))),
    )
    each = both.select("clip", "last", "start", "pos", F.posexplode(F.array_compact(parts)).alias("part", "x"))
    seq = F.row_number().over(W.partitionBy("clip").orderBy("last", "start", "pos", "part")) - 1
    return each.select("clip", seq.cast("bigint").alias("seq"), "x.kind", "x.src_start_ms", "x.src_end_ms", F.col("pos").alias("match_pos"))


def gap_fades(timeline: DataFrame, fade_ms: int = FADE_MS) -> DataFrame:
    """duration_ms and the closing fade's start of gaps; what remains at the end has no fade."""
    rows = timeline.where("kind in ('gap', 'final')").withColumn("duration_ms", F.col("src_end_ms") - F.col("src_start_ms"))
    ms = F.when(F.col("kind") == "final", F.lit(0)).otherwise(F.lit(fade_ms))
    return rows.where("duration_ms > 0").select("clip", "seq", "kind", "duration_ms", gap_fade_at(F.col("duration_ms"), ms).alias("fade_at"))


def replacement_fades(timeline: DataFrame, fade_ms: int = FADE_MS) -> DataFrame:
    """target_s, fade length and closing fade's start of replacements; targets of zero or less are not padded."""
    target = (F.col("src_end_ms") - F.col("src_start_ms")) / 1000
    rows = timeline.where("kind = 'replacement'").withColumn("target_s", target)
    f = fade(F.lit(1.0), F.col("target_s"), fade_ms)
    return rows.select("clip", "seq", "target_s", f["length"].alias("fade_s"), f["out_at"].alias("fade_out_at"), (F.col("target_s") > 0).alias("padded"))


def concat_list(timeline: DataFrame, folder: str = "segments") -> DataFrame:
    """The concatenation list: clip, seq, line."""
    path = F.format_string(f"{folder}/%s/%06d_%s.wav", F.col("clip"), F.col("seq"), F.col("kind"))
    return timeline.select("clip", "seq", concat_line(path).alias("line"))
