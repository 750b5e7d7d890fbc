"""python -m lexspan: the relational steps from the command line.

  discover PATH            media files at or under PATH, in path order
  match WORDS OUT          transcripts (JSON lists) to matches; --limit, --lexicon
  plan WORDS OUT           transcripts to the edit timeline; --lead-in-ms, --total-ms, --files (a folder of generated clips)
  simulate WORDS           muted words, seconds and share of each clip
  batch WORDS OUT          the manifest of a folder of transcripts, as JSON lines, up to the first that fails; --continue-on-error, --skip-existing (by
                           the manifest in OUT), --copy-clean (OUT-copied lists the originals to copy), --dry-run (each match as OK or MISSING, nothing written),
                           --log FOLDER (clips go in slices whose records are committed there, errors too; a run that was killed goes on)
  status MANIFEST          records by status

Exit codes: 0 done, 1 failed, 2 input missing.
"""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspan.functions.signal import FADE_MS
from lexspan.functions.text import name, parent, to_ms
from lexspan.operators import live, manifest, match, timeline
from lexspan.plans import flows, slices
from lexspan.schema import MANIFEST
from lexspan.sources import catalog, lexicon, transcripts
from lexspan.work import new_path


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    top = argparse.ArgumentParser(prog="lexspan")
    steps = top.add_subparsers(dest="step", required=True)
    one = steps.add_parser("discover")
    one.add_argument("path")
    for step in ("match", "plan", "simulate", "batch"):
        one = steps.add_parser(step)
        one.add_argument("words", help="a transcript or a folder of transcripts")
        if step != "simulate":
            one.add_argument("out")
            one.add_argument("--skip-existing", action="store_true", help="leave clips that OUT already has")
        one.add_argument("--lexicon", help="tab-separated key, replacement; default: the packaged one")
        one.add_argument("--limit", type=int, help="at most so many clips; 0: all")
        if step in ("plan", "batch"):
            one.add_argument("--files", help="folder clip/filename of generated audio; matches without a file are skipped")
        if step == "batch":
            one.add_argument("--continue-on-error", action="store_true")
            one.add_argument("--copy-clean", action="store_true")
            one.add_argument("--dry-run", action="store_true")
            one.add_argument("--log", help="a folder where what is done is committed slice by slice, and where a later run goes on")
            one.add_argument("--slices", type=int, default=16)
        if step == "plan":
            one.add_argument("--crossfade-ms", type=int, default=FADE_MS, help="length of the fades of gaps; 0: none")
            one.add_argument("--lead-in-ms", type=int, help="the same for all words; default: by first letter")
            one.add_argument("--total-ms", type=int, help="length of every clip; default: the last word's end")
    one = steps.add_parser("status")
    one.add_argument("manifest")
    return top.parse_args(argv)


def _words(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    words = transcripts.read_words(spark, args.words)
    if args.limit:
        words = words.join(manifest.first_n(words.select("clip").distinct(), args.limit, "clip"), "clip", "left_semi")
    if getattr(args, "skip_existing", False):
        try:
            done = spark.read.parquet(args.out).select("clip").distinct()
        except AnalysisException:
            return words
        words = manifest.pending(words, done, "clip")
    return words


def _files(spark: SparkSession, folder: str) -> DataFrame:
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path")
    return found.select(name(parent(F.col("path"))).alias("clip"), name(F.col("path")).alias("filename"))


def _batch(spark: SparkSession, args: argparse.Namespace, lex: DataFrame) -> DataFrame:
    segments = transcripts.read_segments(spark, args.words)
    if args.limit:
        segments = segments.join(manifest.first_n(segments.select("clip"), args.limit, "clip"), "clip", "left_semi")
    hits = timeline.with_ms(match.matches(match.timed(match.flatten(segments.where("error is null"))), lex))
    files = _files(spark, args.files) if args.files else hits.select("clip", "filename")
    if args.dry_run:
        return manifest.dry_run(hits, files)
    try:
        done = transcripts.read_manifest(spark, args.out).where("relative is not null and status <> 'error'")
    except AnalysisException:
        done = spark.createDataFrame([], "relative string")
    if args.log:
        inputs = segments.withColumn("relative", F.concat("clip", F.lit(".json")))
        none = spark.createDataFrame([], "relative string")
        rows = slices.in_slices(inputs, lambda part: flows.batch(part.drop("relative"), lex, files, none, False, True).drop("idx"), args.log, MANIFEST, slices=args.slices)
    else:
        rows = flows.batch(segments, lex, files, done, args.skip_existing, args.continue_on_error).drop("idx")
    new = new_path(spark, "manifest")
    transcripts.write_manifest(rows, new)  # what was there is read until the new one is whole
    rows = transcripts.read_manifest(spark, new)
    rows.write.mode("append" if args.skip_existing else "overwrite").json(args.out)
    if args.copy_clean:
        manifest.copied(rows, True).write.mode("overwrite").json(f"{args.out.rstrip('/')}-copied")
    return rows.select("clip", "status", "error", "spliced", "skipped_splice", "relative")


def run(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """The step's rows; match and plan also write them, as Parquet."""
    if args.step == "discover":
        return catalog.in_path_order(catalog.media(spark, args.path))
    if args.step == "status":
        return manifest.counts(transcripts.read_manifest(spark, args.manifest))
    lex = lexicon.from_tsv(spark, args.lexicon) if args.lexicon else lexicon.packaged(spark)
    if args.step == "batch":
        return _batch(spark, args, lex)
    words = match.timed(_words(spark, args))
    hits = timeline.with_ms(match.matches(words, lex))
    ends = words.groupBy("clip").agg(F.max("end").alias("duration_s"))
    if args.step == "simulate":
        return live.simulate(hits, ends)
    out = hits
    if args.step == "plan":
        if args.files:
            hits = timeline.available(hits, _files(spark, args.files))
        total = F.lit(args.total_ms).cast("bigint") if args.total_ms is not None else to_ms(F.col("duration_s"))
        out = timeline.segments(hits, ends.select("clip", total.alias("total_ms")), args.lead_in_ms)
        out = out.join(timeline.gap_fades(out, args.crossfade_ms).select("clip", "seq", "fade_at"), ["clip", "seq"], "left")
    out.write.mode("append" if args.skip_existing else "overwrite").parquet(args.out)
    return spark.read.schema(out.schema).parquet(args.out)


def main(argv: list[str] | None = None) -> int:
    args = arguments(argv)
    spark = SparkSession.builder.appName("lexspan").getOrCreate()
    source = getattr(args, "words", None) or getattr(args, "path", None) or args.manifest
    if "://" not in source and not os.path.exists(source):
        print(f"no such input: {source}", file=sys.stderr)
        return 2
    try:
        run(spark, args).show(50, truncate=False)
    except (AnalysisException, ValueError) as e:
        print(f"{type(e).__name__}: {str(e)[:300]}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
