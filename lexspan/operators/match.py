"""Words and lexicon matches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexspan.functions.text import clean_word, strip_white

#: A lexicon is broadcast only if it has no more rows than this.
SMALL = 10_000


def flatten(segments: DataFrame) -> DataFrame:
    """Words of (clip, segments) in order: clip, pos from 0, word, start, end. Null word lists give no rows."""
    one = segments.select("clip", F.posexplode("segments").alias("segment", "x"))
    words = one.select("clip", "segment", F.posexplode("x.words").alias("place", "w"))
    order = W.partitionBy("clip").orderBy("segment", "place")
    return words.select("clip", (F.row_number().over(order) - 1).cast("bigint").alias("pos"), strip_white(F.col("w.word")).alias("word"), "w.start", "w.end")


def timed(words: DataFrame) -> DataFrame:
    """Words that have both times."""
    return words.where("start is not null and end is not null")


def untimed_counts(words: DataFrame) -> DataFrame:
    """By clip, how many words are kept and how many dropped for want of a time."""
    lacks = F.col("start").isNull() | F.col("end").isNull()
    return words.groupBy("clip").agg(F.count_if(~lacks).alias("n_kept"), F.count_if(lacks).alias("n_dropped"))


def numbered(words: DataFrame) -> DataFrame:
    """Adds idx (from 1) and total within the clip."""
    clip = W.partitionBy("clip")
    return words.withColumns({"idx": F.row_number().over(clip.orderBy("pos")).cast("bigint"), "total": F.count(F.lit(1)).over(clip)})


def matches(words: DataFrame, lexicon: DataFrame, small: int = SMALL) -> DataFrame:
    """Words whose cleaned form is a key, with key and replacement. Keys are unique, so a word matches once at most. The lexicon
    is broadcast if a look at its size allows."""
    lex = lexicon.select("key", "replacement")
    if lex.limit(small + 1).count() <= small:
        lex = F.broadcast(lex)
    return words.where(F.col("word").isNotNull()).withColumn("key", clean_word(F.col("word"))).join(lex, "key").select(*words.columns, "key", "replacement")


def live_hits(segments: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Matches of recognised segments; the word stays as it came, leading space included."""
    words = segments.select("clip", F.explode("segments").alias("s")).select("clip", F.explode("s.words").alias("w")).select("clip", "w.*")
    return matches(timed(words), lexicon)


def clean_clips(clips: DataFrame, hits: DataFrame) -> DataFrame:
    """Clips without a match."""
    return clips.join(hits.select("clip"), "clip", "left_anti")


def hit_counts(hits: DataFrame) -> DataFrame:
    return hits.groupBy("clip").agg(F.count(F.lit(1)).alias("n_hits"))


def hit_words(hits: DataFrame) -> DataFrame:
    """By clip the matched words in list order."""
    return hits.groupBy("clip").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]).alias("words"))


def top_hits(hits: DataFrame, n: int = 5) -> DataFrame:
    """The first n matches of each clip in list order, and how many more it has."""
    clip = W.partitionBy("clip")
    ranked = hits.withColumns({"rank": F.row_number().over(clip.orderBy("pos")).cast("bigint"), "more": F.greatest(F.count(F.lit(1)).over(clip) - n, F.lit(0))})
    return ranked.where(F.col("rank") <= n).select("clip", "rank", "word", "replacement", "more")


def spans(words: DataFrame) -> DataFrame:
    """By clip the number of words and the time from the first one's start to the last one's end, in list order."""
    by = words.groupBy("clip").agg(F.count(F.lit(1)).alias("n_words"), F.min_by("start", "pos").alias("first_start"), F.max_by("end", "pos").alias("last_end"))
    return by.withColumn("span", F.col("last_end") - F.col("first_start"))


def speech_requests(hits: DataFrame) -> DataFrame:
    """The distinct replacement texts to synthesise; empty ones need no speech."""
    return hits.where("replacement <> ''").select("replacement").distinct()
