"""Streams whose rows come late, delayed gating and recognition in a stream, against their batch twins."""

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexspan import queries
from lexspan.operators import live
from lexspan.streaming import live as streams


def same(a, b):
    b = b.select(*a.columns)
    assert a.count() == b.count() > 0
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_played_blocks_and_late_rows(spark, small):
    """Delays of several lengths; the state's rows and a key that falls silent are released by another key's heartbeats."""
    rows = queries.mute_events(spark, small).withColumn("key", F.col("key") % 50)
    for delay in (0.0, 40.0):
        made = queries._jittered(spark, small, lambda r: streams.played_blocks(r.withColumn("dur_us", F.when(F.col("id") % 3 == 0, F.col("dur_us"))), delay, "2 minutes"))  # noqa: B023
        twin = live.gate(rows.where("id % 3 <> 0"), rows.where("id % 3 = 0"), int(delay * 1_000_000))
        same(made.select("key", "id", "now_us", "muted"), twin)
    muted = made.where("muted").count()
    assert 0 < muted < made.count()
    same(queries.stream_mute_late(spark, small), live.deadlines(rows))


def test_recognition_in_a_stream(spark, small):
    blocks = queries._sampled(spark, small)
    n = (F.row_number().over(W.partitionBy("key").orderBy("now_us", "id")) - 1).cast("bigint")
    chunks = live.sample_chunks(blocks.withColumn("n", n), 16)
    twin = streams.spoken_hits(chunks, queries._threshold_ear, queries.lexicon.fixture(spark))
    streamed = queries.stream_recognised(spark, small)
    same(streamed, twin.withColumn("start_s", F.round("start", 6)))
    errors = queries.adapters.recognise_samples(chunks, queries._threshold_ear)
    assert errors.where("error like 'ValueError: % loud samples'").count() == errors.where("segments is null").count() > 0


def test_uneven_blocks_make_chunks_without_a_remainder(spark, tmp_path):
    rows = [(1, i, i * 10, [float(i)] * (1 + i % 5)) for i in range(60)] + [(2, 0, 5, None), (2, 1, 6, [1.0] * 100)]
    frame = spark.createDataFrame(rows, "key bigint, id bigint, now_us bigint, samples array<float>").withColumn("at_us", F.col("now_us"))
    found = queries._run(streams.sample_chunks(queries._dropped(frame, str(tmp_path), [70, 71, 333]), 10.0, rate=1), str(tmp_path)).collect()
    want, held, first, chunk = [], [], None, 0
    for _, _, t, samples in rows[:60]:
        first = t if first is None else first
        held += samples
        if len(held) >= 10:
            want.append((1, chunk, first, t, held))
            held, first, chunk = [], None, chunk + 1
    assert sorted(map(tuple, found)) == [*want, (2, 0, 5, 6, [1.0] * 100)]


def test_a_restarted_stream_goes_on(spark, tmp_path):
    """The same checkpoint, more files: held blocks and deadlines of the first run take part in the second."""
    rows = [(1, i, i * 500_000, 700_000 if i % 4 == 0 else None) for i in range(40)]
    frame = spark.createDataFrame(rows, "key bigint, id bigint, now_us bigint, dur_us bigint").withColumn("at", F.timestamp_micros("now_us"))
    end = spark.createDataFrame([(9, None, 10**9, None)], "key bigint, id bigint, now_us bigint, dur_us bigint").withColumn("at", F.timestamp_micros("now_us"))
    for part in (frame.where("id < 17"), frame.where("id >= 17").unionByName(end)):
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        out = queries._run(streams.played_blocks(spark.readStream.schema(frame.schema).parquet(f"{tmp_path}/in"), 2.0, "1 second"), str(tmp_path))
    same(out.select("key", "id", "now_us", "muted"), live.gate(frame.where("dur_us is null"), frame.where("dur_us is not null"), 2_000_000))


@pytest.mark.parametrize("delay", [0.5, 3.0])
def test_live_chain_with_delay(spark, small, tmp_path, delay):
    words = queries.words_of(spark, small).select(F.col("clip").cast("bigint").alias("key"), F.col("pos").alias("id"), "word", "start", "end", (F.round(F.col("start") * 1e6) + 1_000_000).cast("bigint").alias("now_us"))
    end = spark.createDataFrame([(-1, None, None, None, None, 10**12)], "key bigint, id bigint, word string, start double, end double, now_us bigint")
    rows = words.unionByName(end).withColumn("at", F.timestamp_micros("now_us"))
    arriving = queries._dropped(rows.withColumn("at_us", F.col("now_us")), str(tmp_path), [9_000_000, 10**12])
    out = queries._run(streams.muted_live(arriving, arriving.select("key", "id", "at", "now_us"), queries.lexicon.fixture(spark), delay), str(tmp_path))
    hits = queries.hits_of(spark, small).select(F.col("clip").cast("bigint").alias("key"), F.col("pos").alias("id"), (F.round(F.col("start") * 1e6) + 1_000_000).cast("bigint").alias("now_us"), F.round((F.col("end") - F.col("start")) * 1e6).cast("bigint").alias("dur_us"))
    same(out.select("key", "id", "now_us", "muted"), live.gate(words, hits, int(delay * 1e6)))
