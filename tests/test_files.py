"""Transcript files, the commit log, the speech store and the listener."""

import json

import pytest
from pyspark.sql import functions as F

from lexspan import queries
from lexspan.plans import slices
from lexspan.sources import adapters, files, transcripts
from lexspan.streaming import live as streams


def test_files_are_plain_lists_and_come_back(spark, tmp_path):
    rows = [(f"clip {c}", p, f"wörd{p}", p / 3, None if p == 2 else p / 2, "x") for c in range(300) for p in range(4)]
    words = spark.createDataFrame(rows, "clip string, pos bigint, word string, start double, end double, replacement string").repartition(7)
    files.write_files(transcripts.as_json(words, "word", "start", "end", "replacement"), f"{tmp_path}/w", "matches")
    assert json.load(open(tmp_path / "w" / "clip 7.json"))[1] == {"word": "wörd1", "start": 1 / 3, "end": 0.5, "replacement": "x"}
    back = files.read_files(spark, f"{tmp_path}/w", "matches")
    assert sorted(map(tuple, back.collect()), key=str) == sorted(rows, key=str)
    assert back.rdd.getNumPartitions() <= 8
    # what no commit names is not read; a folder of others' files is read without an index
    (tmp_path / "w" / "stray.json").write_text('[{"word": "stray"}]')
    assert back.where("clip = 'stray'").isEmpty()
    other = tmp_path / "other"
    other.mkdir()
    (other / "a.json").write_text('[{"word": "x", "start": 1, "end": 2}, 5, {"word": 7}, {"start": 1.5}]')
    assert [tuple(r) for r in files.read_files(spark, str(other)).collect()] == [("a", 0, "x", 1.0, 2.0), ("a", 3, None, 1.5, None)]
    (other / "b.json").write_text("{}")
    assert files.read_files(spark, str(other), strict=False).count() == 2
    with pytest.raises(Exception, match="not a list"):
        files.read_files(spark, str(other)).collect()


def test_files_of_none_and_of_bad_names(spark, tmp_path):
    none = spark.createDataFrame([], "clip string, value string")
    files.write_files(none, f"{tmp_path}/n")
    assert files.read_files(spark, f"{tmp_path}/n").count() == 0
    with pytest.raises(Exception, match="no file's name"):
        files.write_files(spark.createDataFrame([("../a", "[]")], "clip string, value string"), f"{tmp_path}/bad")


def test_a_killed_run_goes_on(spark, tmp_path):
    inputs = spark.range(100).select(F.concat(F.lit("f"), "id").alias("relative"))
    log, shape, calls = f"{tmp_path}/log", "relative string, run int", []

    def work(run, stop):
        def do(part):
            calls.append(run)
            if len([c for c in calls if c == run]) > stop:
                raise KeyboardInterrupt
            return part.select("relative", F.lit(run).alias("run"))

        return do

    with pytest.raises(KeyboardInterrupt):
        slices.in_slices(inputs, work(1, 3), log, shape, slices=8)
    before = {r["relative"] for r in slices.committed(spark, log, shape).collect()}
    assert 0 < len(before) < 100
    rows = slices.in_slices(inputs, work(2, 99), log, shape, slices=5).collect()
    assert sorted(r["relative"] for r in rows) == sorted(f"f{i}" for i in range(100))
    assert {r["relative"] for r in rows if r["run"] == 1} == before
    assert slices.in_slices(inputs, work(3, 99), log, shape, slices=2).where("run = 3").isEmpty()


def test_speech_is_made_once(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def make():
        def say(text):
            calls.add(1)
            if text == "bad":
                raise ValueError("no voice")
            return text.encode() * 100

        return say

    texts = spark.createDataFrame([("one",), ("two",), ("one",), ("bad",), (None,)], "replacement string")
    found = {r["replacement"]: (bytes(r["audio"]) if r["audio"] else None, r["error"]) for r in adapters.speech_store(texts, make, f"{tmp_path}/store").collect()}
    assert found == {"one": (b"one" * 100, None), "two": (b"two" * 100, None), "bad": (None, "ValueError: no voice")}
    assert calls.value == 3
    again = adapters.speech_store(texts.where("replacement <> 'bad'"), make, f"{tmp_path}/store")
    assert again.count() == 2 and calls.value == 3
    assert adapters.speech_store(texts.where("replacement <> 'bad'"), make, f"{tmp_path}/store", voice="other").count() == 2
    assert calls.value == 5


def test_a_listener_adds_up_what_the_stream_gives(spark, small):
    said = []
    totals = streams.Totals(said.append)
    spark.streams.addListener(totals)
    try:
        out = queries._streamed(spark, small, lambda rows: streams.observed(streams.gated_blocks(rows.withColumn("dur_us", F.when(F.col("id") % 3 == 0, F.col("dur_us"))))))
        n, muted = out.count(), out.where("muted").count()
        for _ in range(100):
            if totals.totals.get("n_rows") == n:
                break
            __import__("time").sleep(0.1)
    finally:
        spark.streams.removeListener(totals)
    assert totals.totals == {"n_rows": n, "n_muted": muted}
    assert len(said) >= 3
