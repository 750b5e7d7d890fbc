"""Golden vectors and properties of matching, timelines, live muting and manifests."""

import hashlib
import os

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexspan.operators import live, manifest, match, timeline
from lexspan.plans import flows
from lexspan.sources import adapters, catalog, lexicon, transcripts

WORDS = "clip string, pos bigint, word string, start double, end double"


def words(spark, *rows):
    return spark.createDataFrame([("c", i, *r) for i, r in enumerate(rows)], WORDS)


def hits(spark, *rows):
    return timeline.with_ms(match.matches(words(spark, *rows), lexicon.packaged(spark)))


def cuts(spark, found, total=10_000):
    clips = spark.createDataFrame([("c", total)], "clip string, total_ms bigint")
    return [(r["kind"][0], r["src_start_ms"], r["src_end_ms"]) for r in timeline.segments(found, clips).orderBy("seq").collect()]


def test_lexicon_is_whole():
    rows = lexicon.packaged_rows()
    said = "".join(f"{k}\t{v}\n" for k, v, _ in sorted(rows))
    assert len(rows) == 150
    assert hashlib.sha256(said.encode()).hexdigest() == "f3751bca60d01fcde5d13a501277dceda9039a6c7afeb81f2ed70a1a3c4f2936"


def test_timeline_plain(spark):
    found = hits(spark, ("damn", 1.0, 1.4), ("shit", 2.0, 2.5), ("ass", 2.52, 2.9))
    assert cuts(spark, found) == [("g", 0, 1000), ("r", 1000, 1400), ("g", 1400, 1950), ("s", 1950, 2000), ("r", 2000, 2500), ("s", 2500, 2520), ("r", 2520, 2900), ("f", 2900, 10000)]


def test_timeline_missing_file(spark):
    found = hits(spark, ("damn", 1.0, 1.4), ("shit", 2.0, 2.5), ("ass", 3.0, 3.2))
    files = found.where("pos <> 1")
    assert cuts(spark, timeline.available(found, files)) == [("g", 0, 1000), ("r", 1000, 1400), ("g", 1400, 2950), ("s", 2950, 3000), ("r", 3000, 3200), ("f", 3200, 10000)]
    assert timeline.splice_counts(found, files).first()[1:] == (2, 1, False)
    assert timeline.missing(found, files).count() == 1


def test_timeline_at_start_overlap_and_empty(spark):
    assert cuts(spark, hits(spark, ("shit", 0.02, 0.3))) == [("s", 0, 20), ("r", 20, 300), ("f", 300, 10000)]
    found = hits(spark, ("damn", 1.0, 2.5), ("hell", 2.1, 2.3), ("shit", 5.0, 5.4))
    parts = cuts(spark, found)
    assert parts == [("g", 0, 1000), ("r", 1000, 2500), ("r", 2100, 2300), ("g", 2300, 4950), ("s", 4950, 5000), ("r", 5000, 5400), ("f", 5400, 10000)]
    assert sum(b - a for _, a, b in parts) == 10_400
    assert cuts(spark, hits(spark, ("fine", 1.0, 2.0))) == [("f", 0, 10000)]


def test_lead_in_override(spark):
    row = timeline.padded(hits(spark, ("damn", 1.0, 1.4)), 30).first()
    assert (row["pad"], row["lead_actual"]) == (970, 30)


def test_mute_deadlines(spark):
    rows = spark.createDataFrame([(1, i, int(n * 1e6), int(d * 1e6)) for i, (n, d) in enumerate([(1.0, 0.4), (1.1, 0.05), (1.2, 0.5), (3.0, 0.1)])], "key bigint, id bigint, now_us bigint, dur_us bigint")
    found = live.deadlines(rows).orderBy("id").collect()
    assert [r["until_us"] for r in found] == [1_400_000, 1_400_000, 1_700_000, 3_150_000]
    assert [r["island"] for r in found] == [1, 1, 1, 2]
    assert live.blocks_per_chunk(1.0) == 16
    assert live.delay_samples(2.0) == 32000


def test_until_failure(spark):
    rows = spark.createDataFrame([(1, False), (2, False), (3, True), (4, False)], "idx bigint, failed boolean")
    assert sorted(r["idx"] for r in manifest.until_failure(rows).collect()) == [1, 2, 3]
    assert manifest.until_failure(rows, keep_going=True).count() == 4
    assert manifest.until_failure(rows.where("not failed")).count() == 3
    assert tuple(manifest.summary(manifest.marked(rows)).first()) == (3, 1, 2, 3)


def test_limits(spark):
    rows = spark.range(10)
    assert manifest.first_n(rows, 0, "id").count() == 10
    assert manifest.first_n(rows, 3, "id").count() == 3
    with pytest.raises(ValueError, match="negative"):
        manifest.first_n(rows, -1, "id")


def test_transcripts(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "one.json").write_text('[{"word": " Hell,", "start": 1.0, "end": 1.5}, {"word": "é", "start": null, "end": 2}]', encoding="utf-8")
    found = transcripts.read_words(spark, f"{tmp_path}/in").orderBy("pos").collect()
    assert [tuple(r) for r in found] == [("one", 0, " Hell,", 1.0, 1.5), ("one", 1, "é", None, 2.0)]
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.json").write_text('{"word": "a"}')
    with pytest.raises(transcripts.NotAList):
        transcripts.read_words(spark, f"{tmp_path}/bad")
    transcripts.write_words(words(spark, ("a", 0.0, 1.0), ("b", 1.0, 2.0)), f"{tmp_path}/out")
    assert [r["word"] for r in transcripts.read_clip_folders(spark, f"{tmp_path}/out").orderBy("pos").collect()] == ["a", "b"]


def test_media_catalogue(spark, tmp_path):
    for name in ("a/b.WAV", "a-b/x.mp3", "a/c.txt", ".wav"):
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(b"123")
    rows = catalog.in_path_order(catalog.media(spark, str(tmp_path))).collect()
    assert [(r["rel"], r["parent"], r["stem"], r["ext"], r["length"]) for r in rows] == [("a/b.WAV", "a", "b", ".WAV", 3), ("a-b/x.mp3", "a-b", "x", ".mp3", 3)]
    assert [r["rel"] for r in catalog.media(spark, f"{tmp_path}/a/c.txt").collect()] == ["c.txt"]


def test_settings_and_devices(spark, tmp_path):
    (tmp_path / "env").write_text("# no\n\nA = 'b=c'\nnothing\nD=\"e\"\n")
    assert [tuple(r) for r in catalog.settings(spark, f"{tmp_path}/env").collect()] == [("A", "b=c"), ("D", "e")]
    devices = spark.createDataFrame([(0, "Cable Out", 0, 2), (1, "cable in", 2, 0)], "index int, name string, inputs int, outputs int")
    assert catalog.device(devices, "CABLE", True).first()["index"] == 1
    assert catalog.device(devices, "out", True).first()["index"] == 0
    assert catalog.device(devices, "1", False).first()["name"] == "cable in"


def test_batch_flow(spark):
    inputs = spark.createDataFrame([(c, f"{c}.wav", f"in/{c}.wav") for c in ("oh_damn", "fine_day", "seen")], "clip string, relative string, path string")
    segments = adapters.recognise(inputs, adapters.word_stub).cache()
    found = timeline.with_ms(match.matches(match.flatten(segments), lexicon.packaged(spark)))
    done = spark.createDataFrame([("seen.wav",)], "relative string")
    rows = {r["clip"]: r for r in flows.batch_manifest(inputs, done, segments, lexicon.packaged(spark), found).collect()}
    assert {c: r["status"] for c, r in rows.items()} == {"oh_damn": "censored", "fine_day": "clean", "seen": "skipped"}
    assert rows["oh_damn"]["replacements"][0]["replacement"] == "dang"
    assert rows["seen"]["relative"] is None
    speech = adapters.speak(spark.createDataFrame([("dang",), ("",)], "replacement string"), adapters.speech_stub).collect()
    assert [r["error"] for r in speech] == [None, None]


def test_lexicon_growth_keeps_matches(spark):
    rows = words(spark, ("damn", 0.0, 1.0), ("the", 1.0, 2.0))
    less, more = lexicon.packaged(spark), lexicon.packaged(spark).unionByName(lexicon.fixture(spark))
    assert {r["pos"] for r in match.matches(rows, less).collect()} < {r["pos"] for r in match.matches(rows, more).collect()}
    # beyond the size that may be broadcast the result is the same
    assert match.matches(rows, more, small=1).count() == 2


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the test tables")
def test_streams_equal_their_twins(spark, small):
    from lexspan import queries

    streamed = queries.stream_mute(spark, small).select("id", "until_us", "island")
    twin = live.deadlines(queries.mute_events(spark, small).withColumn("key", F.col("key") % 50)).select("id", "until_us", "island")
    assert streamed.exceptAll(twin).isEmpty() and twin.exceptAll(streamed).isEmpty()
    chunks = queries.stream_chunks(spark, small)
    assert chunks.where("n_blocks <> 16 or n_samples <> 16384").isEmpty()
    blocks = queries.mute_events(spark, small).select((F.col("key") % 50).alias("key")).groupBy("key").count().select(F.sum(F.floor(F.col("count") / 16))).first()[0]
    assert chunks.count() == blocks

    gated = queries.stream_gate(spark, small).select("id", "muted")
    rows = queries.mute_events(spark, small).withColumn("key", F.col("key") % 50)
    twin = live.gate(rows.where("id % 3 <> 0"), rows.where("id % 3 = 0")).select("id", "muted")
    assert gated.exceptAll(twin).isEmpty() and twin.exceptAll(gated).isEmpty()
    out = queries.stream_delay(spark, small).select("id", "out_id")
    twin = rows.select("id", F.lag("id", 5).over(W.partitionBy("key").orderBy("now_us", "id")).alias("out_id"))
    assert out.exceptAll(twin).isEmpty() and twin.exceptAll(out).isEmpty()


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the test tables")
def test_sessions_are_islands_that_the_watermark_closed(spark, small):
    from lexspan import queries

    found = {(r["key"], r["until_us"]): r["n_hits"] for r in queries.stream_sessions(spark, small).collect()}
    rows = queries.mute_events(spark, small).select((F.col("key") % 50).alias("key"), "id", "now_us", (F.floor(F.col("dur_us") / 1000) * 1000).alias("dur_us"))
    latest = rows.agg(F.max("now_us")).first()[0]
    twin = {(r["key"], r["until_us"]): r["n_hits"] for r in live.windows(rows).where(F.col("until_us") < latest - 10_000_000).collect()}
    assert found == twin


def test_uneven_blocks_fill_chunks_across_batches(spark, tmp_path):
    import random

    from lexspan import queries
    from lexspan.streaming import live as streams

    r = random.Random(1)
    rows = [(k, i, i, r.choice([100, 1024, 7000, 16000, 40000])) for k in (1, 2) for i in range(120)]
    frame = spark.createDataFrame(rows, "key bigint, id bigint, now_us bigint, samples bigint").withColumn("at_us", F.col("id"))
    found = queries._run(streams.asr_chunks(queries._dropped(frame, str(tmp_path), [30, 31, 77])), str(tmp_path)).collect()
    want = []
    for key in (1, 2):
        n = total = chunk = 0
        for k, i, _, size in rows:
            if k == key:
                n, total = n + 1, total + size
                if total >= 16000:
                    want.append((key, chunk, n, total, i))
                    n, total, chunk = 0, 0, chunk + 1
    assert sorted(tuple(x) for x in found) == want
    assert len(list((tmp_path / "state" / "commits").glob("[0-9]*"))) >= 4


def test_loudness(spark):
    import numpy as np

    from lexspan.operators import loudness

    clips = spark.createDataFrame([("a", "a.wav")], "clip string, path string")
    blocks = adapters.decode(clips, adapters.tone_stub).cache()
    x = np.concatenate([np.asarray(p, dtype=np.float32) for p in adapters.tone_stub()("a")]).astype(float)
    assert sorted((r["block_no"], len(r["samples"])) for r in blocks.collect()) == [(0, 1024), (1, 1024), (2, 952)]
    ranges = spark.createDataFrame([("a", 0, 0.01, 0.15), ("a", 1, 0.1, 0.11), ("a", 2, 5.0, 6.0), ("a", 3, 0.05, 9.0)], "clip string, pos bigint, start double, end double")
    found = {r["pos"]: r["db"] for r in loudness.range_volume(ranges, blocks).collect()}
    assert found[0] == pytest.approx(10 * np.log10((x[160:2400] ** 2).mean()))
    assert found[1] is None and found[2] is None
    assert found[3] == pytest.approx(10 * np.log10((x[800:] ** 2).mean()))
    assert loudness.block_power(blocks).first()["db"] == pytest.approx(10 * np.log10((x**2).mean()))
    gained = loudness.gains(loudness.range_volume(ranges, blocks), ranges.withColumn("db", F.lit(-60.0)))
    assert {r["pos"]: round(r["gain_db"], 3) for r in gained.collect()}[1] == 6.0


def test_first_channel(spark):
    from lexspan.streaming import live as streams

    row = spark.range(1).select(streams.first_channel(F.array(*map(F.lit, (1.0, 2.0, 3.0, 4.0))), F.lit(2)).alias("x")).first()
    assert row["x"] == [1.0, 3.0]


def test_timeline_properties(spark):
    """Without overlaps the segments of a clip tile it; with them each match still has its replacement."""
    import random

    r = random.Random(11)
    rows, clips = [], []
    for c in range(60):
        at, overlaps = 0.0, c % 3 == 0
        for i in range(r.randrange(12)):
            at += r.uniform(-0.4 if overlaps and i else 0.0, 1.0)
            rows.append((str(c), i, r.choice(["damn", "shit", "ass", "fine", "Hell,"]), max(0.0, at), max(0.0, at) + r.uniform(0.05, 0.6)))
            at = rows[-1][4]
        clips.append((str(c), int(max([x[4] for x in rows if x[0] == str(c)], default=0) * 1000) + r.randrange(500)))
    found = timeline.with_ms(match.matches(spark.createDataFrame(rows, WORDS), lexicon.packaged(spark)))
    by: dict = {}
    for s in timeline.segments(found, spark.createDataFrame(clips, "clip string, total_ms bigint")).orderBy("clip", "seq").collect():
        by.setdefault(s["clip"], []).append(s)
    n = {x["clip"]: x["n_hits"] for x in match.hit_counts(found).collect()}
    for clip, total in clips:
        parts = by.get(clip, [])
        assert sum(s["kind"] == "replacement" for s in parts) == n.get(clip, 0)
        assert [s["seq"] for s in parts] == list(range(len(parts)))
        if int(clip) % 3:
            edges = [0, *(s["src_end_ms"] for s in parts)]
            assert [s["src_start_ms"] for s in parts] == edges[:-1]
            assert edges[-1] == total or total == 0
    assert {x["clip"] for x in match.clean_clips(spark.createDataFrame(clips, "clip string, total_ms bigint"), found).collect()} == {c for c, _ in clips} - set(n)


def test_clips_are_written_and_found(spark, tmp_path):
    found = timeline.with_ms(match.matches(words(spark, ("damn", 1.0, 1.4), ("Damn", 2.0, 2.4), ("hell", 3.0, 3.4)), lexicon.packaged(spark)))
    speech = adapters.speak(match.speech_requests(found), lambda: lambda text: b"" if text == "heck" else b"x" * 300)
    files = adapters.save_clips(found, speech, str(tmp_path)).cache()
    assert {(r["filename"], r["length"]) for r in files.collect()} == {("00001000_00001400_dang.wav", 300), ("00002000_00002400_dang.wav", 300)}
    assert sorted(x.name for x in tmp_path.rglob("*.wav")) == sorted(r["filename"] for r in files.collect())
    clips = found.select("clip").distinct().withColumn("total_ms", F.lit(5000).cast("bigint"))
    plan = flows.edit_plan(words(spark, ("damn", 1.0, 1.4), ("hell", 3.0, 3.4)), lexicon.packaged(spark), clips, files, blocks=spark.createDataFrame([], "clip string, block_no bigint, samples array<float>"))
    assert [r["gain_db"] for r in plan["gains"].collect()] == [6.0]
    assert {r["kind"] for r in plan["timeline"].collect()} == {"gap", "replacement", "final"}
    assert plan["gap_fades"].where("fade_at is not null").count() == 1
