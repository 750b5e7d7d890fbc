"""What rows are made into must not go through the driver, one task or one file, however large the tables get."""

import re

import pytest
from pyspark.sql import functions as F

from lexspan import queries
from lexspan.operators import live, render


def plan(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def test_beep_block_joins_no_samples(spark, small):
    """Samples were joined in by id: Spark broadcast 1024 numbers a row, as it expects one."""
    made = queries.beep_block(spark, small)
    assert "Join" not in plan(made)
    rows = queries.mute_events(spark, small, "value")
    gated = live.gate(rows.where("id % 3 <> 0"), rows.where("id % 3 = 0"), carried=("value",))
    assert gated.columns == ["key", "id", "now_us", "value", "muted"]
    loud = {r["id"]: r["value"] * 524800 for r in gated.where("not muted").collect()}
    found = {r["id"]: r["weighed"] for r in made.collect()}
    assert loud and all(found[i] == pytest.approx(x, abs=1e-3) for i, x in loud.items())


def test_overlapping_blocks_by_stretches(spark):
    """Ranges were made into their single block numbers and broadcast; each block still counts once, at the edges of stretches too."""
    rows = [(k, i, a, a + n) for k in (1, 2) for i, (a, n) in enumerate([(0, 1), (-5, 5), (-130, 1300), (639, 1), (639, 2), (5, 0), (100, 6400), (1279, 2), (-6400, 12800)])]
    ranges = spark.createDataFrame(rows, "key bigint, id bigint, from_us bigint, until_us bigint")
    blocks = spark.range(-200, 700, 3).select(F.explode(F.array(F.lit(1).cast("bigint"), F.lit(3).cast("bigint"))).alias("key"), F.col("id").alias("block_no"))
    made = live.overlapping_blocks(ranges, blocks, 10)
    assert set(made.columns) == {"key", "id", "from_us", "until_us", "block_no"}
    want = sorted((k, i, b) for k, i, a, z in rows for b in range(-200, 700, 3) if k == 1 and z > a and b * 10 < z and (b + 1) * 10 > a)
    assert sorted((r["key"], r["id"], r["block_no"]) for r in made.collect()) == want
    assert "BroadcastHashJoin" not in plan(made)
    long = ranges.select("key", "id", F.lit(0).alias("from_us"), F.lit(640_000).alias("until_us"))
    named = live.overlapping_blocks(long, blocks, 10)
    assert "_stretch" not in named.columns and named.count() == 9 * 233


def test_range_volume_joins_no_samples(spark):
    """Blocks were joined to the ranges' ends and broadcast, as Spark expects few of them; scans in segments give the same."""
    from lexspan.operators import loudness

    n = spark.range(3).select(F.col("id").cast("string").alias("clip"), F.explode(F.sequence(F.lit(0), F.col("id") * 20)).alias("block_no"))
    blocks = n.withColumn("samples", F.transform(F.sequence(F.lit(0), F.when(F.col("block_no") == F.col("clip").cast("int") * 20, 4).otherwise(15)), lambda i: (F.col("block_no") * 16 + i) % 7 / 8))
    rows = [(c, p, s / 100, e / 100) for c in "0123" for p, (s, e) in enumerate([(0, 16), (0, 5), (3, 200), (16, 32), (100, 105), (319, 330), (320, 325), (324, 360), (400, 500), (7, 8)])]
    made = loudness.range_volume(spark.createDataFrame(rows, "clip string, pos bigint, start double, end double"), blocks, 100, 16)
    assert "BroadcastHashJoin" not in plan(made)

    def power(c, s, e):
        x = [i % 7 / 8 for i in range(int(s * 100), min(int(e * 100), int(c) * 320 + 5 if c < "3" else 0))]
        return sum(v * v for v in x) / len(x) if x and e - s > 0.02 else 0

    for most in (1 << 20, 4):
        found = loudness.range_volume(spark.createDataFrame(rows, "clip string, pos bigint, start double, end double"), blocks, 100, 16, most).collect()
        assert len(found) == len(rows)
        for r in found:
            want = power(r["clip"], r["start"], r["end"])
            assert r["db"] is None if want == 0 else 10 ** (r["db"] / 10) == pytest.approx(want), r


def test_dropped_has_files_as_rows(spark, tmp_path):
    """Each stretch was written as two files, so one task got half of it; each is one micro-batch, whatever keys it has."""
    rows = spark.range(3000).select((F.col("id") % 5).alias("key"), "id", (F.col("id") * F.when(F.col("id") < 2500, 1).otherwise(100)).alias("at_us"))
    stream = queries._dropped(rows, str(tmp_path), [500, 520, 10**5], file_rows=250)
    seen = []
    query = stream.writeStream.foreachBatch(lambda x, n: seen.append(sorted(r["id"] for r in x.collect()))).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    assert seen == [list(range(500)), list(range(500, 520)), list(range(520, 2500)), list(range(2500, 3000))]
    assert len(list((tmp_path / "in").glob("*.parquet"))) == 4 * 8


def test_plain_files_lists_folders(spark, small):
    """Each clip's file was a path of its own, which the driver listed one by one; now the two folders are."""
    found = re.findall(r"InMemoryFileIndex\((\d+) paths\)", plan(queries.plain_files(spark, small)))
    assert found and set(found) == {"1"}


def test_rendered_blocks_makes_words_once(spark, small):
    """Words were taken apart and put in order for each of six uses, and samples were joined block by block."""
    made = plan(queries.rendered_blocks(spark, small))
    assert "posexplode" not in made and "row_number" not in made
    assert "stretch" in made
    totals = {r["clip"]: r["total_ms"] for r in queries.totals(queries.words_of(spark, small)).collect()}
    assert totals and totals == {r["clip"]: r["total_ms"] for r in queries._turn_totals(spark, small).collect()}


def test_render_by_stretches(spark):
    """Pieces are cut at stretches of 64 blocks of the source and of the output; blocks that lack, are short or too long, and what follows."""
    rate, block = 1000, 16

    def sample(c, b):
        size = {3: 0, 70: 5, 90: 40}.get(b, block)
        return [((b * block + i) * 7 % 13 + int(c)) / 16 for i in range(size)]

    had = {c: [b for b in range(200) if b % 41 != 7] if c == "1" else list(range(150)) for c in "12"}
    blocks = spark.createDataFrame([(c, b, sample(c, b)) for c in had for b in had[c]], "clip string, block_no bigint, samples array<double>")
    said = {("1", 1): [0.0] * 30 + [0.5, 0.25] * 600, ("1", 2): [0.0] * 40, ("2", 1): [0.75] * 25}
    speech = spark.createDataFrame([(c, m, b, x[b * block : (b + 1) * block]) for (c, m), x in said.items() for b in range(-(-len(x) // block))], "clip string, match_pos bigint, block_no bigint, samples array<double>")
    gains = spark.createDataFrame([("1", 1, 6.0), ("2", 1, -3.5)], "clip string, match_pos bigint, gain_db double")
    rows = [("1", 0, "gap", 5, 1500, 1), ("1", 1, "silence", 1500, 1510, 1), ("1", 2, "replacement", 1510, 3010, 1), ("1", 3, "gap", 1000, 1039, 2), ("1", 4, "replacement", 1039, 1339, 2), ("1", 5, "replacement", 1339, 1400, 3), ("1", 6, "final", 1400, 3300, None), ("2", 0, "replacement", 0, 77, 1), ("2", 1, "final", 77, 2500, None)]
    shape = spark.createDataFrame(rows, "clip string, seq bigint, kind string, src_start_ms bigint, src_end_ms bigint, match_pos bigint")
    want = {}
    for c, _, kind, start, end, m in rows:
        d = (end - start) / 1000
        x = said.get((c, m), [])
        loud = [i for i, v in enumerate(x) if abs(v) > render.QUIET]
        heard = x[max(0, loud[0] - 10) : loud[-1] + 11] if loud else []
        fade = min(0.02, d / 4)
        for j in range(end - start):
            t, v = j / rate, 0.0
            if kind in ("gap", "final"):
                b, i = divmod(start + j, block)
                v = (sample(c, b)[:block] + [0.0] * block)[i] if b in had[c] else 0.0
                if kind == "gap" and end - start > 40 and t > (end - start - 20) / 1000:
                    v *= max(0.0, 1 - (t - (end - start - 20) / 1000) / 0.02)
            elif kind == "replacement" and j < len(heard):
                v = heard[j] * 10 ** ({("1", 1): 6.0, ("2", 1): -3.5}.get((c, m), 0.0) / 20) * min(1.0, t / fade) * (max(0.0, 1 - (t - (d - fade)) / fade) if t > d - fade else 1)
            want.setdefault(c, []).append(v)
    for most in (1 << 20, 3):
        found = {}
        for r in sorted(render.render(shape, blocks, speech, gains, rate, block, most=most).collect(), key=lambda r: (r["clip"], r["out_block"])):
            assert len(found.setdefault(r["clip"], [])) == r["out_block"] * block
            found[r["clip"]] += r["samples"]
        assert found == {c: pytest.approx(x, abs=1e-12) for c, x in want.items()}


def test_stream_hits_has_files_as_words(spark, small, tmp_path, monkeypatch):
    """Each stretch of the words was two files, whatever their number, so one task read half of it."""
    dropped = queries._dropped
    monkeypatch.setattr(queries, "new_path", lambda spark, label: str(tmp_path))
    monkeypatch.setattr(queries, "_dropped", lambda *a: dropped(*a, file_rows=500))
    found = queries.stream_hits(spark, small)
    words = queries.words_of(spark, small)
    most = max(words.where(x).count() for x in ("pos < 50", "pos >= 50 and pos < 200", "pos >= 200"))
    assert len(list((tmp_path / "in").glob("*.parquet"))) == 3 * -(-most // 500) > 6
    assert sorted((r["clip"], r["pos"]) for r in found.collect()) == sorted((r["clip"], r["pos"]) for r in queries.hits_of(spark, small).collect())
