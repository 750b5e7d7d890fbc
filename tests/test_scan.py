"""Ordered scans in segments against plain windows over whole keys."""

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexspan.operators import live, timeline
from lexspan.operators.scan import scan

LEAST = 150_000


@pytest.fixture(scope="module")
def hot(spark):
    """Half of the rows have one key; times have ties, nulls in values and an empty key."""
    rows = spark.range(6000).select(F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id") % 40).alias("key"), "id", ((F.col("id") * 7919) % 5003 * 40_000).alias("now_us"), ((F.col("id") * 31) % 17 * 90_000).alias("dur_us"))
    return rows.unionByName(spark.createDataFrame([(None, 1, 5, 10), (None, 2, 3, 10)], rows.schema)).cache()


def same(a, b):
    assert a.columns == b.columns
    assert a.count() == b.count() > 0
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def in_time():
    return W.partitionBy("key").orderBy("now_us", "id")


def test_segments_are_even_and_in_order(hot):
    rows = scan(hot, "key", ("now_us", "id"), most=500, parts=16).rows.where("key = 7").groupBy("_segment").agg(F.count("*").alias("n"), F.min("now_us").alias("a"), F.max("now_us").alias("b")).orderBy("_segment").collect()
    assert len(rows) == 16
    assert max(r["n"] for r in rows) < 2 * min(r["n"] for r in rows)
    assert all(x["b"] < y["a"] for x, y in zip(rows, rows[1:], strict=False))


@pytest.mark.parametrize("most", [100, 500, 10**6])
def test_scans(hot, most):
    so_far = in_time().rowsBetween(W.unboundedPreceding, W.currentRow)
    some = hot.where("key is not null").withColumn("v", F.when(F.col("id") % 5 > 0, F.col("dur_us")))
    rows = scan(some, "key", ("now_us", "id"), most, 16)
    assert (len(rows.by) == 2) == (most < 3000)
    plain = {"a": F.max("v").over(so_far), "b": F.coalesce(F.sum("v").over(so_far), F.lit(0)), "c": F.row_number().over(in_time()).cast("bigint") - 1, "d": F.lag("v").over(in_time()), "e": F.lag("v", 30, -1).over(in_time())}
    found = rows.running_max(F.col("v"), "a").running_sum(F.coalesce("v", F.lit(0)), "b").numbered("c").lagged(F.col("v"), "d").shifted(F.col("v"), 30, "e", F.lit(-1)).rows
    same(found.select("key", "id", *plain), some.withColumns(plain).select("key", "id", *plain))


@pytest.mark.parametrize("most", [100, 10**6])
def test_live_operators(hot, most):
    rows = hot.where("key is not null")
    so_far = in_time().rowsBetween(W.unboundedPreceding, W.currentRow)
    whole = rows.withColumn("until_us", F.max(F.col("now_us") + F.greatest(F.lit(LEAST), "dur_us")).over(so_far))
    new = whole.withColumn("new", F.when(F.col("now_us") >= F.lag("until_us").over(in_time()), 1).otherwise(0))
    same(live.deadlines(rows, most), new.withColumn("island", (F.sum("new").over(so_far) + 1).cast("bigint")).select(*rows.columns, "until_us", "island"))
    samples = rows.select("key", F.col("id").alias("n"), (F.col("dur_us") / 7).alias("value"))
    same(live.delayed(samples, 5, most), samples.withColumn("out", F.lag("value", 5, 0.0).over(W.partitionBy("key").orderBy("n"))))
    blocks, hits = rows.where("id % 3 > 0"), rows.where("id % 3 = 0")
    pairs = blocks.join(hits.select(F.col("key").alias("k"), F.col("now_us").alias("t"), F.col("dur_us").alias("d")), (F.col("key") == F.col("k")) & (F.col("t") <= F.col("now_us") + 70_000), "left")
    plain = pairs.groupBy("key", "id", "now_us").agg(F.coalesce(F.max(F.col("t") + F.greatest(F.lit(LEAST), "d")) > F.col("now_us") + 70_000, F.lit(False)).alias("muted"))
    same(live.gate(blocks, hits, 70_000, most), plain)


def test_timeline_of_a_long_clip(hot):
    hits = hot.where("key is not null").select(F.col("key").cast("string").alias("clip"), F.col("id").alias("pos"), F.lit("And").alias("word"), (F.col("now_us") / 1_000_000).alias("start"), F.floor(F.col("now_us") / 1000).alias("start_ms"), F.floor((F.col("now_us") + F.col("dur_us")) / 1000).alias("end_ms"))
    same(timeline.padded(hits, most=200), timeline.padded(hits))


def test_one_shuffle_of_the_rows(spark):
    """All steps of deadlines() share the shuffle by key and segment: what else moves are counts, sketches and what segments hand on."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = spark.range(1000).select((F.col("id") % 9).alias("key"), "id", F.col("id").alias("now_us"), F.lit(5).cast("bigint").alias("dur_us"), F.rand(1).alias("payload"))
        plan = live.deadlines(rows, most=10)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    # the rows move by key, to meet the edges of the few keys that have any, and then once for all three steps
    moved = [x for x in plan.split("\n") if "Exchange" in x and "REPARTITION" not in x]
    assert "SinglePartition" not in plan
    assert sum("_segment" in x and "ENSURE" in x for x in moved) <= 7, moved


def test_empty(spark):
    none = spark.createDataFrame([], "key bigint, id bigint, now_us bigint, dur_us bigint")
    assert live.deadlines(none).count() == 0
    assert live.gate(none, none).count() == 0
