"""The log of blocks: offsets, replays, restarts after a failure."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexspan.streaming import blocklog
from lexspan.streaming import live as streams

SHAPE = pa.schema([("key", pa.int64()), ("id", pa.int64()), ("now_us", pa.int64()), ("channels", pa.int32()), ("samples", pa.list_(pa.float32()))])


def batch(*ids):
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(([i % 3 for i in ids], ids, [10 * i for i in ids], [1] * len(ids), [[i / 2, 1.0] for i in ids]), SHAPE.types, strict=True)], schema=SHAPE)


def test_a_restarted_query_neither_loses_nor_repeats(spark, tmp_path):
    source, out, state = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state"
    blocklog.append(source, batch(0, 1, 2))
    blocklog.append(source, batch(3, 4))
    delayed = lambda: streams.delayed_blocks(blocklog.stream(spark, source), 1)
    shape = "key bigint, id bigint, out_id bigint"
    blocklog.play(delayed(), out, state, once=True).awaitTermination()
    assert {tuple(r) for r in blocklog.read(spark, out, shape).collect()} == {(0, 0, None), (1, 1, None), (2, 2, None), (0, 3, 0), (1, 4, 1)}
    # a batch that fails is not seen, and done again when the query starts anew
    blocklog.append(source, batch(*range(5, 9)))
    broken = delayed().where(F.when(F.col("id") == 7, F.raise_error(F.lit("no sound"))).otherwise(F.lit(True)).cast("boolean"))
    with pytest.raises(Exception, match="no sound"):
        blocklog.play(broken, out, state, once=True).awaitTermination()
    assert blocklog.read(spark, out, shape).count() == 5
    blocklog.append(source, batch(9))
    # the first run does again what had failed, the second what has come since
    for _ in range(2):
        blocklog.play(delayed(), out, state, once=True).awaitTermination()
    rows = [tuple(r) for r in blocklog.read(spark, out, shape).collect()]
    assert sorted(rows, key=str) == sorted(((i % 3, i, i - 3 if i > 2 else None) for i in range(10)), key=str)
    blocklog.play(delayed(), out, state, once=True).awaitTermination()
    assert blocklog.read(spark, out, shape).count() == 10


def test_a_log_is_read_up_to_a_hole(spark, tmp_path):
    path = f"{tmp_path}/log"
    assert blocklog.read(spark, path).count() == 0
    assert blocklog.append(path, batch(1)) == 0
    blocklog.append(path, batch(3), n=2)
    assert [r["id"] for r in blocklog.read(spark, path).collect()] == [1]
    assert blocklog.append(path, batch(2)) == 1
    assert sorted(r["id"] for r in blocklog.read(spark, path).collect()) == [1, 2, 3]
    blocklog.append(path, batch(7), n=2)
    assert sorted(r["id"] for r in blocklog.read(spark, path).collect()) == [1, 2, 7]
    assert [list(r["samples"]) for r in blocklog.read(spark, path).where("id = 7").collect()] == [[3.5, 1.0]]
