"""What the operators share: the shared work folder, written tables, batches of texts."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lexspan.work import shared_dir


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A setting of the session for a while, unless it has been set to something else."""
    before = spark.conf.get(key, None)
    if before not in (None, "false"):
        yield
        return
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


_made: ContextVar[list | None] = ContextVar("made", default=None)


class Tables:
    """Written tables of one run. They cut lineage and survive lost executors; drop() removes those no longer needed."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        if (made := _made.get()) is not None:
            made.append(self)

    def put(self, name: str, df: DataFrame) -> DataFrame:
        """Writes and rereads a frame, which is run this once: its shuffle files go as soon as the table is there."""
        path = f"{self.root}/{name}"
        with setting(self.spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
            df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """The tables named; without names, all."""
        jvm = self.spark.sparkContext._jvm
        for name in [f"/{x}" for x in names] or [""]:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}{name}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def swept() -> Iterator[None]:
    """Drops the tables that operators make inside, at the end: what they return must have been written by then."""
    token = _made.set([])
    try:
        yield
    finally:
        made = _made.get()
        _made.reset(token)
        for one in made:
            one.drop()


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded(query: Callable) -> Callable:
    """A query that first bounds its session's Arrow batches to 8 MB, unless they are bounded already: a batch is held by the JVM and by the
    worker, for each core. Operators leave the session as it is; who calls them sets this."""

    @wraps(query)
    def run(spark: SparkSession, *args):
        if spark.conf.get(BATCH_BYTES, None) is None:
            spark.conf.set(BATCH_BYTES, "8m")
        return query(spark, *args)

    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the two columns an operator needs, a null text as the empty one."""
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))


def quoted(name: str) -> str:
    """A column's name as an expression, whatever stands in it."""
    return "`" + name.replace("`", "``") + "`"


def spare(names: list[str], wanted: str) -> str:
    """`wanted`, or a name made of it that none of the names is."""
    taken = {n.lower() for n in names}
    return next(x for x in (wanted, *(f"{wanted}_{i}" for i in range(len(taken) + 1))) if x.lower() not in taken)


def namesakes(docs: DataFrame, work: Tables) -> DataFrame | None:
    """None where each document has an id that no other text has; else a written table (twin_id, twin_hash, key): documents without an id, and those that share one with another text, each by its text's hash,
    with a number that no id is. Numbers follow the ids and go on by (id, hash), documents without an id last. Elsewhere the id alone names a text."""
    ids = docs.select(F.col("doc_id").cast("long").alias("twin_id"), text_hash().alias("twin_hash"))
    shared = work.put("twin-ids", ids.where("twin_id is not null").groupBy("twin_id").agg(F.min("twin_hash").alias("a"), F.max("twin_hash").alias("b")).where("a < b").select("twin_id"))
    rows = ids.join(shared, "twin_id", "left_semi").unionByName(ids.where("twin_id is null")).distinct()
    twins = work.put("twins", rows.orderBy(F.asc_nulls_last("twin_id"), "twin_hash").select("twin_id", "twin_hash", F.monotonically_increasing_id().alias("n")))
    most = twins.agg(F.max("n")).first()[0]
    if most is None:
        return None
    top = ids.agg(F.max("twin_id")).first()[0] or 0
    if top + most + 1 >= 1 << 63:
        raise ValueError("documents that share an id, or have none, need numbers above the greatest id, and there are too few")
    return twins.select("twin_id", "twin_hash", (F.col("n") + top + 1).alias("key"))


def text_hash(text: str = "text") -> Column:
    return F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))


def keyed(docs: DataFrame, twins: DataFrame | None, name: str = "key") -> DataFrame:
    """The documents with a last column `name` that names id and text: the id, or the number of a namesake."""
    if twins is None:
        return docs.select(*map(quoted, docs.columns), F.col("doc_id").cast("long").alias(name))
    names = [spare(docs.columns, n) for n in ("twin_id", "twin_hash", "twin_key")]
    of = twins.toDF(*names)
    # a merge join where the namesakes are many, and no movement of texts where they are few
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(names[0])) & (text_hash() == F.col(names[1]))
    return docs.join(of, same, "left").select(*map(quoted, docs.columns), F.coalesce(F.col(names[2]), F.col("doc_id").cast("long")).alias(name))


def over_columns(df: DataFrame, task, less: int = 0) -> DataFrame:
    """mapInArrow for tasks that keep all columns, or all but the last `less`: they see c0, c1 and so on, so that a column may have any name."""
    plain = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    n = len(df.columns) - less
    return plain.mapInArrow(task, StructType(plain.schema.fields[:n])).toDF(*df.columns[:n])


def arrow(df: DataFrame, task, schema) -> DataFrame:
    """mapInArrow; batches are bounded in bytes by the session (see bounded)."""
    return df.mapInArrow(task, schema)


def rows_of(batches: Iterator[pa.RecordBatch], size: int = 1 << 21) -> Iterator[tuple[list, list]]:
    """(first column, second column) as lists, texts of about `size` bytes or one row at a time."""
    for batch in batches:
        n, at = batch.num_rows, 0
        if not n:
            continue
        step = max(1, int(n * size / max(1, batch.column(1).nbytes)))
        while at < n:
            part = batch.slice(at, step)
            yield part.column(0).to_pylist(), part.column(1).to_pylist()
            at += step


def as_batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int = 1) -> Iterator[list[np.ndarray]]:
    """Columns of sorted, partitioned rows as arrays, cut only where one of the first `keys` columns changes. What is held is a
    batch and the group that it breaks off in, which is joined once, when it is whole."""
    held: list[list[np.ndarray]] = []

    def whole(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
        return parts[0] if len(parts) == 1 else [np.concatenate(x) for x in zip(*parts, strict=True)]

    for batch in batches:
        if not batch.num_rows:
            continue
        now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if held and any(a[-1] != b[0] for a, b in zip(held[-1][:keys], now[:keys], strict=True)):
            yield whole(held)
            held = []
        differs = np.zeros(len(now[0]) - 1, dtype=bool)
        for column in now[:keys]:
            differs |= column[1:] != column[:-1]
        edges = np.flatnonzero(differs)
        if len(edges):
            cut = int(edges[-1]) + 1
            yield whole([*held, [x[:cut] for x in now]])
            held, now = [], [x[cut:].copy() for x in now]
        held.append(now)
    if held:
        yield whole(held)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
