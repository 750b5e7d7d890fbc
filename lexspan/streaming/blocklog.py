"""A log of blocks as a data source: what a recorder appends, streams read and play, and other streams write.

    spark.dataSource.register(BlockLog)
    spark.readStream.format("blocklog").schema(shape).load(folder)
    rows.writeStream.format("blocklog").option("checkpointLocation", state).start(folder)

A log is a folder of Arrow files and one small index a batch, `batch-<number>.json`, which names the batch's files and appears at once when the batch is whole. A
reader's offset is the number of the next batch, so it replays from any place. A writer gives a batch the number that the query gave it: a batch that is
tried again after a failure replaces its index, and files that no index names are read by nobody. So a query that is restarted neither loses nor
repeats a block. Numbers have no holes: a log is read up to the first number that is missing."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamArrowWriter, DataSourceStreamReader, InputPartition, WriterCommitMessage

from lexspan.sources.files import got, opened, put

BLOCKS = "key bigint, id bigint, now_us bigint, channels int, samples array<float>"


@dataclass
class _File(InputPartition):
    name: str


@dataclass
class _Part(WriterCommitMessage):
    name: str | None
    rows: int


def _index(n: int) -> str:
    return f"batch-{n:012d}.json"


class _Log:
    def __init__(self, path: str):
        self.files, self.root = opened(path.rstrip("/"))

    def parts(self, n: int) -> list[str] | None:
        """The files of a batch, none if it is not there."""
        from pyarrow import fs

        path = f"{self.root}/{_index(n)}"
        return json.loads(got(self.files, path)) if self.files.get_file_info(path).type == fs.FileType.File else None

    def end(self, n: int = 0) -> int:
        """The first number from n on that is missing."""
        while self.parts(n) is not None:
            n += 1
        return n

    def write(self, batches: Iterator[pa.RecordBatch]) -> _Part:
        name, rows, out, sink = f"part-{uuid.uuid4().hex}.arrow", 0, None, None
        self.files.create_dir(self.root)
        for batch in batches:
            if out is None:
                sink = self.files.open_output_stream(f"{self.root}/{name}")
                out = pa.ipc.new_stream(sink, batch.schema)
            out.write_batch(batch)
            rows += batch.num_rows
        if out is None:
            return _Part(None, 0)
        out.close()
        sink.close()
        return _Part(name, rows)

    def commit(self, n: int, names: list[str]) -> None:
        self.files.create_dir(self.root)
        put(self.files, f"{self.root}/{_index(n)}", json.dumps(names).encode())

    def read(self, name: str, schema) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        shape = to_arrow_schema(schema)
        with self.files.open_input_stream(f"{self.root}/{name}") as found, pa.ipc.open_stream(found) as stream:
            for batch in stream:
                yield pa.RecordBatch.from_arrays([batch.column(f.name).cast(f.type) for f in shape], schema=shape)


class BlockLog(DataSource):
    """The schema is the reader's to name; without one, BLOCKS."""

    @classmethod
    def name(cls) -> str:
        return "blocklog"

    def schema(self) -> str:
        return BLOCKS

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], schema)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(self.options["path"], schema)

    def streamWriter(self, schema, overwrite: bool) -> DataSourceStreamArrowWriter:
        return _StreamWriter(self.options["path"])


class _Reader(DataSourceReader):
    def __init__(self, path: str, schema):
        self.path, self.schema = path, schema

    def partitions(self) -> list[_File]:
        log = _Log(self.path)
        return [_File(x) for n in range(log.end()) for x in log.parts(n)] or [_File("")]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        if partition.name:
            yield from _Log(self.path).read(partition.name, self.schema)


class _StreamReader(DataSourceStreamReader):
    def __init__(self, path: str, schema):
        self.path, self.schema, self.known = path, schema, 0

    def initialOffset(self) -> dict:
        return {"next": 0}

    def latestOffset(self) -> dict:
        self.known = _Log(self.path).end(self.known)
        return {"next": self.known}

    def partitions(self, start: dict, end: dict) -> list[_File]:
        log = _Log(self.path)
        self.known = max(self.known, end["next"])
        return [_File(x) for n in range(start["next"], end["next"]) for x in log.parts(n)] or [_File("")]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        if partition.name:
            yield from _Log(self.path).read(partition.name, self.schema)

    def commit(self, end: dict) -> None:
        """The log keeps what was read, for other readers and for replays."""


class _StreamWriter(DataSourceStreamArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Part:
        return _Log(self.path).write(iterator)

    def commit(self, messages: list, batchId: int) -> None:
        _Log(self.path).commit(batchId, [m.name for m in messages if m and m.name])

    def abort(self, messages: list, batchId: int) -> None:
        """What was written has no index, so it is not read."""


def append(path: str, batch: pa.RecordBatch, n: int | None = None) -> int:
    """What a recorder does: one more batch, or batch n anew; gives its number. One recorder appends to a log."""
    log = _Log(path)
    n = log.end() if n is None else n
    log.commit(n, [log.write(iter([batch])).name])
    return n


def read(spark: SparkSession, path: str, schema: str = BLOCKS) -> DataFrame:
    spark.dataSource.register(BlockLog)
    return spark.read.format("blocklog").schema(schema).load(path)


def stream(spark: SparkSession, path: str, schema: str = BLOCKS) -> DataFrame:
    spark.dataSource.register(BlockLog)
    return spark.readStream.format("blocklog").schema(schema).load(path)


def play(rows: DataFrame, path: str, checkpoint: str, once: bool = False):
    """Starts a query that writes the stream to a log, from which a device or another stream plays. `once`: what is there, then it ends."""
    rows.sparkSession.dataSource.register(BlockLog)
    out = rows.writeStream.format("blocklog").option("checkpointLocation", checkpoint).option("path", path)
    return (out.trigger(availableNow=True) if once else out).start()
