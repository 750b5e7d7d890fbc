"""A data source of transcript files: one JSON list a clip, `<clip>.json`, many clips a task.

    spark.dataSource.register(TranscriptFiles)
    rows.write.format("transcripts").option("kind", "matches").mode("overwrite").save(folder)
    spark.read.format("transcripts").option("kind", "matches").load(folder)

Rows to write are (clip, value), value being the clip's list as JSON text, as transcripts.as_json gives them. A file gets its name when it is whole.
Each task also lists its files in a part of `_index`, whose name is its commit message, and the commit names the parts: what tasks that failed
or were run twice left behind is in no part that counts. The reader makes one partition a part, so the driver lists no clips; a folder without an index
(written by others) is listed and read `files` at a time. Clips' names must be file names."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

_FIELDS = {"words": ("word", "start", "end"), "matches": ("word", "start", "end", "replacement")}
_INDEX = "_index"


class NotAList(ValueError):
    """A file whose top level is not a list."""


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def put(files: fs.FileSystem, path: str, data: bytes) -> None:
    """A file that is whole once it has its name; putting it again replaces it."""
    folder, _, name = path.rpartition("/")
    part = f"{folder}/.{uuid.uuid4().hex}"
    with files.open_output_stream(part) as out:
        out.write(data)
    files.move(part, f"{folder}/{name}")


def got(files: fs.FileSystem, path: str) -> bytes:
    with files.open_input_stream(path) as found:
        return found.read()


@dataclass
class _Files(InputPartition):
    names: list[str] | None
    index: str | None = None


@dataclass
class _Part(WriterCommitMessage):
    index: str | None
    n: int


class TranscriptFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "transcripts"

    def schema(self) -> str:
        kind = self.options.get("kind", "words")
        return "clip string, pos bigint, word string, start double, end double" + (", replacement string" if kind == "matches" else "")

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options, overwrite)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.fields = options["path"].rstrip("/"), _FIELDS[options.get("kind", "words")]
        self.at_once, self.strict = int(options.get("files", "256")), options.get("strict", "true") == "true"

    def partitions(self) -> list[_Files]:
        files, root = opened(self.path)
        done = f"{root}/{_INDEX}/COMMITTED"
        if files.get_file_info(done).type == fs.FileType.File:
            return [_Files(None, x) for x in json.loads(got(files, done))] or [_Files([])]
        names = sorted(x.base_name for x in files.get_file_info(fs.FileSelector(root)) if x.type == fs.FileType.File and x.base_name.endswith(".json"))
        return [_Files(names[i : i + self.at_once]) for i in range(0, len(names), self.at_once)] or [_Files([])]

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        files, root = opened(self.path)
        names = partition.names if partition.index is None else json.loads(got(files, f"{root}/{_INDEX}/{partition.index}"))
        types = {"word": pa.string(), "start": pa.float64(), "end": pa.float64(), "replacement": pa.string()}
        schema = pa.schema([("clip", pa.string()), ("pos", pa.int64()), *((f, types[f]) for f in self.fields)])
        rows: list[list] = [[] for _ in schema]
        for name in names:
            items = json.loads(got(files, f"{root}/{name}"))
            if not isinstance(items, list):
                if self.strict:
                    raise NotAList(f"{name}: the top level is not a list")
                continue
            for pos, x in enumerate(items):
                # what is no row, or has no text for a word, is left out
                if isinstance(x, dict) and isinstance(x.get("word"), str | None):
                    for column, value in zip(rows, (name.removesuffix(".json"), pos, *(x.get(f) for f in self.fields)), strict=True):
                        column.append(value)
            if len(rows[0]) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, schema, strict=True)], schema=schema)
                rows = [[] for _ in schema]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, schema, strict=True)], schema=schema)


class _Writer(DataSourceArrowWriter):
    def __init__(self, options, overwrite: bool):
        self.path = options["path"].rstrip("/")
        files, root = opened(self.path)
        if overwrite and files.get_file_info(root).type == fs.FileType.Directory:
            files.delete_dir_contents(root)
        files.create_dir(f"{root}/{_INDEX}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Part:
        files, root = opened(self.path)
        names = []
        for batch in iterator:
            for clip, value in zip(batch["clip"].to_pylist(), batch["value"].to_pylist(), strict=True):
                if not clip or "/" in clip or clip[0] in "._":
                    raise ValueError(f"{clip!r} is no file's name")
                put(files, f"{root}/{clip}.json", value.encode())
                names.append(f"{clip}.json")
        if not names:
            return _Part(None, 0)
        index = f"part-{uuid.uuid4().hex}"
        put(files, f"{root}/{_INDEX}/{index}", json.dumps(names).encode())
        return _Part(index, len(names))

    def commit(self, messages: list[_Part]) -> None:
        files, root = opened(self.path)
        done = f"{root}/{_INDEX}/COMMITTED"
        before = json.loads(got(files, done)) if files.get_file_info(done).type == fs.FileType.File else []
        put(files, done, json.dumps([*before, *(m.index for m in messages if m and m.index)]).encode())

    def abort(self, messages: list) -> None:
        """What was written stays without an index, so it is not read."""


def write_files(lists: DataFrame, path: str, kind: str = "words") -> None:
    """(clip, value) as one file a clip."""
    lists.sparkSession.dataSource.register(TranscriptFiles)
    lists.select("clip", "value").write.format("transcripts").option("kind", kind).mode("overwrite").save(path)


def read_files(spark: SparkSession, path: str, kind: str = "words", strict: bool = True) -> DataFrame:
    spark.dataSource.register(TranscriptFiles)
    return spark.read.format("transcripts").options(kind=kind, strict=str(strict).lower()).load(path)
