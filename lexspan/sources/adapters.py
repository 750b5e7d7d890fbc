"""Where work outside the engine plugs in: recognition, speech, media. Each is a function that gets an iterator of Arrow batches
and is set up once for each partition; the engine ships deterministic stand-ins for tests and no models."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from lexspan.schema import SEGMENTS
from lexspan.sources.files import opened, put

Batches = Iterator[pa.RecordBatch]


def recognise(clips: DataFrame, make: Callable[[], Callable[[str], list[dict]]]) -> DataFrame:
    """(clip, segments, error) of clips(clip, path): `make` loads a model once for each partition and gives a function from a path to
    segments. A clip that fails gives its error and no segments; the others go on."""

    def task(batches: Batches) -> Batches:
        run = make()
        for batch in batches:
            clips_, found, errors = batch.column(0), [], []
            for path in batch.column(1).to_pylist():
                try:
                    found.append(run(path))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001
                    found.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([clips_, pa.array(found, type=_SEGMENTS), pa.array(errors, type=pa.string())], names=["clip", "segments", "error"])

    return clips.select("clip", "path").mapInArrow(task, f"clip string, segments {SEGMENTS}, error string")


def recognise_samples(chunks: DataFrame, make: Callable[[], Callable]) -> DataFrame:
    """(key, chunk, last_us, segments, error) of chunks(key, chunk, last_us, samples), of a batch or a stream: `make` loads a model once for each partition and
    gives a function from an array of samples to segments. A chunk that fails gives its error, which is logged too, and no segments; the others go on."""

    def task(batches: Batches) -> Batches:
        run = make()
        for batch in batches:
            found, errors = [], []
            for key, chunk, samples in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3), strict=True):
                try:
                    found.append(run(samples.values.to_numpy(zero_copy_only=False)))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001
                    logging.getLogger(__name__).warning("chunk %s of stream %s is dropped: %s", chunk, key, e)
                    found.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, type=_SEGMENTS), pa.array(errors, type=pa.string())], names=["key", "chunk", "last_us", "segments", "error"])

    return chunks.select("key", "chunk", "last_us", "samples").mapInArrow(task, f"key bigint, chunk bigint, last_us bigint, segments {SEGMENTS}, error string")


_SEGMENTS = pa.list_(pa.struct([("words", pa.list_(pa.struct([("word", pa.string()), ("start", pa.float64()), ("end", pa.float64())])))]))


def speak(texts: DataFrame, make: Callable[[], Callable[[str], bytes]], least_bytes: int = 200) -> DataFrame:
    """(replacement, audio, error) of distinct texts(replacement); audio under `least_bytes` is an error."""

    def task(batches: Batches) -> Batches:
        run = make()
        for batch in batches:
            audio, errors = [], []
            for text in batch.column(0).to_pylist():
                try:
                    made = run(text)
                    small = len(made) < least_bytes
                    audio.append(None if small else made)
                    errors.append(f"ValueError: {len(made)} bytes of audio" if small else None)
                except Exception as e:  # noqa: BLE001
                    audio.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(audio, type=pa.binary()), pa.array(errors, type=pa.string())], names=["replacement", "audio", "error"])

    return texts.select("replacement").mapInArrow(task, "replacement string, audio binary, error string")


_STORED = "id string, replacement string, voice string, audio binary, error string"


def speech_store(texts: DataFrame, make: Callable[[], Callable[[str], bytes]], store: str, voice: str = "", least_bytes: int = 200) -> DataFrame:
    """(replacement, audio, error) of texts(replacement), each made once: the store, a Parquet folder, has audio by the hash of text and voice, and only
    texts that it lacks are spoken and added. Errors are not stored, so they are tried again, and are returned by the run that met them alone."""
    from uuid import uuid4

    from pyspark.sql import functions as F

    spark = texts.sparkSession
    wanted = texts.select("replacement").where("replacement is not null").distinct().withColumn("id", F.sha2(F.concat_ws("\n", F.lit(voice), "replacement"), 256))
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(store)
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    known = spark.read.schema(_STORED).parquet(store) if there else spark.createDataFrame([], _STORED)
    lacking = wanted.join(known.where("error is null").select("id"), "id", "left_anti")
    run = uuid4().hex
    made = speak(lacking, make, least_bytes).join(wanted, "replacement").select("id", "replacement", F.lit(voice).alias("voice"), "audio", F.when(F.col("error").isNotNull(), F.concat(F.lit(run + " "), "error")).alias("error"))
    made.write.mode("append").parquet(store)
    stored = spark.read.schema(_STORED).parquet(store).where(F.col("error").isNull() | F.startswith("error", F.lit(run)))
    # two runs at once may both have made a text: one of them is given
    one = stored.join(wanted.select("id"), "id", "left_semi").groupBy("id").agg(F.min_by(F.struct("replacement", "audio", "error"), F.coalesce("error", F.lit(""))).alias("x"))
    return one.select("x.replacement", "x.audio", F.substring("x.error", 34, 1 << 30).alias("error"))


def save_clips(hits: DataFrame, speech: DataFrame, folder: str) -> DataFrame:
    """Writes the audio of speech(replacement, audio) for each of hits(clip, filename, replacement) as folder/clip/filename; gives (clip, filename,
    length) of what was written, the files that a timeline may use. A file is whole once it has its name, and writing it again changes nothing."""

    def task(batches: Batches) -> Batches:
        files, root = opened(folder)
        for batch in batches:
            lengths = []
            for clip, filename, audio in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                files.create_dir(f"{root}/{clip}")
                put(files, f"{root}/{clip}/{filename}", audio)
                lengths.append(len(audio))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lengths, type=pa.int64())], names=["clip", "filename", "length"])

    made = speech.where("audio is not null").select("replacement", "audio")
    return hits.join(made, "replacement").select("clip", "filename", "audio").mapInArrow(task, "clip string, filename string, length bigint")


def save_files(rows: DataFrame, folder: str) -> int:
    """Writes data of rows(rel, data) as folder/rel; gives the number of files."""

    def task(batches: Batches) -> Batches:
        files, root = opened(folder)
        for batch in batches:
            for rel, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                files.create_dir(f"{root}/{rel}".rpartition("/")[0])
                put(files, f"{root}/{rel}", data)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], type=pa.int64())], names=["n"])

    return rows.select("rel", "data").mapInArrow(task, "n bigint").groupBy().sum("n").first()[0] or 0


def probe(clips: DataFrame, make: Callable[[], Callable[[str], tuple[float, int, int, bool]]]) -> DataFrame:
    """(clip, duration_s, sample_rate, channels, has_video) of clips(clip, path); a clip that fails has no duration, 44100 Hz, two
    channels and no video."""

    def task(batches: Batches) -> Batches:
        run = make()
        for batch in batches:
            rows = []
            for path in batch.column(1).to_pylist():
                try:
                    rows.append(run(path))
                except Exception:  # noqa: BLE001
                    rows.append((None, 44100, 2, False))
            kinds = (pa.float64(), pa.int32(), pa.int32(), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], type=k) for i, k in enumerate(kinds))], names=["clip", "duration_s", "sample_rate", "channels", "has_video"])

    return clips.select("clip", "path").mapInArrow(task, "clip string, duration_s double, sample_rate int, channels int, has_video boolean")


def render(plan: DataFrame, make: Callable[[], Callable[[str, list[dict]], str]]) -> DataFrame:
    """(clip, output, error) of plan(clip, parts): cutting, joining, encoding and muxing of one clip's ordered parts, and the copy of
    an original (parts null) are the function's."""

    def task(batches: Batches) -> Batches:
        run = make()
        for batch in batches:
            made, errors = [], []
            for clip, parts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    made.append(run(clip, parts))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001
                    made.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, type=pa.string()), pa.array(errors, type=pa.string())], names=["clip", "output", "error"])

    return plan.select("clip", "parts").mapInArrow(task, "clip string, output string, error string")


def word_stub() -> Callable[[str], list[dict]]:
    """A stand-in recogniser: the path's name, split at _ and -, 0.4 s a word."""

    def run(path: str) -> list[dict]:
        name = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
        words = name.replace("-", "_").split("_")
        return [{"words": [{"word": w, "start": 0.4 * i, "end": 0.4 * i + 0.3} for i, w in enumerate(words)]}]

    return run


def speech_stub() -> Callable[[str], bytes]:
    """A stand-in voice: bytes that depend on the text alone."""
    return lambda text: (text.encode() or b" ") * 200


def decode(clips: DataFrame, make: Callable[[], Callable[[str], Iterator]], block: int = 1024) -> DataFrame:
    """(clip, block_no, samples) of clips(clip, path): the function gives an iterator over arrays of mono samples, which are cut into
    blocks as they come, so a clip is never held whole. The last block may be short."""

    def task(batches: Batches) -> Batches:
        import numpy as np

        run = make()
        shape = pa.schema([("clip", pa.string()), ("block_no", pa.int64()), ("samples", pa.list_(pa.float32()))])

        def rows(clip: str, first: int, parts: list) -> pa.RecordBatch:
            columns = ([clip] * len(parts), range(first, first + len(parts)), parts)
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, shape, strict=True)], schema=shape)

        for batch in batches:
            for clip, path in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n, rest = 0, np.zeros(0, dtype=np.float32)
                for part in run(path):
                    rest = np.concatenate([rest, np.asarray(part, dtype=np.float32)])
                    full = len(rest) // block
                    if full:
                        yield rows(clip, n, list(rest[: full * block].reshape(full, block)))
                        n, rest = n + full, rest[full * block :]
                if len(rest):
                    yield rows(clip, n, [rest])

    return clips.select("clip", "path").mapInArrow(task, "clip string, block_no bigint, samples array<float>")


def tone_stub() -> Callable[[str], Iterator]:
    """A stand-in decoder: 3000 samples of a tone, in uneven parts."""
    import numpy as np

    def run(path: str) -> Iterator:
        x = 0.5 * np.sin(np.arange(3000) / 5)
        yield from np.split(x, [700, 701, 2500])

    return run
