"""Live muting as Structured Streaming. Each operator has a batch twin in lexspan.operators.live with the same results, for rows that come
in order or, where a lateness is given, within it; state is one small row a key, and what is held back until its time has come."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from lexspan.functions.signal import BLOCK, DELAY_S, LEAST_MUTE_S, RATE
from lexspan.operators import match
from lexspan.sources import adapters

_LEAST_US = int(LEAST_MUTE_S * 1_000_000)
_NEVER = -(1 << 62)


def _in_order(frames: Iterator[pd.DataFrame], *by: str) -> pd.DataFrame:
    """A key's rows of one micro-batch, whose size the source's files a trigger bound."""
    return pd.concat(list(frames)).sort_values(list(by), kind="stable")


def _in_due_order(rows: DataFrame, late: str, out: str, own: str, first: tuple, step: Callable) -> DataFrame:
    """rows(key, id, at timestamp, due_us, dur_us, null for a block) taken in order of due_us, whatever order they come in, if none comes over `late`
    after a later one. A row is held in its key's state until the watermark has passed its due time, when no row due before can follow; the key wakes at
    the earliest such time. step(rows in order, own state) → (columns of `out` but key, own state).

    What moves the watermark is any key's rows: a source that falls silent has to send heartbeats (rows without an id)."""
    names = [f.split()[0] for f in out.split(", ")]

    def run(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        ids, due, dur, *mine = state.get if state.exists else ([], [], [], *first)
        held = [pd.DataFrame({"id": ids, "due_us": due, "dur_us": dur}, dtype="int64")]
        if not state.hasTimedOut:
            held += [x.dropna(subset=["id"]).assign(dur_us=lambda d: d["dur_us"].fillna(_BLOCK))[["id", "due_us", "dur_us"]].astype("int64") for x in frames]
        rows = pd.concat(held, ignore_index=True).assign(block=lambda d: d["dur_us"] == _BLOCK)
        ready = rows["due_us"] <= state.getCurrentWatermarkMs() * 1000
        now, later = rows[ready].sort_values(["due_us", "block", "id"], kind="stable"), rows[~ready]
        made, mine = step(now, mine)
        state.update((later["id"].tolist(), later["due_us"].tolist(), later["dur_us"].tolist(), *mine))
        if len(later):
            state.setTimeoutTimestamp(-(-int(later["due_us"].min()) // 1000))
        yield pd.DataFrame({"key": key[0], **made})[names]

    marked = rows.withWatermark("at", late).select("key", "id", "at", "due_us", "dur_us")
    return marked.groupBy("key").applyInPandasWithState(run, out, f"ids array<bigint>, due array<bigint>, dur array<bigint>, {own}", "append", "EventTimeTimeout")


_BLOCK = -1  # stands for no duration


def _islands(rows: pd.DataFrame, mine: tuple, at: str = "now_us") -> tuple[dict, tuple]:
    until, island = mine
    now = rows[at].to_numpy()
    latest = np.maximum.accumulate(np.append(until, now + np.maximum(_LEAST_US, rows["dur_us"].to_numpy())))
    islands = island + np.cumsum(now >= latest[:-1])
    made = {"id": rows["id"].to_numpy(), "now_us": now, "until_us": latest[1:], "island": islands}
    return made, (int(latest[-1]), int(islands[-1]) if len(islands) else island)


_DEADLINES, _OF_DEADLINES = "key bigint, id bigint, now_us bigint, until_us bigint, island bigint", "until_us bigint, island bigint"


def mute_deadlines(hits: DataFrame, late: str | None = None) -> DataFrame:
    """hits(key, id, now_us, dur_us) → key, id, now_us, until_us, island. Rows of a micro-batch are taken in time order; with `late`, for hits
    with `at`, all rows that come within it are."""
    if late is not None:
        return _in_due_order(hits.withColumn("due_us", F.col("now_us")), late, _DEADLINES, _OF_DEADLINES, (_NEVER, 0), lambda rows, mine: _islands(rows, mine, "due_us"))

    def step(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        made, mine = _islands(_in_order(frames, "now_us", "id"), state.get if state.exists else (_NEVER, 0))
        state.update(mine)
        yield pd.DataFrame({"key": key[0], **made})

    rows = hits.select("key", "id", "now_us", "dur_us")
    return rows.groupBy("key").applyInPandasWithState(step, _DEADLINES, _OF_DEADLINES, "append", "NoTimeout")


def sample_chunks(blocks: DataFrame, seconds: float = 1.0, rate: int = RATE) -> DataFrame:
    """blocks(key, id, now_us, samples array<float>) → key, chunk, first_us, last_us, samples: blocks are gathered until they have a chunk's samples, then
    handed on as one array, without a remainder. The state is the samples of a chunk that is not full."""
    enough = int(seconds * rate)

    def step(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held, chunk, first = state.get if state.exists else ([], 0, None)
        rows = _in_order(frames, "now_us", "id")
        now, parts = rows["now_us"].to_numpy(), [np.asarray(held, dtype=np.float32), *(np.asarray(x, dtype=np.float32) for x in rows["samples"])]
        out, begun, size = [], 0, len(parts[0])
        for i, t in enumerate(now.tolist(), 1):
            first = t if first is None else first
            size += len(parts[i])
            if size >= enough:
                out.append((key[0], chunk, first, t, np.concatenate(parts[begun : i + 1])))
                chunk, begun, size, first = chunk + 1, i + 1, 0, None
        state.update((np.concatenate([np.zeros(0, dtype=np.float32), *parts[begun:]]).tolist(), chunk, first))
        yield pd.DataFrame(out, columns=["key", "chunk", "first_us", "last_us", "samples"])

    rows = blocks.select("key", "id", "now_us", F.coalesce("samples", F.array().cast("array<float>")).alias("samples"))
    return rows.groupBy("key").applyInPandasWithState(step, "key bigint, chunk bigint, first_us bigint, last_us bigint, samples array<float>", "held array<float>, chunk bigint, first_us bigint", "append", "NoTimeout")


def spoken_hits(chunks: DataFrame, make: Callable, lexicon: DataFrame) -> DataFrame:
    """chunks(key, chunk, last_us, samples), as sample_chunks gives them or of a batch, recognised and matched: key, chunk, place, word, replacement,
    start, end, now_us, dur_us, where now_us is when the chunk was full. A chunk that fails is reported and dropped; no word is put together over chunks."""
    heard = adapters.recognise_samples(chunks, make).where("error is null")
    words = heard.select(F.col("key").alias("stream"), "chunk", "last_us", F.posexplode(F.flatten(F.transform("segments", lambda s: F.coalesce(s["words"], F.array().cast(_WORDS))))).alias("place", "w"))
    found = hits_of(words.select("stream", "chunk", "last_us", "place", "w.*"), lexicon)
    return found.select(F.col("stream").alias("key"), "chunk", F.col("place").cast("bigint").alias("place"), "word", "replacement", "start", "end", F.col("last_us").alias("now_us"), F.round((F.col("end") - F.col("start")) * 1_000_000).cast("bigint").alias("dur_us"))


_WORDS = "array<struct<word:string,start:double,end:double>>"


def asr_chunks(blocks: DataFrame, seconds: float = 1.0) -> DataFrame:
    """blocks(key, id, now_us, samples) → key, chunk, n_blocks, n_samples, last_id. Blocks are gathered until their samples reach the
    chunk's; then the count starts anew, without a remainder."""
    enough = int(seconds * RATE)

    def step(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, samples, chunk = state.get if state.exists else (0, 0, 0)
        rows = _in_order(frames, "now_us", "id")
        ids, sums = rows["id"].to_numpy(), np.cumsum(rows["samples"].to_numpy())
        out, done, taken = [], 0, 0  # rows and samples that are in a chunk; a step a chunk
        while (last := int(np.searchsorted(sums, taken + enough - samples))) < len(ids):
            out.append((key[0], chunk, n + last + 1 - done, samples + int(sums[last]) - taken, int(ids[last])))
            n, samples, chunk, done, taken = 0, 0, chunk + 1, last + 1, int(sums[last])
        state.update((n + len(ids) - done, samples + int(sums[-1]) - taken, chunk))
        yield pd.DataFrame(out, columns=["key", "chunk", "n_blocks", "n_samples", "last_id"])

    rows = blocks.select("key", "id", "now_us", F.coalesce("samples", F.lit(BLOCK)).cast("bigint").alias("samples"))
    return rows.groupBy("key").applyInPandasWithState(step, "key bigint, chunk bigint, n_blocks bigint, n_samples bigint, last_id bigint", "n bigint, samples bigint, chunk bigint", "append", "NoTimeout")


def hits_of(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Recognised words of a stream that have both times, against a static lexicon: the batch operator as a stream-static join."""
    return match.matches(match.timed(words), lexicon)


def mute_sessions(hits: DataFrame, late: str = "10 seconds") -> DataFrame:
    """Event-time mode: hits(key, at timestamp, dur_us) merged into mute sessions, closed by the watermark."""
    gap = F.concat(F.greatest(F.lit(int(LEAST_MUTE_S * 1000)).cast("bigint"), F.floor(F.col("dur_us") / 1000)).cast("string"), F.lit(" milliseconds"))
    rows = hits.withWatermark("at", late)
    return rows.groupBy("key", F.session_window("at", gap)).agg(F.count(F.lit(1)).alias("n_hits")).select("key", F.col("session_window.start").alias("from_at"), F.col("session_window.end").alias("until_at"), "n_hits")


def ticker(stream: DataFrame, by: str = "key") -> DataFrame:
    """Running counts of a stream, for update mode."""
    return stream.groupBy(by).agg(F.count(F.lit(1)).alias("n"))


def _gate(rows: pd.DataFrame, mine: tuple, at: str = "now_us") -> tuple[dict, tuple]:
    (until,) = mine
    now, block = rows[at].to_numpy(), rows["block"].to_numpy(dtype=bool)
    ends = np.where(block, _NEVER, now + np.maximum(_LEAST_US, rows["dur_us"].fillna(0).to_numpy().astype(np.int64)))
    latest = np.maximum.accumulate(np.append(until, ends))
    return {"id": rows["id"].to_numpy()[block], "now_us": now[block], "muted": (now < latest[1:])[block]}, (int(latest[-1]),)


_GATED = "key bigint, id bigint, now_us bigint, muted boolean"


def gated_blocks(marks: DataFrame) -> DataFrame:
    """marks(key, id, now_us, dur_us): a row with dur_us is a hit that sets a deadline, one without is a block. Gives each block's id,
    now_us and muted, as it comes in. A micro-batch is taken in time order, hits before blocks of the same time."""

    def step(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        made, mine = _gate(_in_order((x.assign(block=x["dur_us"].isna()) for x in frames), "now_us", "block", "id"), state.get if state.exists else (_NEVER,))
        state.update(mine)
        yield pd.DataFrame({"key": key[0], **made})

    rows = marks.select("key", "id", "now_us", "dur_us")
    return rows.groupBy("key").applyInPandasWithState(step, _GATED, "until_us bigint", "append", "NoTimeout")


def played_blocks(marks: DataFrame, delay_s: float = DELAY_S, late: str = "2 seconds") -> DataFrame:
    """marks(key, id, at, now_us, dur_us) as for gated_blocks, with the time `at` of now_us: each block plays `delay_s` after it came in and is gated then, by the
    deadlines that were set up to then, so a word recognised within the delay is silenced. Gives key, id, now_us (when it came in), out_us and muted. Blocks
    and hits may come in any order within `late`: they are held until no hit before the block's time of playing can follow."""
    delay_us = int(delay_s * 1_000_000)
    rows = marks.withColumn("due_us", F.col("now_us") + F.when(F.col("dur_us").isNull(), delay_us).otherwise(0))

    def step(rows: pd.DataFrame, mine: tuple) -> tuple[dict, tuple]:
        made, mine = _gate(rows, mine, "due_us")
        return made | {"out_us": made["now_us"], "now_us": made["now_us"] - delay_us}, mine

    return _in_due_order(rows, late, "key bigint, id bigint, now_us bigint, out_us bigint, muted boolean", "until_us bigint", (_NEVER,), step)


def muted_live(words: DataFrame, blocks: DataFrame, lexicon: DataFrame, delay_s: float | None = None, late: str = "2 seconds") -> DataFrame:
    """The live chain in one stream: words(key, id, word, start, end, now_us), as recognised from now_us on, are matched, each match sets a deadline,
    and blocks(key, id, now_us) come out as gated_blocks gives them or, with a delay, as played_blocks does; both then need the time `at` as well."""
    # a match's own key is the lexicon's
    more = [] if delay_s is None else ["at"]
    hits = hits_of(words.withColumnRenamed("key", "clip"), lexicon).select(F.col("clip").alias("key"), "id", *more, "now_us", F.round((F.col("end") - F.col("start")) * 1_000_000).cast("bigint").alias("dur_us"))
    marks = hits.unionByName(blocks.select("key", "id", *more, "now_us", F.lit(None).cast("bigint").alias("dur_us")))
    return gated_blocks(marks) if delay_s is None else played_blocks(marks, delay_s, late)


def delayed_blocks(blocks: DataFrame, delay: int) -> DataFrame:
    """blocks(key, id, now_us) → key, id, out_id: the block that plays when this one comes in, `delay` blocks before; null at first. The
    state is the ids of so many blocks."""

    def step(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        ids = _in_order(frames, "now_us", "id")["id"].tolist()
        line = held + ids
        out = [None] * (delay - len(held)) + line[: len(line) - delay] if len(line) > delay else [None] * len(ids)
        state.update((line[-delay:],))
        yield pd.DataFrame({"key": key[0], "id": ids, "out_id": pd.array(out, dtype="Int64")})

    rows = blocks.select("key", "id", "now_us")
    return rows.groupBy("key").applyInPandasWithState(step, "key bigint, id bigint, out_id bigint", "held array<bigint>", "append", "NoTimeout")


class Totals(StreamingQueryListener):
    """Adds up what observed() counts as micro-batches end: chunks and muted words so far, and `say` gets each new total, as a ticker's line."""

    def __init__(self, say: Callable[[dict], None] | None = None):
        self.totals: dict[str, int] = {}
        self.say = say

    def onQueryStarted(self, event) -> None: ...

    def onQueryIdle(self, event) -> None: ...

    def onQueryTerminated(self, event) -> None: ...

    def onQueryProgress(self, event) -> None:
        row = event.progress.observedMetrics.get(OBSERVED)
        if row is not None:
            for name, n in row.asDict().items():
                self.totals[name] = self.totals.get(name, 0) + (n or 0)
            if self.say:
                self.say(dict(self.totals))


OBSERVED = "live"


def observed(heard: DataFrame) -> DataFrame:
    """Hits or blocks with what a listener counts of them: rows, and muted ones where there is a column `muted`."""
    muted = [F.count_if("muted").alias("n_muted")] if "muted" in heard.columns else []
    return heard.observe(OBSERVED, F.count(F.lit(1)).alias("n_rows"), *muted)


def play(stream: DataFrame, device, checkpoint: str):
    """Hands each micro-batch to `device(frame, batch_id)`, the playback surface; batches that are tried again keep their number."""
    return stream.writeStream.foreachBatch(device).option("checkpointLocation", checkpoint)


def capture(spark: SparkSession, folder: str, files_at_once: int = 100) -> DataFrame:
    """Blocks that a recorder drops into a folder as Parquet: key, id, now_us, channels, samples."""
    schema = "key bigint, id bigint, now_us bigint, channels int, samples array<float>"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def first_channel(samples: Column, channels: Column) -> Column:
    """The first channel of interleaved samples."""
    return F.filter(samples, lambda x, i: i % channels == 0)
