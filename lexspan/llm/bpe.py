"""Byte-level BPE encoding and decoding in overlapping chunks.

Every text is cut at fixed places into chunks that overlap; each is pre-tokenised on its own. Near a cut a chunk may see other
pre-tokens than the whole text has, so neighbours are stitched where they resynchronise: at the first pre-token in their overlap that
both have, far enough from the chunks' ends. From a true boundary on, pre-tokens depend on what follows alone, so the later
chunk is right from there. Where there is none, the earlier chunk goes on. The pieces are then encoded, each pre-token
once for a worker (a bounded cache); decoding concatenates the raw bytes of the ids.

Chunks are pre-tokenised in parallel: a text of up to `share` chunks by the task that reads it, as one of many; the chunks of a longer text
are rows that Spark deals to all tasks, and the task that gets its chunks' pre-tokens back in order stitches and encodes them. Both
ways cut, pre-tokenise and stitch by the same functions.

Cases: a null text is the empty one (no ids); a null doc_id is kept; repeated rows give repeated results; an empty table gives
no rows; other columns are ignored; a text of any length is encoded whole.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspan.llm.common import Tables, arrow, as_batch, id_text, partitions, rows_of, whole_groups

DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_pretokens long, n_chunks long"
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("n_pretokens", pa.int64()), ("n_chunks", pa.int64())])


class ByteBpe:
    """Encoder and decoder by a rank file. `chunk` and `overlap` are in characters; the cache holds up to `cache` pre-tokens of at most
    `longest` characters."""

    def __init__(self, path: str, pattern: str, chunk: int = 2048, overlap: int = 64, cache: int = 1 << 18, longest: int = 64):
        import base64

        import regex
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        # the pre-tokens are found here; to this encoder each is one piece
        self.one = tiktoken.Encoding("ranks", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
        compiled = regex.compile(pattern)
        self.findall, self.finditer = compiled.findall, compiled.finditer
        self.chunk, self.overlap, self.limit, self.longest = chunk, overlap, cache, longest
        self.cache: dict[str, bytes] = {}
        self.spilled = 0
        table = [b""] * (1 + max(ranks.values()))
        for raw, rank in ranks.items():
            table[rank] = raw
        self.raw = table

    def windows(self, n: int) -> list[tuple[int, int]]:
        """Where the chunks of a text of n characters begin and end: a chunk begins every `chunk` characters, and takes `overlap` of the next."""
        return [(at, min(n, at + self.chunk + self.overlap)) for at in range(0, max(n, 1), self.chunk)]

    def split(self, piece: str) -> tuple[list[str], list[int]]:
        """A chunk's pre-tokens and where each ends in it. The pattern's matches leave nothing out; if another pattern does, the rest is lost, as
        in any encoding by it, and places are counted by match."""
        found = self.findall(piece)
        ends = list(accumulate(map(len, found)))
        if (ends[-1] if ends else 0) != len(piece):
            spans = [m.span() for m in self.finditer(piece)]
            return [piece[a:b] for a, b in spans], [b for _, b in spans]
        return found, ends

    def stitch(self, text: str, parts: list[tuple[list[str], list[int]]]) -> list[str]:
        """The pre-tokens of the whole text from those of its chunks."""
        windows = self.windows(len(text))
        if len(parts) == 1:
            return parts[0][0]
        found: list[str] = []
        first, i = 0, 0  # of chunk i the pre-tokens from number `first` on are right, but for its end
        own, ends = parts[0]
        base, end = windows[0]
        while end < len(text):
            at, other = self._meet(own, ends, base, first, parts[i + 1], windows[i + 1][0])
            overlap = self.overlap
            while at < 0 and end < len(text):
                # no common pre-token: this chunk goes on further from the last one that is known, over later chunks if need be
                overlap *= 2
                base += ends[first - 1] if first else 0
                end = min(len(text), windows[i][1] + overlap)
                (own, ends), first = self.split(text[base:end]), 0
                while i + 2 < len(windows) and windows[i + 1][1] < end:
                    i += 1
                at, other = self._meet(own, ends, base, first, parts[i + 1], windows[i + 1][0])
            if at < 0:
                break
            found += own[first:at]
            i += 1
            (own, ends), (base, end), first = parts[i], windows[i], other
        found += own[first:]
        return found

    @staticmethod
    def _meet(own: list[str], ends: list[int], base: int, first: int, after: tuple[list[str], list[int]], begin: int) -> tuple[int, int]:
        """Where two chunks resynchronise: the numbers, in the one and in the other, of the first pre-token from `first` on that both have, or -1. The last
        two of either do not count, as they may depend on what follows its end."""
        tokens, stops = after
        i = max(first, bisect_left(ends, begin - base + 1))
        k, last, least = 0, len(own) - 2, len(tokens) - 2
        while i < last and k < least:
            a, b = base + ends[i], begin + stops[k]
            if a == b and len(own[i]) == len(tokens[k]):
                return i, k
            i, k = i + (a <= b), k + (b <= a)
        return -1, -1

    def pretokens(self, text: str) -> tuple[list[str], int]:
        """The pattern's matches over the whole text, and how many chunks they came from."""
        parts = [self.split(text[a:b]) for a, b in self.windows(len(text))]
        return self.stitch(text, parts), len(parts)

    def _encoded(self, token: str) -> bytes:
        return self.one.encode_to_numpy(token, disallowed_special=()).astype("<u4", copy=False).tobytes()

    def ids(self, tokens: list[str]) -> np.ndarray:
        """The ids of pre-tokens. New ones go to the cache while there is room, else to a map for this text alone; if the cache has been full for
        long, it starts anew."""
        cache = self.cache
        try:
            raw = b"".join([cache[x] for x in tokens])
        except KeyError:
            own = {x: cache.get(x) or self._encoded(x) for x in set(tokens)}
            new = {x: y for x, y in own.items() if len(x) <= self.longest and x not in cache}
            if len(cache) + len(new) <= self.limit:
                cache.update(new)
            else:
                self.spilled += len(new)
                if self.spilled > 8 * self.limit:
                    cache.clear()
                    self.spilled = 0
            raw = b"".join([own[x] for x in tokens])
        return np.frombuffer(raw, dtype="<u4")

    def encode(self, text: str) -> tuple[np.ndarray, int, int]:
        """(ids, number of pre-tokens, number of chunks)."""
        tokens, chunks = self.pretokens(text)
        return self.ids(tokens), len(tokens), chunks

    def decode(self, ids: np.ndarray) -> bytes:
        table = self.raw
        return b"".join([table[x] for x in ids.tolist()])


@lru_cache(2)
def coder(path: str | None, pattern: str | None, chunk: int, overlap: int) -> ByteBpe:
    import public_tokenizers

    return ByteBpe(path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), pattern or public_tokenizers.PATTERN, chunk, overlap)


def _encoded(docs: DataFrame, how: tuple, share: int, fields: str, schema: pa.Schema, row: Callable) -> DataFrame:
    """row(bpe, doc_id, ids, number of pre-tokens, number of chunks) of each text, as `fields` and `schema` say."""
    chunk = how[2]
    texts = id_text(docs)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(*how)
        for keys, found in rows_of(batches):
            yield as_batch(schema, *zip(*(row(bpe, key, *bpe.encode(x)) for key, x in zip(keys, found, strict=True)), strict=True))

    few = arrow(texts.where(F.length("text") <= chunk * share), whole, fields)
    # a written table, as rows are numbered in it and read twice
    long = Tables(docs.sparkSession, "bpe").put("long", texts.where(F.length("text") > chunk * share).withColumn("row", F.monotonically_increasing_id()))
    pieces = pa.schema([("row", pa.int64()), ("n", pa.int32()), ("doc_id", pa.string()), ("text", pa.string()), ("lengths", pa.binary())])
    names = "row long, n int, doc_id string, text string, lengths binary"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(*how)
        for batch in batches:
            for i in range(batch.num_rows):
                key, text, number = (c[0].as_py() for c in batch.slice(i, 1).columns)
                at = bpe.windows(len(text))
                yield as_batch(pieces, [number] * len(at), range(len(at)), [key] * len(at), [text[a:b] for a, b in at], [b""] * len(at))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(*how)
        for batch in batches:
            lengths = [np.diff(bpe.split(x)[1], prepend=0).astype("<i4").tobytes() for x in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(lengths, type=pa.binary())], schema=pieces)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(*how)
        for number, _, key, text, lengths in whole_groups(batches):
            edges = [0, *(np.flatnonzero(number[1:] != number[:-1]) + 1).tolist(), len(number)]
            for a, b in zip(edges, edges[1:], strict=False):
                parts = []
                for piece, raw in zip(text[a:b], lengths[a:b], strict=True):
                    ends = np.cumsum(np.frombuffer(raw, dtype="<i4")).tolist()
                    parts.append(([piece[x:y] for x, y in zip([0, *ends], ends, strict=False)], ends))
                tokens = bpe.stitch("".join(x[:chunk] for x in text[a:b]), parts)
                yield as_batch(schema, *([x] for x in row(bpe, None if key[a] is None else int(key[a]), bpe.ids(tokens), len(tokens), b - a)))

    n = partitions(docs.sparkSession)
    dealt = arrow(arrow(long.select(F.col("doc_id").cast("string").alias("doc_id"), "text", "row"), cut, names).repartition(n, "row", "n"), split, names)
    many = arrow(dealt.repartition(n, "row").sortWithinPartitions("row", "n"), join, fields)
    return few.unionByName(many)


def encode_documents(docs: DataFrame, path: str | None = None, pattern: str | None = None, chunk: int = 2048, overlap: int = 64, share: int = 16) -> DataFrame:
    """Ids of every whole text, as DIGESTS says. `path`: a rank file that every worker has; `pattern`: the pre-token pattern, whose matches
    leave nothing out; a text of over `share` chunks is dealt to many tasks."""

    def row(bpe: ByteBpe, key: int | None, ids: np.ndarray, n: int, chunks: int) -> tuple:
        said = ",".join(map(str, ids.tolist())).encode()
        return key, len(ids), hashlib.sha256(said).hexdigest(), hashlib.sha256(bpe.decode(ids)).hexdigest(), n, chunks

    return _encoded(docs, (path, pattern, chunk, overlap), share, DIGESTS, _SCHEMA, row)


def tokens_of(docs: DataFrame, path: str | None = None, pattern: str | None = None, chunk: int = 2048, overlap: int = 64, share: int = 16) -> DataFrame:
    """doc_id and ids as array<int>: the operator's own output."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
    return _encoded(docs, (path, pattern, chunk, overlap), share, "doc_id long, ids array<int>", schema, lambda bpe, key, ids, n, chunks: (key, ids.astype("i4")))
