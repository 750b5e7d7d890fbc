"""Packing by best-fit decreasing.

Documents are encoded, closed by one end id, and cut into full windows; what remains of each goes into windows by best-fit
decreasing. A segment tree indexed by remaining capacity finds the tightest open window that a piece fits.

Each task packs what it reads, in pools of `pool` remainders, so no shuffle is needed and memory is bounded; sequence ids hold
the task's partition in their upper bits. At most the last windows of a pool stay part empty.

Cases: a null text is the empty one (its only id is the end id); a null doc_id is kept as null; repeated rows are packed each;
an empty table gives no rows; ties in length go by the order of reading; other columns are ignored; a text of any length is encoded
whole, runs of white space or of letters included.
"""

from __future__ import annotations

import re
import zlib
from collections import deque
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lexspan.llm.common import arrow, as_batch, id_text, rows_of

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_SCHEMA = pa.schema([(x.split()[0], pa.int64()) for x in PIECES.split(", ")])


class CapacityTree:
    """Counts open windows by remaining capacity; `tightest(n)` is the least capacity of n or more that is open, or -1."""

    def __init__(self, top: int):
        self.leaves = 1 << top.bit_length()
        self.any = bytearray(2 * self.leaves)
        self.open: list[deque] = [deque() for _ in range(top + 1)]

    def add(self, capacity: int, window: int) -> None:
        self.open[capacity].append(window)
        i = capacity + self.leaves
        while i and not self.any[i]:
            self.any[i] = 1
            i >>= 1

    def tightest(self, need: int) -> int:
        i = need + self.leaves
        if self.any[i]:
            return need
        while i > 1:
            if not i & 1 and self.any[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.any[2 * i] else 2 * i + 1
                return i - self.leaves
            i >>= 1
        return -1

    def take(self, capacity: int) -> int:
        window = self.open[capacity].popleft()
        if not self.open[capacity]:
            i = capacity + self.leaves
            self.any[i] = 0
            i >>= 1
            while i and not (self.any[2 * i] or self.any[2 * i + 1]):
                self.any[i] = 0
                i >>= 1
        return window


def best_fit_decreasing(lengths: list[int], window: int) -> list[tuple[int, int]]:
    """(window number, offset) for each length, all between 1 and `window`."""
    tree, found, n = CapacityTree(window), [(0, 0)] * len(lengths), 0
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        room = tree.tightest(lengths[k])
        if room < 0:
            room, at, n = window, n, n + 1
        else:
            at = tree.take(room)
        found[k] = (at, window - room)
        if room > lengths[k]:
            tree.add(room - lengths[k], at)
    return found


# The white space of the pre-token pattern's \s, where it runs on for long.
_RUN = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{1024,}")


def _rank_file(path: str | None) -> dict[bytes, int]:
    import base64

    import public_tokenizers

    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def rank_vocabulary(path: str | None = None) -> list[bytes]:
    """The bytes of each id of a rank file, by default byte_bpe_50k's."""
    ranks = _rank_file(path)
    out = [b""] * (1 + max(ranks.values()))
    for piece, i in ranks.items():
        out[i] = piece
    return out


@lru_cache(2)
def _ranks(path: str | None):
    """(encoder by the pre-token pattern, encoder of a text as one pre-token)."""
    import public_tokenizers
    import tiktoken

    ranks = _rank_file(path)
    return tuple(tiktoken.Encoding("ranks", pat_str=p, mergeable_ranks=ranks, special_tokens={}) for p in (public_tokenizers.PATTERN, r"[\s\S]+"))


def rank_encoder(path: str | None = None, special: str | None = "<|endoftext|>", special_id: int = 50256) -> Callable[[str], np.ndarray]:
    """Encodes by the rank file of the byte_bpe_50k vocabulary. Its ids are those of byte_bpe_50k.json, whose special string is
    one id wherever it occurs (with `special` None it is plain text); the rank file is several times as fast. `path`: a file that every worker has.

    The pattern's `\\s+(?!\\S)` backtracks over a run of white space, which overflows the matcher's stack on a long one. So long runs
    are cut out first. A maximal run begins with a pre-token, as no other alternative of the pattern ends in white space; the alternative takes
    it whole at the end of a text and but for its last character before anything else, which then begins a pre-token too. Nothing in the pattern looks
    back, so what stands before, within and after is encoded apart with the same result."""
    plain, single = _ranks(path)
    mark = np.array([special_id], dtype=np.uint32)

    def parts(text: str) -> Iterator[np.ndarray]:
        at = 0
        for m in _RUN.finditer(text):
            end = m.end() - (m.end() < len(text))
            yield plain.encode_to_numpy(text[at : m.start()], disallowed_special=())
            yield single.encode_to_numpy(text[m.start() : end], disallowed_special=())
            at = end
        yield plain.encode_to_numpy(text[at:], disallowed_special=())

    def encode(text: str) -> np.ndarray:
        found: list[np.ndarray] = []
        for i, piece in enumerate(text.split(special) if special else [text]):
            if i:
                found.append(mark)
            found += parts(piece)
        return found[0] if len(found) == 1 else np.concatenate(found)

    return encode


def pack(docs: DataFrame, window: int = 2048, end_id: int = 1, pool: int = 8192, encoder: Callable[[], Callable[[str], np.ndarray]] = rank_encoder) -> DataFrame:
    """One row for each piece, as PIECES says. `encoder` makes the text → ids function in each worker."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ctx = TaskContext.get()
        first, used = (ctx.partitionId() if ctx else 0) << 40, 0
        encode, end = encoder(), np.array([end_id], dtype="<u4").tobytes()
        full: list[tuple] = []
        rest: list[tuple] = []

        def flush() -> pa.RecordBatch:
            nonlocal used, full, rest
            placed = best_fit_decreasing([r[2] for r in rest], window)
            rows = full + [(*r, first + used + at, offset) for r, (at, offset) in zip(rest, placed, strict=True)]
            used += 1 + max((at for at, _ in placed), default=-1)
            full, rest = [], []
            return as_batch(_SCHEMA, *(zip(*rows, strict=True) if rows else [[]] * len(_SCHEMA)))

        for ids, texts in rows_of(batches):
            for doc_id, text in zip(ids, texts, strict=True):
                raw = encode(text).astype("<u4", copy=False).tobytes() + end
                n = len(raw) // 4
                for at in range(0, n, window):
                    length = min(window, n - at)
                    row = (doc_id, at, length, zlib.crc32(raw[4 * at : 4 * (at + length)]), n)
                    if length == window:
                        full.append((*row, first + used, 0))
                        used += 1
                    else:
                        rest.append(row)
                if len(rest) >= pool or len(full) >= 4 * pool:
                    yield flush()
        yield flush()

    return arrow(id_text(docs), task, PIECES)
