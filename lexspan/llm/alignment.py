"""Cross-tokenizer alignment by byte-owner arrays.

Two tokenizers cut the same bytes. np.repeat lays the index of each one's tokens over the bytes that it has; where the pair of owners changes a link
begins (one token of A, one of B that share bytes), and where both change at once both sides are cut, so the tokens between two such cuts
form a group. Long texts are laid out `_SLICE` bytes at a time.

Counts of linked id pairs are corpus-wide. Documents are dealt into lots of about `lot` bytes; a lot keeps its distinct pairs once, and each
link as a number of its lot's pair. Only the distinct pairs of a lot are shuffled to be added up, and the sums go back to the lots, so
what is shuffled grows with distinct pairs a lot, not with tokens. The lots are a written table: a task that is run again reads the same lots.

Cases: texts that are null or empty, or whose tokens on either side do not join to the text with one blank before it, have no tokens: zeros and the
empty digest; repeated rows give a row each and count each; a null id is kept; an empty table gives no rows; pairs tied for a B id's highest count are
all its best; other columns are ignored; texts of any length are encoded whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexspan.llm.common import Tables, arrow, as_batch, id_text, rows_of
from lexspan.llm.packing import rank_encoder, rank_vocabulary

_SLICE = 1 << 20


@dataclass
class Side:
    """A tokenizer: `encode` gives the ids of a text that stands after one blank, `pieces` each id's bytes."""

    encode: Callable[[str], np.ndarray]
    pieces: list[bytes]

    def __post_init__(self):
        self.sizes = np.array([len(p) for p in self.pieces], dtype=np.int64)

    def tokens(self, text: str) -> np.ndarray | None:
        """The ids, if they join to the blank and the text."""
        found = self.encode(text)
        return found if b"".join(map(self.pieces.__getitem__, found.tolist())) == b" " + text.encode() else None


@lru_cache(2)
def rank_side(path: str | None = None) -> Side:
    """Byte-level ranks, by default those of byte_bpe_50k, whose special string is plain text here. `path`: a file that every worker has."""
    encode = rank_encoder(path, special=None)
    return Side(lambda text: encode(" " + text), rank_vocabulary(path))


@lru_cache(2)
def piece_side(path: str | None = None) -> Side:
    """A sentencepiece model that puts one blank before the text, by default piece_bpe_32k. `path`: as above."""
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
    named = map(model.id_to_piece, range(model.get_piece_size()))
    pieces = [bytes([int(p[3:-1], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(named)]
    return Side(lambda text: np.array(model.encode(text, num_threads=1), dtype=np.int64), pieces)


def _owners(ends: np.ndarray, x: int, y: int) -> np.ndarray:
    """The index of the token that has each of the bytes x to y - 1, of tokens that end at `ends`."""
    of = np.arange(np.searchsorted(ends, x, side="right"), np.searchsorted(ends, y) + 1, dtype=np.int32)
    begun = np.where(of > 0, ends[of - 1], 0)
    return np.repeat(of, np.minimum(ends[of], y) - np.maximum(begun, x))


def links_of(ends_a: np.ndarray, ends_b: np.ndarray, step: int = _SLICE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index in A, index in B, whether both begin here) of each link, in order; the tokens end at these bytes, the last of both at the same."""
    out: list[list[np.ndarray]] = [[], [], []]
    before = (-1, -1)
    for x in range(0, int(ends_a[-1]) if len(ends_a) else 0, step):
        a, b = (_owners(ends, x, min(x + step, int(ends_a[-1]))) for ends in (ends_a, ends_b))
        new_a, new_b = (np.concatenate([[o[0] != was], o[1:] != o[:-1]]) for o, was in ((a, before[0]), (b, before[1])))
        at = np.flatnonzero(new_a | new_b)
        for column, values in zip(out, (a[at], b[at], (new_a & new_b)[at]), strict=True):
            column.append(values)
        before = (int(a[-1]), int(b[-1]))
    return tuple(np.concatenate(c) if c else np.zeros(0, dtype=np.int64) for c in out)


@dataclass
class Aligned:
    """Texts aligned together: tokens and links of all, and how many each text has."""

    a: np.ndarray
    b: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray
    cut: np.ndarray

    def per_text(self, of_link: np.ndarray) -> np.ndarray:
        """Sums of values of links for each text."""
        ends = np.searchsorted(self.link_a, np.cumsum(self.n_a))
        sums = np.concatenate([[0], np.cumsum(of_link)])
        return np.diff(sums[np.concatenate([[0], ends])])

    def groups(self) -> tuple[np.ndarray, np.ndarray]:
        """The group of each token of A and of B."""
        group = np.cumsum(self.cut) - 1
        return tuple(group[np.searchsorted(link, np.arange(len(ids)))] for link, ids in ((self.link_a, self.a), (self.link_b, self.b)))


def align(texts: list[str], a: Side, b: Side) -> Aligned:
    ids: tuple[list, list] = ([], [])
    none = np.zeros(0, dtype=np.int64)
    for text in texts:
        found = [side.tokens(text) if text else none for side in (a, b)]
        for column, x in zip(ids, found, strict=True):
            column.append(none if any(y is None for y in found) else x)
    of_a, of_b = (np.concatenate([none, *column]).astype(np.int64) for column in ids)
    n_a, n_b = (np.array([len(x) for x in column], dtype=np.int64) for column in ids)
    return Aligned(of_a, of_b, n_a, n_b, *links_of(np.cumsum(a.sizes[of_a]), np.cumsum(b.sizes[of_b])))


@lru_cache(2)
def _said(n_a: int, n_b: int) -> list[bytes]:
    """Each id as it is written: of A inside and at the end of a group's first half, then of B inside and at the end of a group."""
    return [b"%d%c" % (i, c) for n, marks in ((n_a, b",|"), (n_b, b",;")) for i in range(n) for c in marks]


def group_digests(found: Aligned, n_a: int, n_b: int) -> list[str]:
    """Hex SHA-256 of `a1,a2|b1;a3|b2,b3` for each text, in order of the groups; '' without tokens."""
    in_a, in_b = found.groups()
    count_a, count_b = np.bincount(in_a), np.bincount(in_b)
    order = np.empty(len(found.a) + len(found.b), dtype=np.int64)
    last_a, last_b = (np.concatenate([g[1:] != g[:-1], [True]])[: len(g)] for g in (in_a, in_b))
    order[np.arange(len(in_a)) + (np.cumsum(count_b) - count_b)[in_a]] = 2 * found.a + last_a
    order[np.arange(len(in_b)) + np.cumsum(count_a)[in_b]] = 2 * (n_a + found.b) + last_b
    table, out, at = _said(n_a, n_b), [], 0
    for n in (found.n_a + found.n_b).tolist():
        out.append(hashlib.sha256(b"".join(map(table.__getitem__, order[at : at + n].tolist()))[:-1]).hexdigest() if n else "")
        at += n
    return out


Sides = tuple[Callable[[], Side], Callable[[], Side]]
SIDES: Sides = (rank_side, piece_side)
_PER_TEXT = [("n_a", "int"), ("n_b", "int"), ("n_groups", "int"), ("n_links", "int")]


def lots(docs: DataFrame, sides: Sides = SIDES, lot: int = 1 << 22) -> DataFrame:
    """A row for each document: its lot, id, counts, digest of groups, and `links`, each link as the number of its pair in the lot, of 16 bits
    or, if the lot has more pairs, 32. A lot's first row has its distinct pairs (id of A * B's vocabulary + id of B) and their links."""
    schema = pa.schema([("lot", pa.int64()), ("doc_id", pa.int64()), *((n, pa.int32()) for n, _ in _PER_TEXT), ("groups", pa.string()), ("links", pa.binary()), ("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int64()))])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ctx = TaskContext.get()
        number = (ctx.partitionId() if ctx else 0) << 40
        a, b = (side() for side in sides)
        held: list[list] = [[] for _ in range(9)]  # the first six are columns, then the parts' pairs, counts and links
        size = 0

        def whole() -> pa.RecordBatch:
            nonlocal held, size, number
            pairs, at = np.unique(np.concatenate(held[6]), return_inverse=True)
            times = np.bincount(at, np.concatenate(held[7]), len(pairs)).astype(np.int64)
            at = at.astype(_width(len(pairs)))
            ends, edges = np.cumsum([0, *map(len, held[6])]), np.cumsum([0, *held[4]])
            links = np.concatenate([at[x:y][of] for x, y, of in zip(ends[:-1], ends[1:], held[8], strict=True)])
            n = len(held[0])
            made = as_batch(schema, [number] * n, *held[:6], [links[x:y].tobytes() for x, y in zip(edges[:-1], edges[1:], strict=True)], [pairs] + [None] * (n - 1), [times] + [None] * (n - 1))
            held, size, number = [[] for _ in range(9)], 0, number + 1
            return made

        for keys, texts in rows_of(batches, 1 << 19):
            found = align(texts, a, b)
            held[0] += keys
            for column, values in zip(held[1:5], (found.n_a, found.n_b, found.per_text(found.cut), found.per_text(np.ones(len(found.cut), dtype=np.int64))), strict=True):
                column += values.tolist()
            held[5] += group_digests(found, len(a.pieces), len(b.pieces))
            pairs, at, times = np.unique(found.a[found.link_a] * len(b.pieces) + found.b[found.link_b], return_inverse=True, return_counts=True)
            held[6].append(pairs)
            held[7].append(times)
            held[8].append(at.astype(np.int32))
            size += sum(map(len, texts))
            if size >= lot:
                yield whole()
        if held[0]:
            yield whole()

    fields = "lot long, doc_id long, " + "".join(f"{n} {t}, " for n, t in _PER_TEXT) + "groups string, links binary, pairs array<long>, times array<long>"
    return arrow(id_text(docs), task, fields)


def _width(n_pairs: int) -> str:
    return "<u2" if n_pairs <= 1 << 16 else "<u4"


def _pairs(made: DataFrame) -> DataFrame:
    """(lot, place, pair, times): the distinct pairs of the lots."""
    zipped = F.arrays_zip("pairs", "times")
    return made.where("pairs is not null").select("lot", F.posexplode(zipped).alias("place", "x")).select("lot", "place", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))


def pair_counts(made: DataFrame, sides: Sides = SIDES) -> DataFrame:
    """(pair, a_id, b_id, n, best) of lots: how many links of all documents hold the pair, and whether no pair of its B id has more. A
    B id has at most as many pairs as A's vocabulary, so that is a window's bound."""
    size = len(sides[1]().pieces)
    summed = _pairs(made).groupBy("pair").agg(F.sum("times").alias("n")).withColumns({"a_id": F.floor(F.col("pair") / size).cast("int"), "b_id": (F.col("pair") % size).cast("int")})
    return summed.select("pair", "a_id", "b_id", "n", (F.col("n") == F.max("n").over(W.partitionBy("b_id"))).alias("best"))


def scored(docs: DataFrame, sides: Sides = SIDES, lot: int = 1 << 22) -> DataFrame:
    """For each document doc_id, n_a, n_b (tokens), n_groups, n_links, n_best (links whose pair is a best one), count_sum (of their pairs'
    counts) and groups_sha256."""
    work = Tables(docs.sparkSession, "alignment")
    made = work.put("lots", lots(docs, sides, lot))
    counts = work.put("counts", pair_counts(made, sides))
    told = _pairs(made).join(counts.select("pair", "n", "best"), "pair").select(F.col("lot").alias("of"), "place", "n", "best")
    schema = pa.schema([("doc_id", pa.int64()), *((n, pa.int64()) for n, _ in _PER_TEXT), ("n_best", pa.int64()), ("count_sum", pa.int64()), ("groups_sha256", pa.string())])

    def task(rows: pa.Table, told: pa.Table) -> pa.Table:
        place = told["place"].to_numpy()
        n, best = np.zeros((2, len(place)), dtype=np.int64)
        n[place], best[place] = told["n"].to_numpy(), told["best"].to_numpy()
        sums = []
        for links in rows["links"].to_pylist():
            at = np.frombuffer(links, dtype=_width(len(place)))
            sums.append((int(best[at].sum()), int(n[at].sum())))
        columns = [rows["doc_id"], *(rows[c].cast(pa.int64()) for c, _ in _PER_TEXT), *(pa.array(c, pa.int64()) for c in zip(*sums, strict=True)), rows["groups"]]
        return pa.Table.from_arrays(columns, schema=schema)

    both = made.drop("pairs", "times").groupBy("lot").cogroup(told.groupBy("of"))
    return both.applyInArrow(task, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def grouped(docs: DataFrame, sides: Sides = SIDES) -> DataFrame:
    """The alignment itself: doc_id, groups, an array of (a_ids, b_ids, start, end) in order, start and end being bytes of the text with a blank before it."""
    ids = pa.list_(pa.int32())
    kind = pa.struct([("a_ids", ids), ("b_ids", ids), ("start", pa.int64()), ("end", pa.int64())])
    schema = pa.schema([("doc_id", pa.int64()), ("groups", pa.list_(kind))])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = (side() for side in sides)
        for keys, texts in rows_of(batches, 1 << 18):
            out = []
            for text in texts:
                found = align([text], a, b)
                in_a, in_b = found.groups()
                edges_a, edges_b = (np.searchsorted(g, np.arange(int(found.cut.sum()) + 1)) for g in (in_a, in_b))
                at = np.concatenate([[0], np.cumsum(a.sizes[found.a])])[edges_a].tolist()
                of_a, of_b = found.a.tolist(), found.b.tolist()
                out.append([{"a_ids": of_a[w:x], "b_ids": of_b[y:z], "start": s, "end": e} for w, x, y, z, s, e in zip(edges_a[:-1], edges_a[1:], edges_b[:-1], edges_b[1:], at[:-1], at[1:], strict=True)])
            yield as_batch(schema, keys, out)

    return arrow(id_text(docs), task, "doc_id long, groups array<struct<a_ids:array<int>,b_ids:array<int>,start:long,end:long>>")
