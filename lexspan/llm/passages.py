"""Substring dedup by collinear chaining.

Seeds are k-mers of `k` words, one for each window of `w` k-mers (its least hash), so every run of k + w - 1 common words shares
a seed. Each seed that several documents have links to its first document (least id): one link an occurrence, never all pairs.
The links of a document to one earlier document are merged along diagonals into fragments, and fragments that follow one another
in both texts are chained, best score first, with a cost for gaps; a Fenwick tree over the other text's positions finds each
fragment's best predecessor. Chains are then aligned: words on the diagonals are compared, gaps get a longest common
subsequence, the ends are extended, and a chain is broken at its worst gap while fewer than `similarity` of its words match.
At its ends a chain goes on along its diagonal and, where words were put in or left out, along a near one.
Aligned chains of a document that touch (whatever their sources) form a passage, reported from `least` words on. A chain may be
a single seed and an alignment a few words: `least` and `piece` (words in common) hold for the passage that they form.

Words are `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased. The first document keeps its passage and is named as the source.
Cases: null and empty texts have no words; repeated equal rows count once; rows of one id with different texts are each a document of their own, as are
different texts without an id, and both come after the documents whose id is theirs alone, in order of id and then text hash (with no id last; a
passage's doc_id or source_doc_id is then null); a passage twice in one document and in no earlier one is not reported; an empty table gives no rows;
among equal chains the earliest source wins; other columns are ignored by passages() and kept by drop_passages(); texts of any length are read whole.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexspan.llm.common import Tables, arrow, as_batch, id_text, keyed, namesakes, over_columns, partitions, quoted, rows_of, spare, whole_groups

_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_MAX = np.uint64(0xFFFFFFFFFFFFFFFF)
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += np.uint64(32)
_GRID, _EXTRA = 64, 32  # word slices start and end on this grid, with so many words beside the chain at least


class Cut:
    """Which bytes stand between words: the inside of a character class of ASCII bytes."""

    def __init__(self, between: bytes):
        self.gap, self.word = re.compile(b"[" + between + b"]"), re.compile(b"[^" + between + b"]+")
        self.space = np.array([bool(self.gap.match(bytes([b]))) for b in range(256)])


BLANKS = Cut(rb"\x20\x09-\x0D")
_WORD = BLANKS.word
_LONG = 1 << 16  # longer words, in bytes, are hashed on their own


@lru_cache(1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(_P), -1, 1 << 64))
    up, down = np.full(n, _P), np.full(n, inverse)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hash_part(raw: bytes, cut: Cut = BLANKS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of raw, which ends between words, and where they start."""
    codes = np.frombuffer(raw, dtype=np.uint8)
    space = cut.space[codes]
    before = np.concatenate([[True], space[:-1]])
    start, end = np.flatnonzero(~space & before), np.flatnonzero(space & ~before)
    up, down = _powers(1 << max(19, len(raw).bit_length()))
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(_LOWER[codes] * up[: len(codes)])])
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64)), start


def _stretches(raw: bytes, part: int, cut: Cut) -> Iterator[bytes | int]:
    """raw in stretches of about `part` bytes, cut between words, and the hashes of words over _LONG bytes."""
    at = 0
    if len(raw) > _LONG:
        for m in cut.word.finditer(raw):
            if m.end() - m.start() > _LONG:
                yield from _stretches_of(raw, at, m.start(), part, cut)
                yield xxhash.xxh64_intdigest(m[0].lower())
                at = m.end()
    yield from _stretches_of(raw, at, len(raw), part, cut)


def _stretches_of(raw: bytes, at: int, end: int, part: int, cut: Cut) -> Iterator[bytes]:
    while at < end:
        stop = min(end, at + part)
        gap = cut.gap.search(raw, stop, end) if stop < end else None
        stop = gap.end() if gap else end if stop < end else stop
        yield raw[at:stop] + b"\n"
        at = stop


def hash_words(texts: list[str], part: int = 1 << 18, cut: Cut = BLANKS) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes, the number of the text that each is in), in order. Works on parts of about `part` bytes."""
    hashes, owners, parts, ends, size = [], [], [], [], 0

    def flush() -> None:
        nonlocal parts, ends, size
        if parts:
            h, at = _hash_part(b"".join(parts), cut)
            hashes.append(h)
            owners.append(np.array([x for x, _ in ends])[np.searchsorted(np.array([x for _, x in ends]), at, side="right")])
        parts, ends, size = [], [], 0

    for i, text in enumerate(texts):
        for found in _stretches(text.encode(), part, cut):
            if isinstance(found, int):
                flush()
                hashes.append(np.array([found], dtype=np.uint64))
                owners.append(np.array([i]))
                continue
            parts.append(found)
            size += len(found)
            ends.append((i, size))
            if size >= part:
                flush()
    flush()
    if not hashes:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    return np.concatenate(hashes), np.concatenate(owners)


def seeds_of(hashes: np.ndarray, owner: np.ndarray, k: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first word, hash) of the k-mers chosen."""
    n = len(hashes) - k + 1
    none = np.zeros(0, dtype=np.int64)
    if n <= 0:
        return none, none
    mixed = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        mixed = mixed * _Q + hashes[j : j + n]
    mixed = mix(mixed)
    own = owner[:n]
    valid = own == owner[k - 1 :]
    mixed = np.where(valid, mixed >> np.uint64(1), _MAX)
    least, at = mixed.copy(), np.arange(n)
    for j in range(1, min(w, n)):
        better = (own[j:] == own[:-j]) & (mixed[j:] < least[:-j])
        least[:-j][better] = mixed[j:][better]
        at[:-j][better] = np.flatnonzero(better) + j
    full = np.zeros(n, dtype=bool)
    if n >= w:
        full[: n - w + 1] = valid[w - 1 :] & (own[w - 1 :] == own[: n - w + 1])
    first = np.concatenate([[True], own[1:] != own[:-1]])
    at = np.unique(at[valid & (full | first)])
    found = mixed[at]
    # in a run that repeats itself the same seed follows itself; its place in the run tells them apart, so runs align
    again = np.concatenate([[False], (found[1:] == found[:-1]) & (own[at[1:]] == own[at[:-1]]) & (np.diff(at) <= w)])
    index = np.arange(len(at))
    place = (index - np.maximum.accumulate(np.where(again, 0, index))).astype(np.uint64)
    found = np.where(place > 0, mix(found + place * _Q) >> np.uint64(1), found)
    return at, found.astype(np.int64)


def seeds(docs: DataFrame, k: int, w: int) -> DataFrame:
    """(h, doc_id, pos)."""
    schema = pa.schema([("h", pa.int64()), ("doc_id", pa.int64()), ("pos", pa.int32())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in rows_of(batches):
            hashes, owner = hash_words(texts)
            at, h = seeds_of(hashes, owner, k, w)
            begin = np.searchsorted(owner, np.arange(len(texts)))
            yield as_batch(schema, h, np.array(keys, dtype=np.int64)[owner[at]], (at - begin[owner[at]]).astype(np.int32))

    return arrow(id_text(docs), task, "h long, doc_id long, pos int")


class FenwickMax:
    """Greatest (value, item) over a prefix of positions."""

    def __init__(self, n: int):
        self.best: list[tuple[float, int]] = [(-1e300, -1)] * (n + 1)

    def put(self, at: int, value: tuple[float, int]) -> None:
        best, at = self.best, at + 1
        while at < len(best):
            if value > best[at]:
                best[at] = value
            at += at & -at

    def upto(self, n: int) -> tuple[float, int]:
        """Over positions 0 to n - 1."""
        found, best = (-1e300, -1), self.best
        while n > 0:
            if best[n] > found:
                found = best[n]
            n &= n - 1
        return found


def chain(fragments: list[tuple[int, int, int]], k: int, cost: float = 0.05) -> list[list[tuple[int, int, int]]]:
    """Chains of fragments (first and last seed in a, first seed in b), ordered by a. Fragments follow one another if their seeds
    do in both texts; a gap costs `cost` a word in either text. Chains come best first and share no fragment."""
    n = len(fragments)
    ends_b = sorted({b + a1 - a0 for a0, a1, b in fragments})
    tree = FenwickMax(len(ends_b))
    by_end = sorted(range(n), key=lambda i: fragments[i][1])
    score, back, done = [0.0] * n, [-1] * n, 0
    for i in sorted(range(n), key=lambda i: fragments[i][0]):
        a0, a1, b0 = fragments[i]
        while done < n and fragments[by_end[done]][1] < a0:
            j = by_end[done]
            c0, c1, d0 = fragments[j]
            tree.put(bisect_left(ends_b, d0 + c1 - c0), (score[j] + cost * (c1 + d0 + c1 - c0), j))
            done += 1
        value, j = tree.upto(bisect_left(ends_b, b0))
        gain = value - cost * (a0 + b0)
        score[i] = a1 - a0 + k + max(0.0, gain)
        back[i] = j if gain > 0 else -1
    used, out = [False] * n, []
    for i in sorted(range(n), key=lambda i: (-score[i], fragments[i])):
        found = []
        while i >= 0 and not used[i]:
            used[i] = True
            found.append(fragments[i])
            i = back[i]
        if found:
            out.append(found[::-1])
    return out


def chains(links: DataFrame, k: int, reach: int = 40) -> DataFrame:
    """Chains of links(doc_id, source, pos, at): (doc_id, source, s, e, fs, fe, parts), parts being its fragments in threes."""
    schema = pa.schema([("doc_id", pa.int64()), ("source", pa.int64()), ("s", pa.int32()), ("e", pa.int32()), ("fs", pa.int32()), ("fe", pa.int32()), ("parts", pa.list_(pa.int32()))])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc, source, pos, at in whole_groups(batches, 2):
            n, pos, at = len(doc), pos.astype(np.int64), at.astype(np.int64)
            pair = np.concatenate([[True], (doc[1:] != doc[:-1]) | (source[1:] != source[:-1])])
            cut = pair.copy()
            cut[1:] |= (np.diff(pos) != np.diff(at)) | (np.diff(pos) > reach)
            first = np.flatnonzero(cut)
            last = np.append(first[1:], n) - 1
            of = np.cumsum(pair)[first]
            edges = np.append(np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])), len(first))
            a0, a1, b0 = pos[first].tolist(), pos[last].tolist(), at[first].tolist()
            docs, sources = doc[first].tolist(), source[first].tolist()
            out: list[list] = [[] for _ in schema]
            for x, y in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                found = [[(a0[x], a1[x], b0[x])]] if y == x + 1 else chain(sorted({(a0[i], a1[i], b0[i]) for i in range(x, y)}), k)
                for c in found:
                    for column, value in zip(out, (docs[x], sources[x], c[0][0], c[-1][1] + k, c[0][2], c[-1][2] + c[-1][1] - c[-1][0] + k, [v for f in c for v in f]), strict=True):
                        column.append(value)
            yield as_batch(schema, *out)

    dealt = links.select("doc_id", "source", "pos", "at").repartition(partitions(links.sparkSession), "doc_id").sortWithinPartitions("doc_id", "source", "pos", "at")
    return arrow(dealt, task, "doc_id long, source long, s int, e int, fs int, fe int, parts array<int>")


def common_words(a: list, b: list) -> int:
    """Length of the longest common subsequence, a word of b at a time in bits."""
    if not a or not b:
        return 0
    masks: dict = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | 1 << i
    whole = (1 << len(a)) - 1
    v = whole
    for y in b:
        u = v & masks.get(y, 0)
        v = ((v + u) | (v - u)) & whole
    return len(a) - v.bit_count()


def _along(same: np.ndarray) -> int:
    """How far to go along a diagonal: a match earns 1, a mismatch costs 2; stops 6 below the best."""
    if not len(same):
        return 0
    score = np.cumsum(np.where(same, 1, -2))
    top = np.maximum.accumulate(np.maximum(score, 0))
    low = np.flatnonzero(top - score > 6)
    score = score[: low[0]] if len(low) else score
    best = int(np.argmax(score)) if len(score) else 0
    return best + 1 if len(score) and score[best] > 0 else 0


def _pieces(alike: np.ndarray, apart: int = 3) -> Iterator[tuple[int, int, int]]:
    """(from, to, words in common) of the pieces of a diagonal between which `apart` words or more in a row differ."""
    at = np.flatnonzero(alike)
    if len(at):
        ends = np.flatnonzero(np.diff(at) > apart)
        for x, y in zip(np.concatenate([[0], ends + 1]).tolist(), np.concatenate([ends, [len(at) - 1]]).tolist(), strict=True):
            yield int(at[x]), int(at[y]) + 1, y - x + 1


#: Words left out of a and of b to go on along another diagonal, fewest first, and how many words have to be alike there.
_SKIPS, _AGAIN = sorted(((x, y) for x in range(4) for y in range(4) if x + y), key=lambda s: (max(s), sum(s), s)), 4


def _extend(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """How far a and b go on together from their start, and their words in common. Where the diagonal ends, up to three words of each
    are left out if _AGAIN words follow that are alike."""
    i = j = same = 0
    while True:
        n = min(len(a) - i, len(b) - j)
        alike = a[i : i + n] == b[j : j + n]
        run = _along(alike)
        i, j, same = i + run, j + run, same + int(alike[:run].sum())
        x, y = a[i : i + 3 + _AGAIN].tolist(), b[j : j + 3 + _AGAIN].tolist()
        skip = next(((p, q) for p, q in _SKIPS if x[p : p + _AGAIN] == y[q : q + _AGAIN] and len(x) >= p + _AGAIN), None)
        if skip is None:
            return i, j, same
        i, j = i + skip[0], j + skip[1]


def align(a: np.ndarray, b: np.ndarray, parts: list[tuple[int, int, int]], k: int, similarity: float, gap: int = 512) -> list[tuple[int, int, int, int, int]]:
    """(s, e, fs, fe, words in common) of the alignments of a chain over the words a and b. A gap over `gap` words breaks it."""
    blocks: list[list[int]] = []  # a from, a to, b from, in common
    for a0, a1, b0 in parts:
        if blocks:
            skip = max(0, blocks[-1][1] - a0, blocks[-1][2] + blocks[-1][1] - blocks[-1][0] - b0)
            a0, b0 = a0 + skip, b0 + skip
        end = min(a1 + k, len(a), len(b) - b0 + a0)
        for x, y, same in _pieces(a[a0:end] == b[b0 : b0 + end - a0]):
            blocks.append([a0 + x, a0 + y, b0 + x, same])
    if not blocks:
        return []
    between = []
    for x, y in zip(blocks, blocks[1:], strict=False):
        ga, gb = a[x[1] : y[0]], b[x[2] + x[1] - x[0] : y[2]]
        same = common_words(ga.tolist(), gb.tolist()) if max(len(ga), len(gb)) <= gap else 0
        between.append((max(len(ga), len(gb)), same))
    out, todo = [], [(0, len(blocks))]
    while todo:
        x, y = todo.pop()
        first, last = blocks[x], blocks[y - 1]
        fe = last[2] + last[1] - last[0]
        left_a, left_b, left = _extend(a[: first[0]][::-1], b[: first[2]][::-1])
        right_a, right_b, right = _extend(a[last[1] :], b[fe:])
        s, e, fs, fe = first[0] - left_a, last[1] + right_a, first[2] - left_b, fe + right_b
        same = left + right + sum(z[3] for z in blocks[x:y]) + sum(z for _, z in between[x : y - 1])
        if same >= similarity * max(e - s, fe - fs):
            out.append((s, e, fs, fe, same))
        elif y > x + 1:
            worst = max(range(x, y - 1), key=lambda i: between[i][0] - between[i][1])
            todo += [(x, worst + 1), (worst + 1, y)]
    return out


def _slices(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """The low 32 bits of the word hashes that asked(doc_id, asks, spans) names: a row with its chain for each ask, and a row without a
    source for each span."""
    names = ["source", "qs", "qe", "fqs", "fqe", "parts"]
    schema = pa.schema([("doc_id", pa.int64()), ("source", pa.int64()), *((x, pa.int32()) for x in names[1:-1]), ("parts", pa.list_(pa.int32())), ("words", pa.binary())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, int(batch.num_rows * (1 << 21) / max(1, batch.nbytes)))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                keys, texts, asks, spans = (c.to_pylist() for c in part.columns)
                hashes, owner = hash_words(texts)
                words = hashes.astype("<u4")
                begin = np.searchsorted(owner, np.arange(len(texts) + 1))
                rows = ((key, *map(x.get, names), words[begin[i] : begin[i + 1]][x["qs"] : x["qe"]].tobytes()) for i, (key, *of) in enumerate(zip(keys, asks, spans, strict=True)) for x in (*of[0], *of[1]))
                while some := list(islice(rows, 2048)):
                    yield as_batch(schema, *zip(*some, strict=True))

    joined = id_text(docs).join(asked.hint("merge"), "doc_id").select("doc_id", "text", "asks", "spans")
    return arrow(joined, task, "doc_id long, source long, qs int, qe int, fqs int, fqe int, parts array<int>, words binary")


def _aligned(rows: DataFrame, k: int, similarity: float) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("source", pa.int64()), *((x, pa.int64()) for x in ("s", "e", "fs", "fe", "same"))])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                out: list[tuple] = []
                for doc, source, qs, fqs, parts, a, b in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns), strict=True):
                    fragments = [(parts[i] - qs, parts[i + 1] - qs, parts[i + 2] - fqs) for i in range(0, len(parts), 3)]
                    for s, e, fs, fe, same in align(np.frombuffer(a, dtype="<u4"), np.frombuffer(b, dtype="<u4"), fragments, k, similarity):
                        out.append((doc, source, s + qs, e + qs, fs + fqs, fe + fqs, same))
                yield as_batch(schema, *(zip(*out, strict=True) if out else [[]] * 7))

    return arrow(rows, task, "doc_id long, source long, s long, e long, fs long, fe long, same long")


def passages(docs: DataFrame, least: int = 50, similarity: float = 0.8, k: int = 5, w: int = 5, piece: int = 20, touch: int = 3) -> DataFrame:
    """One row for each passage that an earlier document has: doc_id, start_word, end_word (exclusive), n_words, source_doc_id
    (of its longest chain) with source_start and source_end, n_sources, similarity."""
    work = Tables(docs.sparkSession, "passages")
    twins = namesakes(docs, work)
    rows = keyed(docs.select("doc_id", "text"), twins).select(F.col("key").alias("doc_id"), "text")
    found = _passages(rows, work, least, similarity, k, w, piece, touch)
    for name in ("doc_id", "source_doc_id") if twins is not None else ():
        of = twins.select(F.col("key").alias(name), F.struct("twin_id").alias("twin"))
        found = found.join(of, name, "left").withColumn(name, F.when(F.col("twin").isNull(), F.col(name)).otherwise(F.col("twin.twin_id"))).drop("twin")
    return found.select(*_COLUMNS)


_COLUMNS = ["doc_id", "start_word", "end_word", "n_words", "source_doc_id", "source_start", "source_end", "n_sources", "similarity"]


def _passages(docs: DataFrame, work: Tables, least: int, similarity: float, k: int, w: int, piece: int, touch: int) -> DataFrame:
    """passages() where each text has an id of its own."""
    found = work.put("seeds", seeds(docs, k, w))
    shared = work.put("shared", found.groupBy("h").agg(F.min("doc_id").alias("source"), F.max("doc_id").alias("last")).where("source < last").select("h", "source"))
    # the joins are merge joins at every size, so a plan does not change as tables grow
    met = work.put("met", found.join(shared.hint("merge"), "h"))
    work.drop("seeds", "shared")
    first = work.put("first", met.where("doc_id = source").groupBy("h").agg(F.min("pos").alias("at")))
    chained = work.put("chains", chains(met.where("doc_id > source").join(first.hint("merge"), "h"), k))
    work.drop("met", "first")
    grid = lambda s, e: ((F.greatest(F.lit(0), F.col(s) - _EXTRA) / _GRID).cast("int") * _GRID, ((F.col(e) + _EXTRA) / _GRID + 1).cast("int") * _GRID)
    qs, qe = grid("s", "e")
    fqs, fqe = grid("fs", "fe")
    chained = chained.withColumns({"qs": qs, "qe": qe, "fqs": fqs, "fqe": fqe})
    ask, span = F.struct("source", "qs", "qe", "fqs", "fqe", "parts"), F.struct(F.col("fqs").alias("qs"), F.col("fqe").alias("qe"))
    asks = chained.select("doc_id", ask.alias("ask")).unionByName(chained.select(F.col("source").alias("doc_id"), span.alias("span")), allowMissingColumns=True)
    asked = work.put("asked", asks.groupBy("doc_id").agg(F.collect_list("ask").alias("asks"), F.collect_set("span").alias("spans")))
    work.drop("chains")
    # an ask carries its document's words, so only the source's are joined
    slices = work.put("slices", _slices(docs, asked))
    work.drop("asked")
    there = slices.where("source is null").select(F.col("doc_id").alias("source"), F.col("qs").alias("fqs"), F.col("qe").alias("fqe"), F.col("words").alias("b"))
    both = slices.where("source is not null").join(there.hint("merge"), ["source", "fqs", "fqe"]).select("doc_id", "source", "qs", "fqs", "parts", F.col("words").alias("a"), "b")
    aligned = work.put("aligned", _aligned(both, k, similarity))
    work.drop("slices")
    order = W.partitionBy("doc_id").orderBy("s", "e", "source")
    islands = (
        aligned.distinct()
        .withColumn("reached", F.max("e").over(order.rowsBetween(W.unboundedPreceding, -1)))
        .withColumn("island", F.sum(F.when(F.col("s") <= F.col("reached") + touch, 0).otherwise(1)).over(order))
    )
    best = F.max_by(F.struct("source", "fs", "fe"), F.struct("same", -F.col("source"), -F.col("fs"), -F.col("s")))
    return (
        islands.groupBy("doc_id", "island")
        .agg(F.min("s").alias("start_word"), F.max("e").alias("end_word"), best.alias("best"), F.count_distinct("source").alias("n_sources"), (F.sum("same") / F.sum(F.greatest(F.col("e") - F.col("s"), F.col("fe") - F.col("fs")))).alias("similarity"), F.sum("same").alias("same"))
        .where((F.col("end_word") - F.col("start_word") >= least) & (F.col("same") >= piece))
        .select("doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), F.col("best.source").alias("source_doc_id"), F.col("best.fs").alias("source_start"), F.col("best.fe").alias("source_end"), "n_sources", "similarity")
    )


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans and the white space after each."""
    raw = text.encode()
    at = [m.start() for m in _WORD.finditer(raw)] + [len(raw)]
    out, done = [], 0
    for s, e in sorted(spans):
        s, e = min(s, len(at) - 1), min(e, len(at) - 1)
        if at[s] > done:
            out.append(raw[done : at[s]])
        done = max(done, at[e])
    return b"".join([*out, raw[done:]]).decode()


def drop_passages(docs: DataFrame, **how) -> DataFrame:
    """The documents without their passages; those left without words go. n_chars, if there, is counted anew."""
    work = Tables(docs.sparkSession, "passages-drop")
    twins, names = namesakes(docs, work), docs.columns
    key, extra = spare(names, "key"), spare(names, "spans")
    how = {"least": 50, "similarity": 0.8, "k": 5, "w": 5, "piece": 20, "touch": 3} | how
    rows = keyed(docs, twins, key)
    found = _passages(rows.select(F.col(key).alias("doc_id"), "text"), work, **how)
    spans = work.put("spans", found.groupBy(F.col("doc_id").alias(key)).agg(F.collect_list(F.struct("start_word", "end_word")).alias(extra)))
    joined = rows.join(spans, key, "left").select(*map(quoted, names), extra)
    text, count = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = batch.column(len(names)).to_pylist()
            hit = [i for i, x in enumerate(of) if x]
            columns = batch.columns[: len(names)]
            if hit:
                texts = columns[text].to_pylist()
                for i in hit:
                    texts[i] = without(texts[i] or "", [(x["start_word"], x["end_word"]) for x in of[i]])
                columns[text] = pa.array(texts, type=columns[text].type)
                if count is not None:
                    counts = columns[count].to_pylist()
                    for i in hit:
                        counts[i] = len(texts[i])
                    columns[count] = pa.array(counts, type=columns[count].type)
                keep = pa.array([not x or bool(t.strip(" \t\n\x0b\x0c\r")) for x, t in zip(of, texts, strict=True)])
                columns = [c.filter(keep) for c in columns]
            yield pa.RecordBatch.from_arrays(columns, names=[f"c{i}" for i in range(len(names))])

    return over_columns(joined, task, 1)
