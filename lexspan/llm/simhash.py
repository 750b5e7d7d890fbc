"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints: one bit for each of 64 positions, set if over half of the document's shingle hashes (XXH64, seed 42) have it.
Documents link where fingerprints differ in `radius` bits or fewer; components of links are the groups.

Search: equal fingerprints are one class first. Cut into `cuts` parts, two fingerprints within the radius agree in
`cuts - radius` parts at least, so each class goes to one bucket for every choice of so many parts: no link is missed. A bucket
over `most` classes is split into pairs of slices, so no task holds an unbounded bucket. In a bucket the bits are stored as
planes, 64 rows to a word; distances of many rows are updated plane by plane in carry-save counters that saturate above the
radius, and a block is abandoned once all its rows exceed it. A bucket gives a spanning tree of what it links, never all pairs.
Components come from minimum labels with pointer jumping over written tables.

Cases: a null text is the empty one; texts without words have fingerprint zero and link like any other; a null doc_id belongs
to the group of its fingerprint if a document with an id has that fingerprint, else to none (null); repeated rows each give a row; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspan.llm.common import Tables, arrow, as_batch, id_text, keyed, namesakes, partitions, quoted, rows_of, spare, whole_groups

_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str, words: int = 4) -> int:
    import xxhash

    parts = text.encode().lower().split()
    if not parts:
        return 0
    n = max(1, len(parts) - words + 1)
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_digest
    from_, to = starts[:n].tolist(), ends[min(words, len(parts)) - 1 :].tolist()
    count = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 1 << 15):
        raw = b"".join([digest(joined[a:b], 42) for a, b in zip(from_[at : at + (1 << 15)], to[at : at + (1 << 15)], strict=False)])
        count += np.unpackbits(np.frombuffer(raw, dtype=np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * count > n).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """(doc_id, h, fp): h is the text's XXH64 as Spark computes it, fp the fingerprint as a signed long."""
    schema = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("fp", pa.int64())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for keys, texts in rows_of([batch]):
                yield as_batch(schema, keys, batch.column(2).slice(at, len(keys)), np.array([fingerprint(x, words) for x in texts], dtype=np.uint64).astype(np.int64))
                at += len(keys)

    return arrow(id_text(docs).withColumn("h", F.xxhash64("text")), task, "doc_id long, h long, fp long")


def planes_of(fps: np.ndarray) -> np.ndarray:
    """The vertical form: row b has bit b of all fingerprints, 64 to a word (the first in the lowest bit)."""
    n = len(fps)
    wide = np.zeros(-(-n // 64) * 64, dtype=np.uint64)
    wide[:n] = fps
    bits = np.unpackbits(wide.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)


class Counters:
    """Saturating carry-save counters of differing bits, one for each lane: `bits` planes that hold up to `radius`."""

    def __init__(self, shape: tuple, radius: int):
        self.radius = radius
        self.planes = [np.zeros(shape, dtype=np.uint64) for _ in range((radius + 1).bit_length())]
        self.over = np.zeros(shape, dtype=np.uint64)

    def add(self, x: np.ndarray) -> None:
        carry = x
        for p in self.planes:
            carry, p[...] = p & carry, p ^ carry
        self.over |= carry

    def add3(self, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> None:
        """Three bits at once: a full adder makes a sum of weight one and a carry of weight two."""
        half = a ^ b
        self.add(half ^ c)
        carry = (a & b) | (half & c)
        for p in self.planes[1:]:
            carry, p[...] = p & carry, p ^ carry
        self.over |= carry

    def within(self) -> np.ndarray:
        """Lanes whose count is `radius` or less."""
        more, same = self.over.copy(), ~self.over
        for i in range(len(self.planes) - 1, -1, -1):
            p = self.planes[i]
            if self.radius >> i & 1:
                same &= p
            else:
                more |= same & p
                same &= ~p
        return ~more


def near(queries: np.ndarray, planes: np.ndarray, radius: int) -> np.ndarray:
    """For each query a row of words: the lanes of `planes` within the radius. Blocks of lanes that all exceed it are abandoned."""
    out = np.zeros((len(queries), planes.shape[1]), dtype=np.uint64)
    live = np.arange(planes.shape[1])
    counters = Counters(out.shape, radius)
    flips = [np.where(queries >> np.uint64(b) & np.uint64(1), _FULL, np.uint64(0))[:, None] for b in range(64)]
    for b in range(0, 64, 3):
        x = [planes[i][live][None, :] ^ flips[i] for i in range(b, min(b + 3, 64))]
        if len(x) == 3:
            counters.add3(*x)
        else:
            for one in x:
                counters.add(one)
        if b % 12 == 9 and b < 60:
            keep = counters.within().any(axis=0)
            if not keep.all():
                live = live[keep]
                if not len(live):
                    return out
                counters.planes = [p[:, keep] for p in counters.planes]
                counters.over = counters.over[:, keep]
    out[:, live] = counters.within()
    return out


def shifted_pairs(fps: np.ndarray, group: np.ndarray, radius: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) within the radius, i < j, in the same group; rows are ordered by group, groups have up to `most` rows."""
    a, b = [], []
    index = np.arange(len(fps))
    for d in range(1, most):
        index = index[index + d < len(fps)]
        index = index[group[index] == group[index + d]]
        if not len(index):
            break
        for at in range(0, len(index), 1 << 16):
            i = index[at : at + (1 << 16)]
            x = planes_of(fps[i] ^ fps[i + d])
            counters, live = Counters((x.shape[1],), radius), np.arange(x.shape[1])
            for k in range(0, 63, 3):
                counters.add3(x[k][live], x[k + 1][live], x[k + 2][live])
                if k in (21, 33, 45):
                    keep = counters.within() != 0
                    live = live[keep]
                    counters.planes = [p[keep] for p in counters.planes]
                    counters.over = counters.over[keep]
                    if not len(live):
                        break
            if len(live):
                counters.add(x[63][live])
                words = np.zeros(x.shape[1], dtype=np.uint64)
                words[live] = counters.within()
                ok = i[np.unpackbits(words.view(np.uint8), bitorder="little")[: len(i)].astype(bool)]
                a.append(ok)
                b.append(ok + d)
    none = np.zeros(0, dtype=np.int64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


class Forest:
    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (p := up.setdefault(x, x)) != x:
            up[x] = up[p]
            x = p
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def edges(self) -> tuple[list[int], list[int]]:
        """A tree over each set in which no node has over three neighbours and paths are short."""
        sets: dict[int, list[int]] = {}
        for x in self.up:
            sets.setdefault(self.root(x), []).append(x)
        a, b = [], []
        for xs in sets.values():
            xs.sort()
            a += [xs[(i - 1) // 2] for i in range(1, len(xs))]
            b += xs[1:]
        return a, b


def links_of(fps: np.ndarray, nodes: np.ndarray, starts: np.ndarray, radius: int, small: int = 48) -> tuple[list[int], list[int]]:
    """Tree edges between nodes for buckets that begin at `starts`; rows of a bucket are adjacent."""
    ends = np.append(starts[1:], len(fps))
    size = ends - starts
    a: list[int] = []
    b: list[int] = []
    few = (size > 1) & (size <= small)
    if few.any():
        rows = np.repeat(few, size)
        group = np.repeat(np.arange(len(size)), size)[rows]
        f, n = fps[rows], nodes[rows]
        i, j = shifted_pairs(f, group, radius, int(size[few].max()))
        forest = Forest()
        for x, y in zip(n[i].tolist(), n[j].tolist(), strict=True):
            forest.join(x, y)
        x, y = forest.edges()
        a += x
        b += y
    for k in np.flatnonzero(size > small).tolist():
        f, n = fps[starts[k] : ends[k]], nodes[starts[k] : ends[k]]
        f, at = np.unique(f, return_index=True)
        n = n[at]
        planes, count = planes_of(f), len(f)
        label = np.arange(count)
        step = max(16, min(512, (1 << 18) // max(1, planes.shape[1])))
        for q in range(0, count, step):
            found = np.unpackbits(near(f[q : q + step], planes, radius).view(np.uint8), axis=1, bitorder="little")[:, :count].astype(bool)
            for r in np.flatnonzero(found.sum(axis=1) > 1).tolist():
                met = np.unique(label[found[r]])
                if len(met) > 1:
                    label[np.isin(label, met)] = met[0]
        order = np.lexsort((n, label))
        rank = np.arange(count) - np.searchsorted(label[order], label[order])
        later = np.flatnonzero(rank > 0)  # the k-th of a set hangs on its (k - 1) // 2-th
        b += n[order[later]].tolist()
        a += n[order[later - rank[later] + (rank[later] - 1) // 2]].tolist()
    return a, b


def near_links(classes: DataFrame, work: Tables, radius: int = 4, cuts: int = 6, most: int = 4096) -> DataFrame:
    """(a, b): tree edges between the nodes of classes(fp, node) whose fingerprints are within the radius; all components are whole."""
    ends = [64 * i // cuts for i in range(cuts + 1)]
    part = [F.shiftrightunsigned("fp", ends[i]).bitwiseAND((1 << (ends[i + 1] - ends[i])) - 1) for i in range(cuts)]
    keys = [F.xxhash64(F.lit(n), *(part[i] for i in chosen)) for n, chosen in enumerate(combinations(range(cuts), cuts - radius))]
    # a 64-bit hash of the parts: two buckets that collide are compared together, which loses nothing
    rows = classes.select("fp", "node", F.explode(F.array(*keys)).alias("key"))
    hot = work.put("hot", rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("key", F.ceil(F.col("n") / most).cast("int").alias("slices")))
    own = F.pmod(F.xxhash64("node"), F.col("slices"))
    paired = rows.join(hot, "key", "left").select(
        "fp",
        "node",
        F.when(F.col("slices").isNull(), F.array("key"))
        .otherwise(F.transform(F.sequence(F.lit(0), F.coalesce("slices", F.lit(1)) - 1), lambda x: F.xxhash64("key", F.least(x, own), F.greatest(x, own))))
        .alias("buckets"),
    )
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, fp, node in whole_groups(batches):
            starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            yield as_batch(schema, *links_of(fp.view(np.uint64), node, starts, radius))

    dealt = paired.select(F.explode("buckets").alias("bucket"), "fp", "node").repartition(partitions(work.spark), "bucket").sortWithinPartitions("bucket")
    found = arrow(dealt, task, "a long, b long")
    return found.distinct()


def components(edges: DataFrame, work: Tables) -> DataFrame:
    """(node, label): for each node of edges(a, b) the smallest node that it reaches. Labels take the least over neighbours and
    then jump to the label of their label, until none changes; each round is a written table."""
    both = work.put("both", edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = work.put("labels0", both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("label")))
    turn = 0
    while True:
        turn += 1
        seen = labels.select(F.col("node").alias("b"), F.col("label").alias("other"))
        # each neighbour offers its label to the node and, by way of the node, to the node that labels it
        offers = both.join(seen, "b").join(labels.withColumnRenamed("node", "a"), "a").select(F.explode(F.array(F.struct(F.col("a").alias("node"), "other"), F.struct(F.col("label").alias("node"), "other"))).alias("x"))
        least = work.put(f"least{turn}", offers.select("x.node", "x.other").groupBy("node").agg(F.min("other").alias("other")))
        hooked = work.put(f"hooked{turn}", labels.join(least, "node").select("node", "label", F.least("label", "other").alias("next")))
        jump = hooked.select(F.col("node").alias("next"), F.col("next").alias("far"))
        now = work.put(f"labels{turn}", hooked.join(jump, "next").select("node", F.least("next", "far").alias("label"), (F.least("next", "far") != F.col("label")).alias("changed")))
        changed = not now.where("changed").isEmpty()
        work.drop(f"labels{turn - 1}", f"least{turn}", f"hooked{turn}")
        labels = now.select("node", "label")
        if not changed:
            return labels


def grouped(docs: DataFrame, work: Tables, radius: int, words: int) -> DataFrame:
    """(doc_id, h, fp, component_id) for each row of docs."""
    prints = work.put("prints", fingerprints(docs, words))
    classes = work.put("classes", prints.groupBy("fp").agg(F.min("doc_id").alias("node")))
    edges = work.put("edges", near_links(classes.where("node is not null"), work, radius))
    labels = components(edges, work)
    named = work.put("named", classes.join(labels, "node", "left").select("fp", F.coalesce("label", "node").alias("component_id")))
    return prints.join(named, "fp")


def groups(docs: DataFrame, radius: int = 4, words: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of docs."""
    return grouped(docs, Tables(docs.sparkSession, "simhash"), radius, words).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, radius: int = 4, words: int = 4) -> DataFrame:
    """Of each group one row stays: that of smallest id; of equal rows, any. Texts that share an id with another text come after the documents whose
    id is theirs alone, by id and text hash, and texts without an id come last."""
    work = Tables(docs.sparkSession, "simhash-drop")
    key = spare(docs.columns, "key")
    rows = keyed(docs, namesakes(docs, work), key)
    found = grouped(rows.select(F.col(key).alias("doc_id"), "text"), work, radius, words).groupBy("doc_id").agg(F.min("component_id").alias("first"), F.count(F.lit(1)).alias("n"))
    named = work.put("rows", found.withColumnRenamed("doc_id", key))
    # a merge join at every size, so that the plan does not change as tables grow
    left = rows.join(named.where(F.col(key) > F.col("first")).select(key).hint("merge"), key, "left_anti")
    repeated = work.put("repeated", named.where((F.col(key) == F.col("first")) & (F.col("n") > 1)).select(key))
    if not repeated.isEmpty():
        left = left.join(repeated, key, "left_anti").unionByName(rows.join(repeated, key).dropDuplicates([key]).select(*map(quoted, rows.columns)))
    return left.select(*map(quoted, docs.columns))
