"""Approximate nearest neighbours by multi-index hashing.

Codes are learned: on a bounded sample the vectors are centred and rotations are fitted that bring them close to their signs
(iterative quantisation). The first `keyed` rotations give the index code, all of them the whole code. The index code is split
into substrings of 8 bits, each indexed: a posting (substring number, value) → id and code. By the pigeonhole principle an index code within Hamming
radius r of the query has some substring within r // m bits of the query's (r // m - 1 for all but r % m + 1 of the m substrings), so probing
those values retrieves every code within r. A pair that several substrings retrieve is taken at the first of them. Candidates are
checked by their index distance, then by that of the whole code, and those left are reranked by cosine of the original vectors in double precision.

Both radii are learned: a fixed number of sampled vectors is compared with all rows in one pass, and the radii hold `reach` per cent of their exact
neighbours. Queries that have fewer than k candidates are compared with all rows, by the same probing at the full radius.

Postings and queries are dealt by substring number and the value's leading bits, and meet where these are equal; a posting goes to one place for each
substring, a query to those whose values it probes, whatever the size of the table. The number of leading bits grows with the table, so a
place stays small; one that many like vectors make large is cut into slices, each met by the queries. Vectors move only for the pairs left to rerank.

Cases: vectors that are null, empty, zero, hold a null or non-finite component or have another dimension than most of the sample, and rows
without an id, take no part; rows that repeat an id count once, by their best score, and a query never finds its own id; ties go
to the smaller vec_id; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexspan.llm.common import Tables, arrow, as_batch, partitions

_CODES = pa.schema([("vec_id", pa.int64()), ("code", pa.binary())])
_DEALT = pa.schema([("part", pa.int32()), ("lead", pa.int32()), ("side", pa.int32()), ("vec_id", pa.int64()), ("code", pa.binary())])
_PAIRS = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64())])
_SCORED = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
_BALL = np.bitwise_count(np.arange(256, dtype=np.uint8)[:, None] ^ np.arange(256, dtype=np.uint8)[None, :])


def _packed(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as rows of bytes, whole 64-bit words."""
    return np.packbits(np.pad(bits, ((0, 0), (0, -bits.shape[1] % 64))), axis=1)


@dataclass(frozen=True)
class Coder:
    mean: np.ndarray
    rotations: np.ndarray  # stacked
    keyed: int = 2  # rotations of the index code

    @property
    def parts(self) -> int:
        """Substrings of the index code, a byte each."""
        return -(-self.keyed * self.mean.size // 8)

    @property
    def words(self) -> int:
        """64-bit words of the index code; the others follow."""
        return -(-self.keyed * self.mean.size // 64)

    def codes(self, vectors: np.ndarray) -> np.ndarray:
        """One row of bytes a vector."""
        bits = (unit(vectors) - self.mean) @ self.rotations.reshape(-1, self.mean.size).T > 0
        n = self.keyed * self.mean.size
        return np.ascontiguousarray(np.hstack([_packed(bits[:, :n]), _packed(bits[:, n:])]))


def unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of rows, in double precision; scaled first, so that great and small numbers neither overflow nor vanish."""
    a = a / np.abs(a).max(axis=-1, keepdims=True)
    b = b / np.abs(b).max(axis=-1, keepdims=True)
    return (a * b).sum(axis=-1) / (np.sqrt((a * a).sum(axis=-1)) * np.sqrt((b * b).sum(axis=-1)))


def learn(sample: np.ndarray, rotations: int = 8, rounds: int = 25, seed: int = 7) -> Coder:
    x = unit(sample)
    mean = x.mean(axis=0)
    z, rng, found = x - mean, np.random.default_rng(seed), []
    for _ in range(rotations):
        r = np.linalg.qr(rng.normal(size=(x.shape[1], x.shape[1])))[0]
        for _ in range(rounds):
            u, _, w = np.linalg.svd(np.where(z @ r > 0, 1.0, -1.0).T @ z)
            r = (u @ w).T
        found.append(r.T)
    return Coder(mean, np.array(found))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances of rows of 64-bit words."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int32)


def part_radii(radius: int, parts: int) -> np.ndarray:
    """How far each substring is probed; -1: not at all."""
    low, extra = divmod(radius, parts)
    return np.where(np.arange(parts) <= extra, low, low - 1)


def meet(queries: np.ndarray, rows: np.ndarray, coder: Coder, part: int, radius: int, whole: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the pairs of codes (bytes) that substring `part` retrieves first and that are within both radii. Rows are looked up by value."""
    reach = part_radii(radius, coder.parts)
    order = np.argsort(rows[:, part], kind="stable")
    rows = rows[order]
    values, starts = np.unique(rows[:, part], return_index=True)
    ends = np.append(starts[1:], len(rows))
    a, b, near = queries.view(np.uint64), rows.view(np.uint64), _BALL[queries[:, part]]
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for value, start, end in zip(values.tolist(), starts.tolist(), ends.tolist(), strict=True):
        asked = np.flatnonzero(near[:, value] <= reach[part])
        step = max(1, (1 << 20) // max(1, end - start))
        for at in range(0, len(asked), step):
            q = asked[at : at + step]
            far = np.zeros((len(q), end - start), dtype=np.uint8 if coder.words < 4 else np.uint16)
            for w in range(coder.words):
                far += np.bitwise_count(a[q, w][:, None] ^ b[start:end, w][None, :])
            x, y = np.nonzero(far <= radius)
            x, y = q[x], y + start
            keep = distances(a[x], b[y]) <= whole
            x, y = x[keep], y[keep]
            earlier = np.bitwise_count(queries[x, :part] ^ rows[y, :part]) <= reach[:part]
            keep = ~earlier.any(axis=1)
            found.append((x[keep], order[y[keep]]))
    if not found:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])


def usable(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    v = F.col(vector).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    return vectors.where(F.col(key).isNotNull() & (F.size(v) > 0) & fine).select(F.col(key).cast("long").alias("vec_id"), v.alias("v"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _bytes(column: pa.Array) -> np.ndarray:
    """Binary values of one width as rows of bytes."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(len(column), -1)


def radii(rows: DataFrame, coder: Coder, probes: np.ndarray, ids: np.ndarray, k: int, reach: float) -> tuple[int, int]:
    """The index and the whole radius that hold `reach` per cent of the exact k neighbours that the probes have in all rows."""
    asked, codes = unit(probes), coder.codes(probes).view(np.uint64)
    schema = pa.schema([("probe", pa.int32()), ("vec_id", pa.int64()), ("score", pa.float64()), ("near", pa.int32()), ("whole", pa.int32())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[np.ndarray] | None = None  # probe, id, score, distances; the k best of each probe
        for batch in batches:
            if not batch.num_rows:
                continue
            x, of = _matrix(batch.column(1), probes.shape[1]), batch.column(0).to_numpy()
            score = np.where(of[:, None] == ids[None, :], -9.0, unit(x) @ asked.T)
            top = np.argsort(-score, axis=0)[:k]
            probe, top = np.broadcast_to(np.arange(len(ids)), top.shape).ravel(), top.ravel()
            mine = coder.codes(x[top]).view(np.uint64)
            now = [probe, of[top], score[top, probe], distances(mine[:, : coder.words], codes[probe, : coder.words]), distances(mine, codes[probe])]
            best = [np.concatenate(z) for z in zip(best, now, strict=True)] if best else now
            order = np.lexsort((-best[2], best[0]))
            best = [z[order] for z in best]
            keep = np.arange(len(order)) - np.searchsorted(best[0], best[0]) < k
            best = [z[keep] for z in best]
        if best:
            yield as_batch(schema, *best)

    top = arrow(rows, task, "probe int, vec_id long, score double, near int, whole int").where("score > -2")
    order = W.partitionBy("probe").orderBy(F.desc("score"), "vec_id")
    held = top.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).select("near", "whole").collect()
    if not held:
        return 0, 0
    return tuple(int(np.ceil(np.percentile([r[i] for r in held], reach))) for i in (0, 1))


def candidates(codes: DataFrame, asked: DataFrame, coder: Coder, radius: int, whole: int, lead: int, most: int) -> DataFrame:
    """(query_id, vec_id) of the pairs that probing retrieves within both radii."""
    reach = part_radii(radius, coder.parts)
    shift, leads = 8 - lead, np.arange(1 << lead, dtype=np.uint8)

    def deal(side: int):
        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                ids, raw = batch.column(0), batch.column(1)
                code = _bytes(raw)
                for part in range(coder.parts):
                    if reach[part] < 0 or part and reach[0] >= 8:  # the first then retrieves all
                        continue
                    own = code[:, part] >> shift
                    if side:
                        at, to = np.nonzero(np.bitwise_count(own[:, None] ^ leads[None, :]) <= reach[part])
                    else:
                        at, to = np.arange(len(own)), own
                    pick = pa.array(at)
                    yield as_batch(_DEALT, np.full(len(at), part), to.astype(np.int32), np.full(len(at), side), ids.take(pick), raw.take(pick))

        return task

    fields = "part int, lead int, side int, vec_id long, code binary"
    posted, wanted = arrow(codes, deal(0), fields), arrow(asked, deal(1), fields)
    # at most 256 places a substring, so what is broadcast is bounded
    large = posted.groupBy("part", "lead").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("slices")).where("slices > 1")
    slices = F.coalesce("slices", F.lit(1))
    place = F.when(F.col("side") == 0, F.array(F.pmod(F.xxhash64("vec_id", "code"), slices).cast("int"))).otherwise(F.sequence(F.lit(0), slices - 1))
    dealt = posted.unionByName(wanted).join(F.broadcast(large), ["part", "lead"], "left").withColumn("slice", F.explode(place))
    key = ["part", "lead", "slice"]
    dealt = dealt.repartition(partitions(codes.sparkSession), *key).sortWithinPartitions(*key, "side").select(*key, "side", "vec_id", "code")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, rows = None, [], []  # the place, and its postings: these come before its queries
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(i).to_numpy() for i in range(4)], axis=1)
            edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for x, y in zip(edges, edges[1:], strict=False):
                place, side = tuple(keys[x, :3].tolist()), keys[x, 3]
                if place != now:
                    now, ids, rows = place, [], []
                own, code = batch.column(4).slice(x, y - x).to_numpy(), _bytes(batch.column(5).slice(x, y - x))
                if not side:
                    ids.append(own)
                    rows.append(code)
                elif rows:
                    ids, rows = [np.concatenate(ids)], [np.concatenate(rows)]
                    a, b = meet(code, rows[0], coder, place[0], radius, whole)
                    q, v = own[a], ids[0][b]
                    yield as_batch(_PAIRS, q[q != v], v[q != v])

    return arrow(dealt, task, "query_id long, vec_id long")


def search(vectors: DataFrame, every: int = 50, k: int = 5, sample: int = 20000, probes: int = 400, reach: float = 98.5, most: int = 1 << 20, coder: Coder | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows whose vec_id is divisible by `every`. `sample`: most rows that the codes are
    learned from (those of least hash of their id); `probes` of them are compared with all rows; `most`: postings of a slice."""
    spark = vectors.sparkSession
    work = Tables(spark, "ann")
    rows = usable(vectors)
    learned = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toArrow()
    sizes = np.array([len(x) for x in learned.column("v").to_pylist()], dtype=np.int64)
    if not len(sizes):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = int(np.bincount(sizes).argmax())
    fits = np.flatnonzero(sizes == dim)
    known = np.array(learned.column("v").take(pa.array(fits)).to_pylist())
    coder = coder or learn(known)
    rows = work.put("rows", rows.where(F.size("v") == dim).distinct())
    radius, whole = radii(rows, coder, known[:probes], learned.column("vec_id").to_numpy()[fits][:probes], k, reach)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield as_batch(_CODES, batch.column(0), [x.tobytes() for x in coder.codes(_matrix(batch.column(1), dim))])

    codes = work.put("codes", arrow(rows, code, "vec_id long, code binary"))
    asked = codes.where(F.pmod("vec_id", F.lit(every)) == 0)
    n = codes.count()
    lead = min(8, max(4, int(np.ceil(np.log2(max(1, n) / most)))))
    pairs = work.put("pairs", candidates(codes, asked, coder, radius, whole, lead, most))
    enough = pairs.groupBy("query_id").agg(F.count_distinct("vec_id").alias("n")).where(F.col("n") >= k)
    rest = work.put("rest", asked.join(enough, asked["vec_id"] == enough["query_id"], "left_anti"))
    if not rest.isEmpty():
        bits = 64 * (len(codes.first()["code"]) // 8)
        pairs = pairs.unionByName(work.put("more", candidates(codes, rest, coder, 8 * coder.parts, bits, lead, most)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield as_batch(_SCORED, batch.column(0), batch.column(1), cosine(_matrix(batch.column(2), dim), _matrix(batch.column(3), dim)))

    both = pairs.join(rows, "vec_id").join(rows.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")), "query_id").select("query_id", "vec_id", "q", "v")
    best = work.put("best", arrow(both, score, "query_id long, vec_id long, score double").groupBy("query_id", "vec_id").agg(F.max("score").alias("score")))
    work.drop("rows", "codes", "pairs", "rest", "more")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
