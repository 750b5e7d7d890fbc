"""Benchmark decontamination by a prefix-filtered set join.

Each benchmark item is its windows of `window` consecutive words, or one window if it is shorter. A window is a set of shingles of `k` words
at fixed places (a shorter window is one shingle), and a document holds it only if all of them stand there at those places. So:

1. A bit map of 2 ** `bits` bits, whatever the benchmark's size, says which shingles may occur in some window. One pass over the texts keeps the
   stretches that could hold a window: so many possible shingles in a row as a window has (length and positional bound). Equal stretches
   of all documents are then one row, with their count.
2. Shingles are ordered by rarity, the times that they stand in stretches of all documents. As all shingles of a window have to be there, its
   prefix is one: the rarest. Windows with a shingle that stands nowhere go.
3. Stretches join windows on prefix shingles. A pair stays if the window, put where the shingle's place says, begins and ends inside the stretch
   (positional bound), and if its words are those that stand there (verification).
4. Hit words of a stretch are the union of its windows' places; those of a document are its stretches', which never touch.

Items of a window are kept as sets, and documents with equal sets of items share one row of item_sets, so a passage in a third of
all documents or items costs no pair of document and item.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` with A-Z lower-cased. Cases: null and empty texts have no words; items without words have no
windows; items without an id count with the id ''; an item_id with several texts is one item; repeated rows give a row each, with or without
an id; an empty benchmark hits nothing; an empty table gives no rows; other columns are ignored; texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexspan.llm.common import Tables, arrow, as_batch, id_text, rows_of
from lexspan.llm.passages import Cut, hash_words, mix

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Before A-Z are lower-cased.
LETTERS = Cut(rb"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F")
_Q = np.uint64(0xC2B2AE3D27D4EB4F)


@dataclass(frozen=True)
class Found:
    """documents(doc_id, text_hash, n_words, spans, item_set): a row for each document, spans being the hit words as array<struct<start, end>>
    (end exclusive, sorted, not touching), item_set null where nothing is hit. item_sets(item_set, item_ids): its items' ids as sorted strings."""

    documents: DataFrame
    item_sets: DataFrame


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k words in a row."""
    n = max(0, len(hashes) - k + 1)
    mixed = np.full(n, k, dtype=np.uint64)
    for j in range(k):
        mixed = mixed * _Q + hashes[j : j + n]
    return mix(mixed)


def windows_of(items: DataFrame, window: int, key: str = "item_id", text: str = "text") -> DataFrame:
    """(window, n, items): each distinct window, its words joined by blanks, how many they are, and the ids of its items as sorted strings."""
    low = F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = items.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("item_id"), F.regexp_extract_all(low, F.lit(WORD), F.lit(0)).alias("words")).where(F.size("words") > 0)
    each = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - window + 1)), lambda i: F.array_join(F.slice("words", i, window), " "))
    rows = words.select("item_id", F.explode(each).alias("window"))
    return rows.groupBy("window").agg(F.array_sort(F.collect_set("item_id")).alias("items")).select("window", F.size(F.split("window", " ")).alias("n"), "items")


def shingles(windows: DataFrame, k: int) -> DataFrame:
    """(window, n, place, g): the shingles of windows(window, n)."""
    schema = pa.schema([("window", pa.string()), ("n", pa.int32()), ("place", pa.int32()), ("g", pa.int64())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ns, texts in rows_of(batches):
            out: list[tuple] = []
            for n, text in zip(ns, texts, strict=True):
                found = grams(hash_words([text], cut=LETTERS)[0], min(k, n)).astype(np.int64)
                out += ((text, n, place, g) for place, g in enumerate(found.tolist()))
            yield as_batch(schema, *(zip(*out, strict=True) if out else [[]] * 4))

    return arrow(windows.select("n", "window"), task, "window string, n int, place int, g long")


def bit_map(found: DataFrame, bits: int) -> np.ndarray:
    """A bit map of `bits` bits' addresses in which the shingles of found(g) are set: at most 2 ** (bits - 6) rows come to the driver."""
    at = F.col("g").bitwiseAND(F.lit((1 << bits) - 1))
    rows = found.select(at.alias("at")).groupBy(F.shiftrightunsigned("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("set")).toArrow()
    out = np.zeros(1 << (bits - 6), dtype="<i8")
    out[rows["word"].to_numpy()] = rows["set"].to_numpy()
    return out.view(np.uint8)


def covered(hashes: np.ndarray, owner: np.ndarray, lengths: list[int], k: int, possible: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first word, end) of the stretches in which windows of the lengths may stand, each within one text."""
    n, mask = len(hashes), np.uint64(8 * len(possible) - 1)
    edges, set_ = np.zeros(n + 1, dtype=np.int64), {}
    for length in lengths:
        s = min(k, length)
        if n < length:
            continue
        if s not in set_:
            at = grams(hashes, s) & mask
            set_[s] = np.concatenate([[0], np.cumsum((possible[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1)])
        need = length - s + 1
        start = np.flatnonzero((set_[s][need:] - set_[s][:-need] == need) & (owner[: n - length + 1] == owner[length - 1 :]))
        np.add.at(edges, start, 1)
        np.add.at(edges, start + length, -1)
    inside = np.cumsum(edges)[:n] > 0
    new = np.concatenate([[True], owner[1:] != owner[:-1]]) if n else inside
    first = np.flatnonzero(inside & (new | ~np.concatenate([[False], inside[:-1]])))
    last = np.flatnonzero(inside & np.concatenate([new[1:] | ~inside[1:], [True]])) if n else first
    return first, last + 1


def scanned(docs: DataFrame, lengths: list[int], k: int, possible) -> DataFrame:
    """(row, doc_id, text_hash, n_words, stretches): for each document where its stretches start and their words. `possible`: a broadcast bit map."""
    stretch = pa.struct([("start", pa.int32()), ("words", pa.string())])
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_words", pa.int64()), ("stretches", pa.list_(stretch))])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ctx = TaskContext.get()
        row, bits = (ctx.partitionId() if ctx else 0) << 40, possible.value
        for keys, texts in rows_of(batches):
            hashes, owner = hash_words(texts, cut=LETTERS)
            begin = np.searchsorted(owner, np.arange(len(texts) + 1))
            found: list[list] = [[] for _ in texts]
            first, end = covered(hashes, owner, lengths, k, bits)
            words: tuple[int, list] = (-1, [])
            for i, s, e in zip(owner[first].tolist(), first.tolist(), end.tolist(), strict=True):
                if words[0] != i:
                    words = (i, LETTERS.word.findall(texts[i].encode().lower()))
                s, e = s - int(begin[i]), e - int(begin[i])
                found[i].append({"start": s, "words": b" ".join(words[1][s:e]).decode()})
            yield as_batch(schema, np.arange(row, row + len(texts)), [x["doc_id"] for x in keys], [x["text_hash"] for x in keys], np.diff(begin), found)
            row += len(texts)

    rows = id_text(docs).select(F.struct("doc_id", F.xxhash64("text").alias("text_hash")), "text")
    return arrow(rows, task, "row long, doc_id long, text_hash long, n_words long, stretches array<struct<start:int,words:string>>")


def occurrences(stretches: DataFrame, lengths: list[int], window: int, k: int) -> DataFrame:
    """(stretch, times, pos, g, left, near): the shingles of stretches(stretch, times, words) with the words around that a window may have,
    `left` of which stand before pos."""
    schema = pa.schema([("stretch", pa.binary()), ("times", pa.int64()), ("pos", pa.int32()), ("g", pa.int64()), ("left", pa.int32()), ("near", pa.string())])
    sizes = sorted({min(k, n) for n in lengths})

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in rows_of(batches, 1 << 18):
            out: list[tuple] = []
            for key, text in zip(keys, texts, strict=True):
                words, hashes = text.split(" "), hash_words([text], cut=LETTERS)[0]
                for s in sizes:
                    for pos, g in enumerate(grams(hashes, s).astype(np.int64).tolist()):
                        left = min(pos, window - s)
                        out.append((key["stretch"], key["times"], pos, g, left, " ".join(words[pos - left : pos + window])))
            yield as_batch(schema, *(zip(*out, strict=True) if out else [[]] * 6))

    return arrow(stretches.select(F.struct("stretch", "times"), "words"), task, "stretch binary, times long, pos int, g long, left int, near string")


def find(docs: DataFrame, items: DataFrame, window: int = 10, k: int = 5, bits: int = 26) -> Found:
    """Where windows of the items stand in the documents."""
    spark = docs.sparkSession
    work = Tables(spark, "contamination")
    wins = work.put("windows", windows_of(items, window).withColumn("set", F.sha2(F.array_join("items", ","), 256)))
    lengths = sorted(r["n"] for r in wins.select("n").distinct().collect())  # `window` rows at most
    grammed = work.put("shingles", shingles(wins, k))
    possible = spark.sparkContext.broadcast(bit_map(grammed, bits))
    seen = work.put("scanned", scanned(docs, lengths, k, possible))
    met = seen.where(F.size("stretches") > 0).select("row", F.explode("stretches").alias("s")).select("row", F.col("s.start").alias("start"), F.unhex(F.sha2("s.words", 256)).alias("stretch"), F.col("s.words").alias("words"))
    unique = work.put("stretches", met.groupBy("stretch", "words").agg(F.count("*").alias("times")))
    occurring = work.put("occurrences", occurrences(unique, lengths, window, k))

    rare = occurring.groupBy("g").agg(F.sum("times").alias("times"))
    prefix = grammed.join(rare, "g").groupBy("window", "n").agg(F.min_by(F.struct("g", "place"), F.struct("times", "g", "place")).alias("first"), F.count("*").alias("there"))
    prefix = prefix.where(F.col("there") == F.col("n") - F.least("n", F.lit(k)) + 1).select("window", "n", "first.*").join(wins.select("window", "set"), "window")
    near = F.split("near", " ")
    from_ = F.col("left") - F.col("place")
    pairs = occurring.join(prefix, "g").where((from_ >= 0) & (from_ + F.col("n") <= F.size(near))).where(F.array_join(F.slice(near, from_ + 1, F.col("n")), " ") == F.col("window"))
    placed = pairs.groupBy("stretch", (F.col("pos") - F.col("place")).alias("s")).agg(F.max("n").alias("n"), F.collect_set("set").alias("sets")).withColumn("e", F.col("s") + F.col("n"))

    order = W.partitionBy("stretch").orderBy("s")
    reached = placed.withColumn("reached", F.max("e").over(order.rowsBetween(W.unboundedPreceding, -1)))
    islands = reached.withColumn("island", F.sum(F.when(F.col("s") <= F.col("reached"), 0).otherwise(1)).over(order)).groupBy("stretch", "island").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.array_distinct(F.flatten(F.collect_list("sets"))).alias("sets"))
    hit = work.put("hit", islands.groupBy("stretch").agg(F.collect_list(F.struct("s", "e")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("sets"))).alias("sets")))

    moved = F.transform("spans", lambda x: F.struct((x["s"] + F.col("start")).alias("start"), (x["e"] + F.col("start")).alias("end")))
    by_row = met.select("row", "start", "stretch").join(hit, "stretch").groupBy("row").agg(F.array_sort(F.flatten(F.collect_list(moved))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("sets")))).alias("sets"))
    hits = work.put("hits", by_row.select("row", "spans", "sets", F.sha2(F.array_join("sets", ","), 256).alias("item_set")))

    work.drop("shingles", "stretches", "occurrences", "hit")

    sets = wins.groupBy("set").agg(F.first("items").alias("items"))
    asked = hits.select("item_set", "sets").distinct().select("item_set", F.explode("sets").alias("set"))
    item_sets = asked.join(sets, "set").groupBy("item_set").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("item_ids"))
    none = F.array().cast("array<struct<start:int,end:int>>")
    named = ["doc_id", "text_hash", "n_words"]
    plain = seen.where(F.size("stretches") == 0).select(*named, none.alias("spans"), F.lit(None).cast("string").alias("item_set"))
    some = seen.where(F.size("stretches") > 0).join(hits, "row", "left").select(*named, F.coalesce("spans", none).alias("spans"), "item_set")
    return Found(plain.unionByName(some), item_sets)


def digests(found: Found) -> DataFrame:
    sets = found.item_sets.select("item_set", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    hit = found.documents.where("item_set is not null").join(sets, "item_set").select("doc_id", "n_words", n_hit.alias("n_hit"), "n_items", "items_sha256")
    clean = found.documents.where("item_set is null").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_hit"), F.lit(0).cast("long").alias("n_items"), F.sha2(F.lit(""), 256).alias("items_sha256"))
    return clean.unionByName(hit).withColumn("contaminated", F.col("n_hit") > 0)


def drop_contaminated(docs: DataFrame, items: DataFrame, max_share: float = 0.0, **how) -> DataFrame:
    """The documents of whose words at most the share `max_share` is hit, all columns kept."""
    docs_found = find(docs, items, **how).documents
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    gone = docs_found.where(n_hit > F.lit(max_share) * F.col("n_words")).select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash")).distinct()
    same = docs["doc_id"].cast("long").eqNullSafe(F.col("gone_id")) & (F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit(""))) == F.col("gone_hash"))
    return docs.join(gone, same, "left_anti")
