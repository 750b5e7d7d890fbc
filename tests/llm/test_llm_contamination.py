"""Decontamination against brute force over strings."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lexspan.llm import contamination as c

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(texts, items, window=10):
    """For each text (n_words, hit positions, item ids)."""
    wanted = {}
    for key, text in items:
        ws = WORD.findall((text or "").translate(LOW))
        n = min(window, len(ws))
        for i in range(len(ws) - n + 1 if n else 0):
            wanted.setdefault(tuple(ws[i : i + n]), set()).add("" if key is None else str(key))
    out = []
    for text in texts:
        ws, hit, ids = WORD.findall((text or "").translate(LOW)), set(), set()
        for n in {len(w) for w in wanted}:
            for i in range(len(ws) - n + 1):
                if found := wanted.get(tuple(ws[i : i + n])):
                    hit |= set(range(i, i + n))
                    ids |= found
        out.append((len(ws), hit, sorted(ids)))
    return out


def rows(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


def benchmark(spark, items):
    return spark.createDataFrame(items, "item_id bigint, text string")


def check(spark, texts, items, **how):
    found = c.find(rows(spark, texts), benchmark(spark, items), **how)
    sets = {r["item_set"]: r["item_ids"] for r in found.item_sets.collect()}
    mine = {r["doc_id"]: r for r in found.documents.collect()}
    assert len(mine) == len(texts)
    for i, (n, hit, ids) in enumerate(brute(texts, items, how.get("window", 10))):
        r = mine[i]
        assert r["n_words"] == n
        assert [p for s, e in r["spans"] for p in range(s, e)] == sorted(hit)
        assert sets.get(r["item_set"], []) == ids
        assert all(a[1] < b[0] for a, b in zip(r["spans"], r["spans"][1:], strict=False))


@pytest.mark.parametrize("seed", range(3))
def test_as_brute_force(spark, seed):
    r = random.Random(seed)
    some = lambda n, size=9: [r.choice(["the", "Of", "a1", "é", "x", "In", "ß9", "Z", "q"][:size]) for _ in range(n)]
    items = [(i, r.choice([" ", ", ", "-\n"]).join(some(r.choice([0, 1, 2, 3, 4, 5, 6, 9, 10, 11, 25]) if seed else r.choice([10, 12, 30])))) for i in range(30)]
    items += [(3, "another text of item three that has more than ten words in it"), (None, "an item without any id but with words that are more than ten"), (40, None), (41, "... !!")]
    texts = [" ".join(some(r.randrange(40))) for _ in range(150)]
    for _ in range(80):
        item = r.choice(items)[1] or ""
        ws = WORD.findall(item)
        at = r.randrange(len(ws) + 1)
        texts.append(" ".join([*some(r.randrange(12)), *ws[at:], *some(r.randrange(5)), *ws[:at], *some(r.randrange(3))]))
    texts += [None, "", "... --", " ".join(i[1] or "" for i in items)]
    check(spark, texts, items)


def test_bit_map_that_says_yes_to_all(spark):
    """Every address is taken, so each stretch is a candidate and verification alone decides."""
    r = random.Random(5)
    items = [(i, " ".join(r.choice("abcdefgh") for _ in range(14))) for i in range(60)]
    texts = [" ".join(r.choice("abcdefgh") for _ in range(50)) for _ in range(40)] + [f"x {items[i][1]} y {items[i + 1][1]}" for i in range(20)]
    check(spark, texts, items, bits=7)
    check(spark, texts, items, bits=7, window=4, k=2)
    check(spark, texts, items, window=14, k=14)


def test_shared_passages(spark):
    """One passage in most items and documents."""
    r = random.Random(6)
    word = lambda: f"w{r.randrange(500)}"
    common = " ".join(word() for _ in range(30))
    items = [(i, f"{common} {' '.join(word() for _ in range(15))}") for i in range(50)]
    texts = [f"{' '.join(word() for _ in range(i % 7))} {common} {' '.join(word() for _ in range(9))}" for i in range(200)] + [items[7][1]] * 3
    check(spark, texts, items)


def test_edges(spark):
    names = {n: F.lit("x") for n in ("h", "row", "n_words", "stretch", "meta.x", "window", "item_set")}
    item = "one two three four five six seven eight nine ten eleven"
    frame = spark.createDataFrame([(None, item), (None, item), (1, None), (2, f"a {item} b"), (2, f"a {item} b"), (2, "clean text"), (3, "")], "doc_id bigint, text string").withColumns(names)
    bench = benchmark(spark, [(9, item), (9, item), (8, item)]).withColumns(names)
    out = sorted(c.digests(c.find(frame, bench)).collect(), key=str)
    assert len(out) == 7
    assert sum(r["contaminated"] for r in out) == 4
    assert {r["n_items"] for r in out if r["contaminated"]} == {2}
    kept = c.drop_contaminated(frame, bench)
    assert kept.columns == frame.columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == [(1, None), (2, "clean text"), (3, "")]
    assert c.drop_contaminated(frame, bench, max_share=0.9).count() == 5
    assert c.digests(c.find(frame.limit(0), bench)).count() == 0
    assert not any(r["contaminated"] for r in c.digests(c.find(frame, bench.limit(0))).collect())


def test_long_texts(spark):
    item = " ".join(f"w{i}" for i in range(40))
    texts = ["a " * 500_000 + item, "é" * 1_000_000, "-" * 1_000_000, f"{item} " * 2000]
    out = {r["doc_id"]: (r["n_words"], r["n_hit"]) for r in c.digests(c.find(rows(spark, texts), benchmark(spark, [(1, item)]))).collect()}
    assert out == {0: (500_040, 40), 1: (1, 0), 2: (0, 0), 3: (80_000, 80_000)}
