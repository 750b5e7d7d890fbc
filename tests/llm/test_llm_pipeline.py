"""The pipeline against its stages done by hand on plain Python values."""

import os

import numpy as np
import pytest

from lexspan.llm import packing, passages, quality, secrets, simhash

pipeline = pytest.importorskip("corpus_pipeline")
SMALL = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the test tables")
def test_run(spark):
    import re

    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    kept = {d: left for d, (found, left) in ((d, quality.judge(t)) for d, t in docs.items()) if found[6]}
    forest, ids = simhash.Forest(), sorted(kept)
    prints = np.array([simhash.fingerprint(kept[d]) for d in ids], dtype=np.uint64)
    for i, d in enumerate(ids):
        for j in np.flatnonzero(np.bitwise_count(prints[i + 1 :] ^ prints[i]) <= 4):
            forest.join(d, ids[i + 1 + int(j)])
    first = {d: kept[d] for d in ids if forest.root(d) == d}
    table = spark.createDataFrame(sorted(first.items()), "doc_id bigint, text string")
    spans: dict = {}
    for r in passages.passages(table).collect():
        spans.setdefault(r["doc_id"], []).append((r["start_word"], r["end_word"]))
    # every passage found has its words in the source, near enough, and no exact run of 60 shared words is missed
    words = {d: t.encode().lower().split() for d, t in first.items()}
    seen: dict = {}
    for d in sorted(words):
        for i in range(len(words[d]) - 59):
            run = tuple(words[d][i : i + 60])
            if seen.setdefault(run, d) < d:
                assert any(s <= i + 5 and i + 55 <= e for s, e in spans.get(d, []))
    # and nothing is cut that earlier documents have not got: of each span's words most stand in a run of three that one of them has too
    known: dict = {}
    for d in sorted(words):
        for i in range(len(words[d]) - 2):
            known.setdefault(tuple(words[d][i : i + 3]), d)
    for d, found in spans.items():
        for s, e in found:
            inside = {j for i in range(s, e - 2) if known[tuple(words[d][i : i + 3])] < d for j in range(i, i + 3)}
            assert len(inside) >= 0.7 * (e - s)
    cut = {d: passages.without(t, spans.get(d, [])) for d, t in first.items()}
    cut = {d: t for d, t in cut.items() if t.strip()}
    clean = {}
    for d, t in cut.items():
        hits = sorted((m.start(), m.end()) for r in secrets.RULES for m in re.finditer(r.pattern, t, re.I | re.A if r.nocase else re.A) if len(m[r.group]) >= r.least)
        out, at = [], 0
        for s, e in hits:
            if s >= at:
                out += [t[at:s], "[SECRET]"]
            at = max(at, e)
        clean[d] = "".join([*out, t[at:]])
    encode = packing.rank_encoder()
    lengths = {d: len(encode(t)) + 1 for d, t in clean.items()}
    rows = pipeline.run(spark, SMALL).collect()
    assert {r["doc_id"]: r["doc_tokens"] for r in rows} == lengths
    total: dict = {}
    for r in rows:
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["length"]
    assert total == lengths


def test_edge_cases(spark, tmp_path):
    """Null ids and texts, empty, repeated and very long ones, and no rows at all."""
    prose = " ".join(f"w{i * i % 997} and" for i in range(120)) + "."
    rows = [(1, None, "en", "s", 0), (2, "", "en", "s", 0), (None, prose, None, None, None), (None, None, None, None, None), (3, prose, "en", "s", 5), (3, prose, "en", "s", 5), (4, prose + " more", "en", "s", 5), (5, " ".join(f"x{i}" for i in range(40_000)), "en", "s", 5), (6, "a" * 1_000_000, "en", "s", 5), (7, " " * 1_000_000 + prose.upper() + " password=abcdefgh12", "en", "s", 5)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    table.write.parquet(f"{tmp_path}/some/documents.parquet")
    found = {r["doc_id"] for r in pipeline.run(spark, f"{tmp_path}/some").collect()}
    # the row without an id has the text of document 3, so it goes as a copy
    assert found == {3, 5}
    table.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_stages():
    assert len(pipeline.STAGES) == 5
    assert pipeline.ORACLE_SQL is None
