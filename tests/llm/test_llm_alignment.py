"""Alignment against a byte-by-byte version over the public libraries."""

import hashlib
import json
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lexspan.llm import alignment

TEXTS = [None, "", " ", "a", "Hello world", " two  blanks ", "naïve 😀😀 café", "tab\tand\nlines\n\n", "<|endoftext|> and <s> </s> <unk> <0x41>", "already ▁ marked", "x" * 300, "汉字 и кириллица", "1234567 89", "a\x00b", "don't we'll", "é ﬁ Å", "   ", "\n"]


@pytest.fixture(scope="module")
def public():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    entries = {i: s for s, i in json.load(open(public_tokenizers.path("byte_bpe_50k.json")))["model"]["vocab"].items()}
    # the byte-level alphabet: printable bytes stand for themselves, the others for characters from 256 on
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    byte_of = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))

    def tokens(text):
        of_a = a.encode(" " + text, add_special_tokens=False).ids
        of_b = b.encode(text)
        bytes_a = [bytes(byte_of[c] for c in entries[i]) for i in of_a]
        bytes_b = [bytes([int(b.id_to_piece(i)[3:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in of_b]
        return of_a, of_b, bytes_a, bytes_b

    return tokens


def brute(texts, public):
    rows, linked = [], []
    for text in texts:
        of_a, of_b, bytes_a, bytes_b = public(text) if text else ([], [], [], [])
        if not text or not b"".join(bytes_a) == b"".join(bytes_b) == b" " + text.encode():
            rows.append((0, 0, 0, 0, ""))
            linked.append([])
            continue
        own_a = [i for i, x in enumerate(bytes_a) for _ in x]
        own_b = [i for i, x in enumerate(bytes_b) for _ in x]
        pairs = sorted(set(zip(own_a, own_b, strict=True)))
        groups, a_in, b_in = [], [], []
        for at, (i, j) in enumerate(zip(own_a, own_b, strict=True)):
            if at and i != own_a[at - 1] and j != own_b[at - 1]:
                groups.append((a_in, b_in))
                a_in, b_in = [], []
            a_in += [i] if i not in a_in[-1:] else []
            b_in += [j] if j not in b_in[-1:] else []
        groups.append((a_in, b_in))
        said = ";".join(",".join(str(of_a[i]) for i in x) + "|" + ",".join(str(of_b[j]) for j in y) for x, y in groups)
        rows.append((len(of_a), len(of_b), len(groups), len(pairs), hashlib.sha256(said.encode()).hexdigest()))
        linked.append([(of_a[i], of_b[j]) for i, j in pairs])
    counts = Counter(p for x in linked for p in x)
    best = {}
    for (_, j), n in counts.items():
        best[j] = max(best.get(j, 0), n)
    return [(*r[:4], sum(counts[p] == best[p[1]] for p in x), sum(counts[p] for p in x), r[4]) for r, x in zip(rows, linked, strict=True)], counts, best


def frame(spark, texts, parts=3):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(parts)


NAMES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("lot", [1, 200, 1 << 23])
def test_as_byte_by_byte(spark, public, lot):
    r = random.Random(lot)
    pool = "the of and 12 don't naïve 😀 ▁ \n \t été здесь 字 x1 <s> ...".split(" ")
    texts = TEXTS + [" ".join(r.choice(pool) for _ in range(r.randrange(60))) for _ in range(60)]
    expected, counts, best = brute(texts, public)
    made = {x["doc_id"]: tuple(x[n] for n in NAMES) for x in alignment.scored(frame(spark, texts), lot=lot).collect()}
    assert [made[i] for i in range(len(texts))] == expected
    found = alignment.pair_counts(alignment.lots(frame(spark, texts), lot=lot)).collect()
    assert {(x["a_id"], x["b_id"]): x["n"] for x in found} == counts
    assert all(x["best"] == (x["n"] == best[x["b_id"]]) for x in found)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from("aAe \n1é😀▁<>|字'"), max_size=15), max_size=8), st.integers(1, 9))
def test_links_of_any_texts(texts, step):
    a, b = alignment.rank_side(), alignment.piece_side()
    found = alignment.align(texts, a, b)
    ends = np.cumsum(a.sizes[found.a]), np.cumsum(b.sizes[found.b])
    for whole, sliced in zip((found.link_a, found.link_b, found.cut), alignment.links_of(*ends, step=step), strict=True):
        assert (whole == sliced).all()
    own = [np.repeat(np.arange(len(x)), s.sizes[x]).tolist() for x, s in ((found.a, a), (found.b, b))]
    assert list(zip(found.link_a.tolist(), found.link_b.tolist(), strict=True)) == sorted(set(zip(*own, strict=True)))
    assert found.per_text(np.ones(len(found.cut), dtype=int)).sum() == len(found.cut)


def test_groups_join_to_the_text(spark):
    texts = [t for t in TEXTS if t]
    pieces = [s().pieces for s in alignment.SIDES]
    for row in alignment.grouped(frame(spark, texts)).collect():
        whole = b" " + texts[row["doc_id"]].encode()
        for side, names in zip(pieces, ("a_ids", "b_ids"), strict=True):
            assert all(b"".join(side[i] for i in g[names]) == whole[g["start"] : g["end"]] for g in row["groups"])
        assert "▁" in texts[row["doc_id"]] or [g["start"] for g in row["groups"]] + [len(whole)] == [0] + [g["end"] for g in row["groups"]]


def test_edges(spark):
    rows = [(None, "a b"), (None, None), (1, "a b"), (1, "a b"), (2, "")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({n: F.lit("x") for n in ("lot", "pairs", "n", "best", "meta.x", "n_a")})
    out = alignment.scored(d).collect()
    assert sorted((str(r["doc_id"]), r["n_a"], r["count_sum"] > 0) for r in out) == [("1", 2, True), ("1", 2, True), ("2", 0, False), ("None", 0, False), ("None", 2, True)]
    assert {r["count_sum"] for r in out if r["n_a"]} == {6}
    assert alignment.scored(d.limit(0)).count() == 0
    assert alignment.scored(d.where("doc_id = 2")).collect()[0]["groups_sha256"] == ""
    assert alignment.grouped(d.limit(0)).count() == 0


def test_long_texts(spark):
    texts = ["a" * 300_000 + " 7", " " * 500_000, "\n" * 200_000, "the cat 12 " * 100_000]
    out = {r["doc_id"]: r for r in alignment.scored(frame(spark, texts)).collect()}
    assert all(r["n_links"] >= max(r["n_a"], r["n_b"]) > 0 for r in out.values())
