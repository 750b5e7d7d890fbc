"""Fill-in-middle against a plain Python version, for each grammar."""

import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexspan.llm import middle

GRAMMARS = {"tokens": (middle.TOKENS, "[A-Za-z]+|[^A-Za-z]"), "characters": (middle.CHARACTERS, r"[\s\S]"), "lines": (middle.LINES, r"[^\n]*\n|[^\n]+"), "spaced": (middle.SPACED, r"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+")}
TEXTS = [None, "", "a", " ", "\n\n", "ab cd", "x1y2", "é😀a😀b", "😀😀", "<P> in a text", "a<", "S>b<S", "word\n\nmore words\r\nlast  ", "İıß a\x00b", "A" * 3000 + "é" * 3000, "don't stop"]


def plain(key, text, pattern):
    units = re.findall(pattern, text or "")
    digest = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    low, high = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = ("".join(x) for x in (units[:low], units[low:high], units[high:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, text or ""
    return (len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else (len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def rows(spark, texts, keys=None):
    return spark.createDataFrame([(k, t) for k, t in zip(keys or range(len(texts)), texts, strict=True)], "doc_id bigint, text string")


@pytest.mark.parametrize("name", GRAMMARS)
def test_as_plain_python(spark, name):
    grammar, pattern = GRAMMARS[name]
    texts = [t for t in TEXTS for _ in range(12)]
    for r in middle.fill_in_middle(rows(spark, texts), grammar).collect():
        text = texts[r["doc_id"]]
        expected = plain(r["doc_id"], text, pattern)
        assert (r["n"], r["form"], None if r["prefix"] is None else len(r["prefix"]), None if r["middle"] is None else len(r["middle"]), r["output"]) == expected


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(st.sampled_from("aZ9 \n<PSM>é😀İ"), max_size=12), min_size=40, max_size=40))
def test_any_text_comes_back(spark, texts):
    made = middle.digests(middle.fill_in_middle(rows(spark, texts)))
    for r in made.collect():
        n, form, p, m, output = plain(r["doc_id"], texts[r["doc_id"]], GRAMMARS["tokens"][1])
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"]) == (n, form, p, m)
        assert r["output_sha256"] == hashlib.sha256(output.encode()).hexdigest()
        assert r["restored_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_edges_and_columns(spark):
    frame = rows(spark, [None, "", "one two", "one two", "one two"], [None, 1, None, 2, 2]).withColumns({"n": F.lit(1), "form": F.lit("x"), "pieces": F.lit(2), "meta.x": F.lit("y"), "a`b": F.lit("z"), "n_chars": F.lit(0), "fim_form": F.lit(0)})
    made = middle.transformed(frame)
    assert made.columns == [*frame.columns, "fim_form_0"]
    assert {(r["meta.x"], r["a`b"], r["n"], r["form"]) for r in made.collect()} == {("y", "z", 1, "x")}
    assert all(r["n_chars"] == len(r["text"]) for r in made.collect())
    assert made.count() == 5
    assert middle.fill_in_middle(frame).count() == 5
    assert middle.transformed(frame.limit(0)).count() == 0
    assert middle.digests(middle.fill_in_middle(frame.limit(0))).count() == 0


def test_other_marks_and_shares(spark):
    form = middle.Form("[[pre]]", "[[suf]]", "[[mid]]", cut_share=100, spm_share=50, seed="other")
    texts = [f"some words {i} [[ ]] pre" for i in range(200)]
    made = middle.fill_in_middle(rows(spark, texts), middle.SPACED, form).withColumn("back", middle.restore(F.col("output"), F.col("form"), form)).collect()
    assert all(r["back"] == r["text"] for r in made)
    assert {r["form"] for r in made} == {"psm", "spm"}
    for bad in (("<a>", "<a>", "<b>"), ("aa", "b", "c"), ("xy", "yz", "c"), ("", "a", "b"), ("abc", "b", "d")):
        with pytest.raises(ValueError, match="marks"):
            middle.Form(*bad)


def test_long_texts(spark):
    texts = ["a" * 1_000_000 + " 7", " " * 1_000_000, "a b " * 200_000]
    made = middle.digests(middle.fill_in_middle(rows(spark, texts))).collect()
    assert {r["doc_id"]: r["n"] for r in made} == {0: 3, 1: 1_000_000, 2: 800_000}
    assert all(r["restored_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest() for r in made)


def test_boundaries_are_zero_width_and_no_python_runs(spark):
    assert middle.TOKENS.boundary == r"(?<=[A-Za-z])(?![A-Za-z])(?=[\s\S])|(?<=[^A-Za-z])(?=[\s\S])"
    plan = middle.digests(middle.fill_in_middle(rows(spark, ["a b"])))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
