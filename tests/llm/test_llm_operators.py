"""Each operator against brute force, an exact round trip or held-out accuracy, and its edge cases."""

import hashlib
import os
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexspan.llm import ann, bpe, chat, packing, passages, pii, quality, secrets, simhash, toxicity

DOCS = "doc_id bigint, text string"
#: Columns whose names the operators use inside.
CLASH = ("meta.x", "a`b", "h", "fp", "found", "hits", "key", "kinds", "node", "label", "spans", "_spans", "n_words", "low")
tables = pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the test tables")


def docs(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], DOCS)


def words(n, seed, size=4000):
    r = random.Random(seed)
    return [f"w{r.randrange(size)}" for _ in range(n)]


def edge_cases(spark):
    """Null ids and texts, an empty and a very long text, repeated rows and clashing column names."""
    long = " ".join(words(30_000, 1))
    rows = [(1, None), (2, ""), (None, "password=abcdefgh12 a b"), (None, None), (3, "  \n\t "), (4, long), (5, "same text here again"), (5, "same text here again"), (6, "same text here again")]
    return spark.createDataFrame(rows, DOCS).withColumns({n: F.lit("x") for n in CLASH})


FRAMES = {
    "toxicity": lambda d: toxicity.score(d, toxicity.OrdinalModel({"bad": 1.0}, [1.0, 2.0])),
    "pii": lambda d: pii.pseudonymise(d, "k"),
    "secrets": lambda d: secrets.digests(secrets.scan(d)),
    "redact": secrets.redact,
    "packing": packing.pack,
    "bpe": bpe.encode_documents,
    "quality": quality.quality,
    "keep_good": quality.keep_good,
    "simhash": simhash.groups,
    "keep_first": simhash.keep_first,
    "passages": passages.passages,
    "drop_passages": passages.drop_passages,
}


@pytest.mark.parametrize("name", FRAMES)
def test_edges_and_empty_tables(spark, name):
    d = edge_cases(spark)
    made = FRAMES[name](d)
    rows = made.collect()
    if name in ("toxicity", "pii", "secrets", "bpe", "quality", "simhash", "redact"):
        assert len(rows) == 9
    if name in ("redact", "keep_good", "keep_first", "drop_passages"):
        assert made.columns == d.columns
    nothing = FRAMES[name](d.limit(0))
    assert nothing.count() == 0
    assert nothing.columns == made.columns


@pytest.mark.parametrize("name", FRAMES)
def test_very_long_runs(spark, name):
    runs = [" " * 1_000_000 + "x", "a" * 1_000_000 + " 7", "\n" * 500_000, "7" * 500_000, "a b " * 200_000]
    assert FRAMES[name](docs(spark, *runs)).count() >= 0


# Toxicity


@tables
def test_toxicity_held_out(spark):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(d, labels, sample=1200)
    assert model.thresholds == sorted(model.thresholds)
    trained = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    seen = [trained.where(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(600) for t in (0, 1)]
    held = trained.join(seen[0].unionByName(seen[1]).select("doc_id"), "doc_id", "left_anti")
    rows = toxicity.score(d, model).join(held, "doc_id").collect()
    pairs = [(r[-1], r["expected_severity"]) for r in rows]
    hit = Counter((bool(t), s > 0.5) for t, s in pairs)
    assert hit[(True, True)] + hit[(False, False)] >= 0.98 * len(pairs)


def test_toxicity_trained_by_executors_as_by_one(spark):
    r = random.Random(4)
    texts = [" ".join(words(30, i, 60) + (["vile", "horrid"] * r.randrange(1, 4) if i % 3 == 0 else [])) for i in range(200)] + [None, "x " * 200_000]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(202)], "doc_id bigint, toxic int")
    model = toxicity.train(docs(spark, *texts), labels)
    plain = toxicity.learn([t or "" for t in texts], [int(i % 3 == 0) for i in range(202)])
    assert model.weights == pytest.approx(plain.weights, abs=1e-6) and len(model.weights) > 3
    assert model.thresholds == pytest.approx(plain.thresholds, abs=1e-6)
    assert toxicity.train(docs(spark, *texts), labels, vocabulary=2).weights.keys() <= model.weights.keys()


def test_toxicity_without_labels(spark):
    assert toxicity.train(docs(spark, "a"), spark.createDataFrame([], "doc_id bigint, toxic int")).thresholds == []
    assert toxicity.learn([], []).score("a", {}) == (0.0, 0, False)
    assert toxicity.learn(["a b"], [1]).thresholds == []


def test_ordinal_order():
    r = random.Random(3)
    grades = [r.randrange(4) for _ in range(400)]
    texts = [" ".join(["bad"] * (2 * g) + words(10, i)) for i, g in enumerate(grades)]
    model = toxicity.fit([toxicity.vector_of(t) for t in texts], grades, ["bad", "^bad"])
    score = [model.score(" ".join(["bad"] * n + ["x"]), {})[0] for n in range(7)]
    assert score == sorted(score)
    assert score[0] < 0.5 < 2.5 < score[6]


def test_ordinal_fit_is_the_likeliest():
    """Against plain ascent of the penalised likelihood, its gradient by differences."""
    r = random.Random(8)
    rows = [(r.randrange(4), r.randrange(3)) for _ in range(300)]
    grades = [min(3, max(0, round(0.8 * a - 0.3 * b + r.gauss(0, 0.7)))) for a, b in rows]
    model = toxicity.fit([{"a": float(a), "b": float(b)} for a, b in rows], grades, ["a", "b"], rounds=2000)
    x, y = np.array(rows, dtype=float), np.array(grades)

    def value(p):
        ends = np.concatenate([[-np.inf], np.cumsum([p[2], np.exp(p[3]), np.exp(p[4])]), [np.inf]])
        below = 1 / (1 + np.exp(-(ends[None, :] - (x @ p[:2])[:, None])))
        n = np.arange(len(y))
        return np.log(below[n, y + 1] - below[n, y]).mean() - 0.5e-3 * (p[:2] @ p[:2])

    p = np.zeros(5)
    for _ in range(4000):
        p = p + 0.5 * np.array([(value(p + h) - value(p - h)) / 2e-5 for h in 1e-5 * np.eye(5)])
    assert [model.weights["a"], model.weights["b"]] == pytest.approx(p[:2].tolist(), abs=0.02)
    assert model.thresholds == pytest.approx(np.cumsum([p[2], np.exp(p[3]), np.exp(p[4])]).tolist(), abs=0.03)


# PII


def luhn(d):
    return sum((x * 2 - 9 if x > 4 else x * 2) if i % 2 else x for i, x in enumerate(map(int, reversed(d))))


def test_pii_formats(spark):
    text = "m bob.Ab-42@mail8.example.com 10.1.2.255 +1 (988) 555-2485 4041894974608795 4041-8949-7460-8795 123-45-6789 2001-02-29 2000-02-29 31.12.1999 12/31/1999 999.1.1.1 4041894974608796"
    rows = pii.pseudonymise(docs(spark, text, "bob.Ab-42@mail8.example.com 1999-12-31 4041 8949 7460 8795", "none 12"), "k0").orderBy("doc_id").collect()
    new = rows[0]["text"].split()
    old = text.split()
    assert rows[2]["text"] == "none 12"
    assert [i for i, (a, b) in enumerate(zip(old, new)) if a != b] == [1, 2, 4, 5, 6, 7, 8, 10, 11, 12]
    assert all(re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub(r"\d", "9", a))) == re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub(r"\d", "9", b))) or i == 2 for i, (a, b) in enumerate(zip(old, new)))
    assert luhn(new[6]) % 10 == 0 and new[7].replace("-", "") == new[6]
    other = rows[1]["text"].split()
    assert other[0] == new[1]
    y, m, day = other[1].split("-")
    assert new[11] == f"{day}.{m}.{y}" and new[12] == f"{m}/{day}/{y}"
    assert "".join(other[2:]) == new[6]
    assert (rows[0]["n_email"], rows[0]["n_date"], rows[0]["n_ip"], rows[0]["n_ssn"], rows[0]["n_phone"], rows[0]["n_card"]) == (1, 3, 1, 1, 1, 2)


def test_pii_is_a_permutation(spark):
    days = spark.range(0, 146097, 7).select("id", F.date_format(F.date_add(F.lit("1800-01-01").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("text"))
    out = pii.pseudonymise(days.withColumnRenamed("id", "doc_id"), "k1")
    assert out.select("text").distinct().count() == out.count()
    ips = spark.range(20000).select(F.col("id").alias("doc_id"), F.concat_ws(".", F.lit("10"), (F.col("id") / 65536).cast("int") % 256, (F.col("id") / 256).cast("int") % 256, F.col("id") % 256).alias("text"))
    out = pii.pseudonymise(ips, "k1")
    assert out.select("text").distinct().count() == 20000
    assert out.where("n_ip <> 1").isEmpty()
    assert pii.pseudonymise(ips, "other").join(out.select("doc_id", F.col("text").alias("t2")), "doc_id").where("text = t2").count() < 5


def test_pii_links_however_it_is_written(spark):
    texts = ["+1 (988) 555-2485", "(988) 555-2485", "988-555-2485", "017-555-7713", "+1 (017) 155-7713"]
    new = [r["text"] for r in pii.pseudonymise(docs(spark, *texts), "k").orderBy("doc_id").collect()]
    digits = [re.sub("[^0-9]", "", x)[-10:] for x in new]
    assert digits[0] == digits[1] == digits[2] and [re.sub("[0-9]", "9", x) for x in new[1:]] == [re.sub("[0-9]", "9", x) for x in texts[1:]]
    assert [(d[0] > "1", d[3] > "1") for d in digits] == [(True, True)] * 3 + [(False, True), (False, False)]
    ips = spark.range(400_000).select(F.col("id").alias("doc_id"), F.concat_ws(".", *(F.pmod(F.xxhash64("id", F.lit(i)), F.lit(256)).cast("string") for i in range(4))).alias("text")).dropDuplicates(["text"])
    assert pii.pseudonymise(ips, "k").select("text").distinct().count() == ips.count()


def test_pii_leading_zeros_and_case(spark):
    texts = ["010.0.0.1 10.0.0.1 0.0.0.0 1.2.3.04", "Bob.Ab-42@X.com", "bob.ab-42@x.com", "BOB.AB-42@x.com"]
    new = [r["text"] for r in pii.pseudonymise(docs(spark, *texts), "k").orderBy("doc_id").collect()]
    ips = new[0].split()
    assert ips[0] == "010.0.0.1" and ips[3] == "1.2.3.04" and ips[1] != "10.0.0.1" and ips[2] != "0.0.0.0"
    assert new[1] != texts[1] and {x.lower() for x in new[1:]} == {new[2]} and [c.isupper() for c in new[1]] == [c.isupper() for c in texts[1]]


def test_pii_of_long_runs(spark):
    runs = ["a" * 2_000_000 + " 7", "7" * 2_000_000, "a." * 500_000 + "@", "a@" * 500_000, "a@" + "b." * 500_000, "x" * 500_000 + "@b.com", "7" * 100 + "-" * 500_000]
    rows = pii.pseudonymise(docs(spark, *runs), "k").orderBy("doc_id").collect()
    assert [len(r["text"]) for r in rows] == [len(x) for x in runs]
    assert rows[5]["n_email"] == 1


# Secrets


def brute_spans(text):
    found = []
    for rank, r in enumerate(secrets.RULES):
        for m in re.finditer(r.pattern, text, re.I | re.A if r.nocase else re.A):
            if len(m[r.group]) >= r.least:
                found.append((m.start(), rank, f"{r.kind}:{m.start()}:{m.end()}"))
    return [x for _, _, x in sorted(found)]


def test_secrets_brute_force(spark):
    r = random.Random(5)
    bits = ["password", "PASSWD", "Token", "api_key", "ApiKey", "secret", "=", ":", " ", '"', "'", "abcdefgh", "0123456789abcdef" * 2, "AKIA", "ABCDEFGHIJ12", "é😀", "\n", "ghp_" + "a1" * 18, "xoxb-1234567890", "-----BEGIN RSA PRIVATE KEY-----", "x"]
    texts = ["".join(r.choice(bits) for _ in range(r.randrange(25))) for _ in range(400)] + ["token: secret : abcdefghij", "token=token=abcdefgh1", "AKIA" * 9, "a" * 40 + "g" + "b" * 31]
    rows = secrets.digests(secrets.scan(docs(spark, *texts), block=64)).collect()
    assert len(rows) == len(texts)
    for row in rows:
        every = brute_spans(texts[row["doc_id"]])
        base = [x for x in every if x.split(":")[0] in ("assign", "access", "hex")]
        assert row["spans"] == ",".join(every)
        assert row["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [row[f"n_{k}"] for k in ("assign", "access", "hex")] == [sum(x.startswith(k + ":") for x in base) for k in ("assign", "access", "hex")]


def holds(query, text):
    if query is True:
        return True
    if isinstance(query, str):
        return query in text.lower()
    return (all if query[0] == "and" else any)(holds(q, text) for q in query[1])


def test_trigram_queries_admit_every_match():
    samples = {"assign": 'Api_Key" : \'abcdefgh1', "access": "AKIAABCDEFGHIJKL", "github": "ghs_" + "x" * 36, "slack": "xoxr-1234567890", "stripe": "rk_live_" + "a" * 16, "google": "AIza" + "b" * 35, "jwt": "eyJ" + "a" * 8 + ".eyJ" + "b" * 8 + "." + "c" * 8, "private_key": "-----BEGIN PRIVATE KEY-----"}
    for r in secrets.RULES:
        q = secrets.trigram_query(r.asks or r.pattern)
        assert (q is True) == (r.kind == "hex")
        if r.kind in samples:
            assert re.search(r.pattern, samples[r.kind], re.I if r.nocase else 0)
            assert holds(q, samples[r.kind])
            assert not holds(q, "nothing of the sort")


def test_redaction(spark):
    d = docs(spark, "é password=abcdefgh12 and AKIAABCDEFGHIJKLMN.", "clean").withColumn("n_chars", F.length("text").cast("bigint"))
    rows = secrets.redact(d).orderBy("doc_id").collect()
    assert [r["text"] for r in rows] == ["é [SECRET] and [SECRET].", "clean"]
    assert [r["n_chars"] for r in rows] == [24, 5]


def brute_redact(text):
    out, at = [], 0
    for r in sorted((int(a), int(b)) for a, b in (x.split(":")[1:] for x in brute_spans(text))):
        if r[0] >= at:
            out.append(text[at : r[0]] + "[SECRET]")
        at = max(at, r[1])
    return "".join(out) + text[at:]


def test_redaction_brute_force(spark):
    r = random.Random(6)
    bits = ["password=", "token:", "0123456789abcdef" * 2, "AKIA" + "Z9" * 8, "é😀", " ", "\n", "q" * 511, "xoxb-1234567890"]
    texts = ["".join(r.choice(bits) for _ in range(r.randrange(40))) for _ in range(200)]
    rows = secrets.redact(docs(spark, *texts)).collect()
    assert len(rows) == len(texts)
    assert all(row["text"] == brute_redact(texts[row["doc_id"]]) for row in rows)


def test_secrets_of_a_long_listing(spark):
    """Time is linear in the matches of one text."""
    text = "\n".join(f"{i:064x}  file{i}.bin password=é{i}abcdefgh" for i in range(60_000))
    d = docs(spark, text, text[:1000])
    found = {row["doc_id"]: row for row in secrets.digests(secrets.scan(d)).collect()}
    assert found[0]["n_hex"] == 60_000
    assert found[0]["spans"] == ",".join(brute_spans(text))
    made = {row["doc_id"]: row["text"] for row in secrets.redact(d).collect()}
    assert made == {0: brute_redact(text), 1: brute_redact(text[:1000])}


def test_secrets_of_runs_that_begin_again_and_again(spark):
    """A megabyte of what looks like starts of a rule's match."""
    starts = {"jwt": "eyJ", "github": "ghp_", "slack": "xoxb-", "stripe": "sk_live_", "google": "AIza", "access": "AKIA", "assign": "password", "key": "-----BEGIN ", "hex": "0123456789abcdef0123456789abcde-", "parts": "eyJabcdefgh.", "tail": "eyJabcdefgh.eyJ"}
    texts = [x * (1_000_000 // len(x)) + y for x in starts.values() for y in ("", " .eyJ", " = ")]
    began = time.monotonic()
    found = {r["doc_id"]: r["spans"] for r in secrets.digests(secrets.scan(docs(spark, *texts))).collect()}
    assert secrets.redact(docs(spark, *texts)).count() == len(texts)
    assert time.monotonic() - began < 120
    assert found[0] == ""


def test_jwt_rule_as_one_anchored_search(spark):
    r, plain = random.Random(3), re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")
    texts = ["".join(r.choice(["eyJ", "abcdefgh", ".", "a-_9", " ", "eyJabcdefgh", "."]) for _ in range(r.randrange(25))) for _ in range(400)]
    rows = secrets.scan(docs(spark, *texts), tuple(x for x in secrets.RULES if x.kind == "jwt")).collect()
    assert {row["doc_id"]: [(x["start"], x["ends_at"]) for x in row["found"]] for row in rows} == {i: [m.span() for m in plain.finditer(t)] for i, t in enumerate(texts)}


# Passages


def test_passages_fuzzy_and_shared(spark):
    shared = words(70, 9)
    fuzzy = shared[:20] + ["new"] + shared[22:45] + shared[46:]
    texts = [" ".join(words(100, 100 + i) + (shared if i % 3 else fuzzy) + words(80, 200 + i)) for i in range(12)] + [" ".join(words(300, 300 + i)) for i in range(10)]
    rows = passages.passages(docs(spark, *texts)).orderBy("doc_id").collect()
    assert [r["doc_id"] for r in rows] == list(range(1, 12))
    for r in rows:
        assert r["source_doc_id"] < r["doc_id"]
        assert abs(r["start_word"] - 100) <= 3 and abs(r["end_word"] - 170) <= 4
        assert r["similarity"] >= 0.8
    left = passages.drop_passages(docs(spark, *texts)).orderBy("doc_id").collect()
    assert left[0]["text"] == texts[0] and left[15]["text"] == texts[15]
    assert all(175 <= len(r["text"].split()) <= 188 for r in left[1:12])


def test_passages_split_between_sources(spark):
    a, b = words(34, 1, 10**6), words(34, 2, 10**6)
    texts = [" ".join(words(60, 10, 10**6) + a), " ".join(b + words(60, 11, 10**6)), " ".join(words(50, 12, 10**6) + a + b + words(50, 13, 10**6))]
    rows = passages.passages(docs(spark, *texts)).collect()
    assert [(r["doc_id"], r["n_sources"]) for r in rows] == [(2, 2)]
    assert (rows[0]["start_word"], rows[0]["end_word"]) == (50, 118)


def test_passages_of_lines_from_many_documents(spark):
    texts, wanted = [], set()
    for i in range(15):
        size = (19, 13, 11)[i % 3]
        lines = [words(size, 1000 * i + j, 10**6) for j in range(-(-55 // size))]
        texts += [" ".join(words(30, f"{i} {j} a", 10**6) + x + words(30, f"{i} {j} b", 10**6)) for j, x in enumerate(lines)]
        shared = [x for line in lines for x in line]
        texts += [" ".join(words(60, f"{i} {j} c", 10**6) + shared + words(60, f"{i} {j} d", 10**6)) for j in range(2)]
        wanted.add((len(texts) - 1, 60, 60 + len(shared)))
    rows = passages.passages(docs(spark, *texts)).collect()
    assert wanted <= {(r["doc_id"], r["start_word"], r["end_word"]) for r in rows}


def test_passages_with_every_seventh_word_changed(spark):
    texts = []
    for i in range(40):
        shared = words(60, f"{i} shared", 10**6)
        texts.append(" ".join(words(60, f"{i} a", 10**6) + shared + words(60, f"{i} b", 10**6)))
        texts.append(" ".join(words(60, f"{i} c", 10**6) + [f"new{j}" if j % 7 == 6 else x for j, x in enumerate(shared)] + words(60, f"{i} d", 10**6)))
    rows = passages.passages(docs(spark, *texts)).collect()
    assert all(abs(r["start_word"] - 60) <= 8 and abs(r["end_word"] - 120) <= 8 for r in rows)
    assert len({r["doc_id"] for r in rows}) >= 39


@pytest.mark.parametrize(("kind", "least"), [("put in", 39), ("left out", 38), ("mixed", 38)])
def test_passages_with_words_moved(spark, kind, least):
    """A word put in, left out or either or replaced, at each seventh place."""
    texts = []
    for i in range(40):
        shared = words(60, f"{i} shared", 10**6)
        new = [f"new{i} {j}".replace(" ", "x") for j in range(60)]
        ways = {"put in": lambda j, x: [x, new[j]], "left out": lambda j, x: [], "mixed": lambda j, x: ([new[j]], [], [new[j], x])[j // 7 % 3]}  # noqa: B023
        changed = [y for j, x in enumerate(shared) for y in (ways[kind](j, x) if j % 7 == 6 else [x])]
        texts.append(" ".join(words(60, f"{i} a", 10**6) + shared + words(60, f"{i} b", 10**6)))
        texts.append(" ".join(words(60, f"{i} c", 10**6) + changed + words(60, f"{i} d", 10**6)))
        end = 60 + len(changed)
        texts[-1] = (texts[-1], end)
    ends = [t[1] if isinstance(t, tuple) else None for t in texts]
    rows = passages.passages(docs(spark, *(t[0] if isinstance(t, tuple) else t for t in texts))).collect()
    assert all(r["doc_id"] % 2 and abs(r["start_word"] - 60) <= 8 and abs(r["end_word"] - ends[r["doc_id"]]) <= 8 for r in rows)
    assert len({r["doc_id"] for r in rows}) >= least


def test_namesakes_keep_their_own_words(spark):
    """Rows that share an id, or have none, are cut and dropped by their own text alone."""
    p, other, more = (" ".join(words(n, s, 10**6)) for n, s in ((80, "p"), (120, "other"), (30, "more")))
    rows = [(1, p), (2, f"{more} {p}"), (2, other), (None, p), (None, other), (None, f"x {more}")]
    frame = spark.createDataFrame(rows, DOCS).withColumn("meta.x", F.lit(1))
    made = passages.drop_passages(frame)
    assert made.columns == frame.columns
    # the passage stays with document 1; other and more stay with the namesakes of id 2
    assert sorted(((r["doc_id"], r["text"].strip()) for r in made.collect()), key=str) == sorted([(1, p), (2, more), (2, other), (None, f"x {more}")], key=str)
    found = passages.passages(frame).collect()
    assert sorted((str(r["doc_id"]), r["source_doc_id"], r["n_words"]) for r in found) == [("2", 1, 80), ("None", 1, 80), ("None", 2, 120)]
    first = simhash.keep_first(spark.createDataFrame([*rows, (None, p), (None, other), (7, "a b c d e f g"), (None, "a b c d e f g")], DOCS).withColumn("meta.x", F.lit(1)))
    assert sorted((str(r["doc_id"]), r["text"]) for r in first.collect()) == sorted([("1", p), ("2", f"{more} {p}"), ("2", other), ("None", f"x {more}"), ("7", "a b c d e f g")])


def test_passages_against_all_pairs(spark):
    """The whole query against a comparison of all pairs of 200 documents on all diagonals."""
    r = random.Random(12)
    texts: list[list[str]] = []
    for i in range(200):
        text = words(r.randrange(30, 160), f"doc {i}", 300)
        for _ in range(r.randrange(3) if i else 0):
            of = r.choice(texts)
            at, size = r.randrange(len(of)), r.randrange(40, 90)
            copy = [x if r.random() > 0.03 else f"w{r.randrange(300)}" for x in of[at : at + size]]
            place = r.randrange(len(text))
            text[place:place] = copy
        texts.append(text)
    spans: dict = {}
    for row in passages.passages(docs(spark, *map(" ".join, texts))).collect():
        spans.setdefault(row["doc_id"], []).append((row["start_word"], row["end_word"]))
        assert row["source_doc_id"] < row["doc_id"] and row["n_words"] >= 50
        if row["n_sources"] == 1:
            a, b = texts[row["doc_id"]][row["start_word"] : row["end_word"]], texts[row["source_doc_id"]][row["source_start"] : row["source_end"]]
            assert passages.common_words(a, b) >= 0.8 * max(len(a), len(b)) - 5
    code = {w: n for n, w in enumerate(sorted({w for t in texts for w in t}))}
    coded = [np.array([code[w] for w in t]) for t in texts]
    found = total = 0
    for j, b in enumerate(coded):
        for a in coded[:j]:
            for d in range(60 - len(a), len(b) - 59):
                x, y = max(0, d), max(0, -d)
                n = min(len(b) - x, len(a) - y)
                sums = np.concatenate([[0], np.cumsum(b[x : x + n] == a[y : y + n])])
                for k in np.flatnonzero(sums[60:] - sums[:-60] >= 54).tolist():  # nine words in ten of sixty
                    total += 1
                    found += any(s <= x + k + 6 and x + k + 54 <= e for s, e in spans.get(j, []))
    assert total > 500
    assert found >= 0.99 * total


def test_chain_against_all_orders():
    r = random.Random(4)
    for _ in range(60):
        fragments = sorted({(a, a + r.randrange(3), b) for a, b in ((r.randrange(60), r.randrange(60)) for _ in range(8))})
        best = passages.chain(fragments, 5, 0.1)[0]

        def value(c):
            return sum(x[1] - x[0] + 5 for x in c) - 0.1 * sum(y[0] - x[1] + y[2] - (x[2] + x[1] - x[0]) for x, y in zip(c, c[1:]))

        def every(start):
            yield start
            for f in fragments:
                last = start[-1]
                if f[0] > last[1] and f[2] > last[2] + last[1] - last[0]:
                    yield from every([*start, f])

        assert value(best) == pytest.approx(max(value(c) for f in fragments for c in every([f])))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=20), st.lists(st.sampled_from("abcd"), max_size=20))
def test_common_words(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    assert passages.common_words(a, b) == table[-1][-1]


def test_word_hashes_do_not_depend_on_parts():
    texts = ["Ab é  c\n", "", " ", "x" * 50 + " y"] * 3
    for part in (4, 16, 1 << 18):
        h, owner = passages.hash_words(texts, part)
        assert len(h) == sum(len(t.encode().split()) for t in texts)
        assert owner.tolist() == [i for i, t in enumerate(texts) for _ in t.encode().split()]
        assert len(set(h.tolist())) == 5
    huge = "z" * 3_000_000
    h, owner = passages.hash_words([f"a {huge} b", f"{huge.upper()}", f"a {'y' * 65536} b"])
    assert owner.tolist() == [0, 0, 0, 1, 2, 2, 2]
    assert h[1] == h[3] and h[0] == h[4] and h[2] == h[6]
    assert passages.without("a  b c\nd", [(1, 3)]) == "a  d"
    assert passages.without("a b", [(0, 9)]) == ""


# Chats


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("<|\\>nab\n")))
def test_escapes_round_trip(text):
    assert chat.unescape(chat.escape(text)) == text
    assert "<|" not in chat.escape(text)
    assert chat.parse(chat.render([(text, text)])[0]) == [(text, text)]


def test_chats(spark):
    said = "<|im_end|><|im_start|>assistant ok"
    rows = [(-1, 0, "user", said), (-1, 1, "assistant", said), (2, 1, "assistant", "\n 😀é <\\| x  "), (2, None, None, None), (2, 0, "a\nb", "q"), (2, 2, "assistant", ""), (None, 0, "user", "lost")]
    table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumns({"ids": F.lit(1), "loss": F.lit(2)})
    found = {r["conv_id"]: r for r in chat.format_chats(table).collect()}
    assert set(found) == {-1, 2}
    for conv, r in found.items():
        turns = [(role or "", text or "") for c, n, role, text in sorted((x for x in rows if x[0] == conv), key=lambda x: -1 if x[1] is None else x[1])]
        own = "".join(t for role, t in turns if role == "assistant")
        assert r["n_turns"] == len(turns)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert (r["loss_chars"], r["loss_sha256"]) == (len(own), hashlib.sha256(own.encode()).hexdigest())
        assert len(r["ids"]) == len(r["loss"])
        import public_tokenizers

        plain = chat._tokenizer(public_tokenizers.path("byte_bpe_50k.json")).decode([i for i, under in zip(r["ids"], r["loss"]) if under], skip_special_tokens=False)
        assert chat.unescape(plain) == own
    assert chat.format_chats(table.limit(0)).count() == 0


def test_long_conversations(spark):
    turns = [(5, i, ("user", "assistant")[i % 2], f"turn {i}. ") for i in range(30_000)] + [(6, 0, "assistant", " " * 1_000_000 + "x"), (6, 1, "assistant", "a" * 1_000_000)]
    found = {r["conv_id"]: r for r in chat.format_chats(spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string")).collect()}
    own = "".join(x[3] for x in turns[:30_000] if x[2] == "assistant")
    assert (found[5]["n_turns"], found[5]["loss_sha256"]) == (30_000, hashlib.sha256(own.encode()).hexdigest())
    assert found[6]["loss_chars"] == 2_000_001


def test_whole_groups():
    import pyarrow as pa

    from lexspan.llm.common import whole_groups

    keys = [0] * 3 + [1] * 50 + [2] * 2 + [3] * 20 + [4]
    for size in (1, 2, 7, 100):
        batches = [pa.record_batch({"k": keys[i : i + size], "n": list(range(len(keys)))[i : i + size]}) for i in range(0, len(keys), size)]
        found = list(whole_groups(iter(batches)))
        assert [x for k, n in found for x in zip(k.tolist(), n.tolist())] == list(zip(keys, range(len(keys))))
        assert sum(len(set(k.tolist())) for k, _ in found) == 5


# Vectors


def test_neighbours_recall_and_cases(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 32))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5050, [0.0] * 32), (5100, [float("nan")] * 32), (5150, [None] * 32), (5200, [1.0]), (None, x[0].tolist()), (7, x[7].tolist()), (6000, x[100].tolist()), (6001, x[100].tolist())]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumns({c: F.lit(1) for c in ("label", "v", "q", "part", "lead", "slice", "side", "code", "query_id", "rank", "score")})
    found: dict = {}
    for r in ann.search(table, most=100).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    ids = np.array([*range(3000), 6000, 6001])
    all_x = np.vstack([x, x[100], x[100]])
    unit = all_x / np.linalg.norm(all_x, axis=1, keepdims=True)
    hit = 0
    assert sorted(found) == [i for i in range(3000) if i % 50 == 0] + [6000]
    for q, got in found.items():
        at = int(np.flatnonzero(ids == q)[0])
        s = unit @ unit[at]
        s[at] = -9
        best = np.lexsort((ids, -np.round(s, 12)))[:5]
        hit += len({v for _, v, _ in got} & set(ids[best].tolist()))
        assert [r for r, _, _ in sorted(got)] == [1, 2, 3, 4, 5]
    assert hit >= 0.9 * 5 * len(found)
    assert [v for _, v, _ in sorted(found[100])[:2]] == [6000, 6001]
    assert [v for _, v, _ in sorted(found[6000])[:2]] == [100, 6001]
    assert ann.search(table.limit(0)).count() == 0
    few = spark.createDataFrame([(i, x[i].tolist()) for i in (0, 1, 2, 50)], "vec_id bigint, embedding array<double>")
    rows = ann.search(few).collect()
    assert sorted((r["query_id"], r["rank"]) for r in rows) == [(0, 1), (0, 2), (0, 3), (50, 1), (50, 2), (50, 3)]
    assert ann.search(few.limit(1)).count() == 0


def test_probing_is_exact():
    rng = np.random.default_rng(1)
    coder = ann.Coder(np.zeros(64), np.zeros((8, 64, 64)))
    codes = rng.integers(0, 256, size=(700, 64), dtype=np.uint8)
    near = np.bitwise_count(codes[:20, None, :16] ^ codes[None, :, :16]).sum(axis=2)
    whole = np.bitwise_count(codes[:20, None, :] ^ codes[None, :, :]).sum(axis=2)
    for radius in (0, 15, 40, 52, 63, 128):
        met = [(int(a), int(b)) for part in range(16) for a, b in zip(*ann.meet(codes[:20], codes, coder, part, radius, 250))]
        assert len(met) == len(set(met))
        assert set(met) == {(int(a), int(b)) for a, b in zip(*np.nonzero((near <= radius) & (whole <= 250)))}


def test_like_vectors_in_slices(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([np.repeat(rng.normal(size=(1, 16)), 400, axis=0), rng.normal(size=(800, 16))])
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>")
    rows = ann.search(table, every=100, most=50).collect()
    for q in (0, 100, 200, 300):
        assert [r["vec_id"] for r in sorted(rows, key=lambda r: r["rank"]) if r["query_id"] == q] == [i for i in range(6) if i != q][:5]
    assert len(rows) == 12 * 5


# Packing


def test_best_fit_decreasing():
    r = random.Random(1)
    for window in (7, 16, 100):
        lengths = [r.randint(1, window) for _ in range(300)]
        open_: list[int] = []
        for n in sorted(lengths, reverse=True):
            fits = [i for i, room in enumerate(open_) if room >= n]
            if fits:
                open_[min(fits, key=lambda i: open_[i])] -= n
            else:
                open_.append(window - n)
        placed = packing.best_fit_decreasing(lengths, window)
        assert 1 + max(a for a, _ in placed) == len(open_)
        used = Counter()
        for n, (a, at) in sorted(zip(lengths, placed), key=lambda x: x[1]):
            assert used[a] == at
            used[a] += n
        assert max(used.values()) <= window


@tables
def test_packing_against_tokenizers(spark, small):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    d = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(10**6, "a <|endoftext|>  b   c \n\n d"), (10**6 + 1, None)], DOCS))
    texts = {r["doc_id"]: r["text"] or "" for r in d.collect()}
    by, by_sequence = {}, {}
    for r in packing.pack(d).collect():
        by.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert set(by) == set(texts)
    for doc, rows in by.items():
        ids = np.array([*t.encode(texts[doc], add_special_tokens=False).ids, 1], dtype="<u4")
        at = 0
        for r in sorted(rows, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for rows in by_sequence.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048


def test_packing_of_long_runs():
    import public_tokenizers
    from tokenizers import Tokenizer

    encode, t, r = packing.rank_encoder(), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), random.Random(1)
    bits = [" ", "\n", "a", "1", ".", "'s", "é", "\u2003", "<|endoftext|>", "\x1c", "\x85"]
    for _ in range(150):
        text = "".join(r.choice(bits) * r.choice([1, 1, 2, 1100]) for _ in range(r.randrange(9)))
        assert encode(text).tolist() == t.encode(text, add_special_tokens=False).ids
    for run in (" ", "\n", "a", "7"):
        assert len(encode(run * 5_000_000 + "x")) > 10**5


# Byte BPE


@pytest.fixture(scope="module")
def coder():
    import public_tokenizers

    return bpe.ByteBpe(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, chunk=40, overlap=8)


@pytest.fixture(scope="module")
def plain():
    import base64

    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


@settings(max_examples=300, deadline=None)
@given(text=st.text(st.one_of(st.sampled_from(" \t\n'sl12éß漢😀. "), st.characters(max_codepoint=0x2FF, exclude_categories=("Cs",))), max_size=300))
def test_chunked_encoding(coder, plain, text):
    ids, n, chunks = coder.encode(text)
    assert ids.tolist() == plain(text)
    assert coder.decode(ids) == text.encode()
    assert n == len(coder.findall(text))
    assert chunks == max(1, -(-len(text) // 40))


def test_a_full_cache_changes_nothing(plain):
    import public_tokenizers

    made = bpe.ByteBpe(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, cache=5)
    for i in range(120):
        text = " ".join(words(7, i, 30))
        assert made.encode(text)[0].tolist() == plain(text)
        assert len(made.cache) <= 5


def test_long_runs(coder, plain):
    for text in (" " * 500 + "a", " a" * 300, "a b" + " " * 90 + "c d" * 50, "x" * 200 + " y z" * 40 + "\n" * 100 + "q", "a" * 500, "\n \n" * 200, "'s" * 200, "x" * 39 + "  " + "y" * 60):
        assert coder.encode(text)[0].tolist() == plain(text)
    r = random.Random(2)
    for _ in range(1500):
        text = "".join(r.choice(" \t\n'sl1é漢😀.") * r.choice([1, 1, 1, 2, 3, 20, 60]) for _ in range(r.randrange(120)))
        assert coder.encode(text)[0].tolist() == plain(text)


@tables
def test_chunks_dealt_to_tasks(spark, small, plain):
    d = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(None, "a " * 900), (2**60 + 1, " " * 3_000_000 + "x"), (2**60 + 2, "ab" * 1_500_000)], DOCS))
    rows = {r["doc_id"]: r for r in bpe.encode_documents(d, chunk=256, overlap=32, share=2).collect()}
    assert len(rows) == d.count()
    for doc, text in d.collect():
        assert rows[doc]["n_chunks"] == max(1, -(-len(text) // 256))
        assert rows[doc]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        if doc is None or doc < 2**60:  # the reference overflows on the long runs
            ids = plain(text)
            assert (rows[doc]["n_tokens"], rows[doc]["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
    some = d.where("doc_id < 20")
    assert {r["doc_id"]: r["ids"] for r in bpe.tokens_of(some, chunk=64, share=1).collect()} == {r["doc_id"]: plain(r["text"]) for r in some.collect()}


# Quality rules


@pytest.mark.parametrize("line", ["Accueil > Plan du site", "Startseite Kontakt Über uns", "Inicio, Buscar, Iniciar sesión", "Tous droits réservés.", "Alle Rechte vorbehalten 2020", "© Todos los derechos reservados", "Impressum"])
def test_quality_terms_of_other_languages(line):
    assert quality.line_fails(line)
    assert not quality.line_fails(f"une phrase entière qui parle longuement de tout ce que dit {line} et de bien autre chose encore")


def brute_quality(text):
    found = [(m.start(), m[0]) for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
    ws = [w for _, w in found]
    threes = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
    covered = {i + j for i, t in enumerate(threes) if threes.count(t) > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text)), sum(x in lines[:i] for i, x in enumerate(lines)), len(covered)


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("ab \n\t\x0b\x1c\xa0é#|"), max_size=80))
def test_quality_brute_force(text):
    found, _ = quality.judge(text)
    assert found[:5] == brute_quality(text)


def test_line_rules():
    prose = "\n".join(" ".join(words(12, i)) + "." for i in range(8))
    found, left = quality.judge(prose + "\nHome | About | Contact | Help\nAll rights reserved.\n#### $$$$ %%%%")
    assert left == prose
    assert found[5:8] == (False, True, 3)
    assert quality.judge(prose)[1] == prose
    junk = "\n".join("Home | A | B | " + " ".join(words(12, i)) for i in range(8))
    assert quality.judge(junk)[0][5:7] == (False, False)


def test_good_lines_stay():
    good = ["New research was published today.", "Shareholders met on Monday.", "She went home.", "He read the privacy policy before lunch.", "We shared a search for home.", "Next week the register opens in town.", "Use a / b / c or d / e in the long formula of the third chapter, as was said before it."]
    assert not any(quality.line_fails(x) for x in good)
    bad = ["Home", "Home | News | About us | Next", "Sign in / Register", "» Home » News » Next", "All rights reserved.", "Copyright © 2020 A. Person. All rights reserved.", "We use cookies.", "Skip to content", "(Read more)", "Lorem ipsum dolor", "home home"]
    assert all(quality.line_fails(x) for x in bad)
    prose = words(800, 7)
    for more in ("privacy policy", "unsubscribe", "a / b / c / d", "All rights reserved.", "home", "> > >"):
        found, left = quality.judge(" ".join(prose[:400] + [more] + prose[400:]))
        assert found[6] and found[7] == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*"|/>", "home", "Home.", "sign", "in", "up", "(sign", "privacy", "policy", "policy.", "copyright", "©", "unsubscribe", "shareholders", "a", "b", "...", "!?"]), min_size=1, max_size=12))
def test_line_rules_brute_force(line):
    rules = quality.LineRules()
    bare = [x.lower().strip(quality.PUNCTUATION) for x in line]

    def inside(terms):
        total = 0
        for t in (t.split(" ") for t in terms):
            i = 0
            while i + len(t) <= len(bare):
                hit = bare[i : i + len(t)] == t
                total, i = total + hit * len(t), i + (len(t) if hit else 1)
        return total

    bars = sum(x in quality.BARS for x in line)
    punct = sum(c in quality.PUNCTUATION for x in line for c in x)
    want = bars >= 3 and 100 * bars >= 15 * len(line) or len(line) <= 6 and inside(quality.NAVIGATION) >= 0.5 * len(line) or 10 * inside(quality.BOILERPLATE) >= 3 * len(line) or punct >= 6 and 4 * punct > sum(map(len, line))
    assert quality.line_fails(" ".join(line), rules) == want


@tables
def test_clean_lines_stay(spark):
    """Of the lines of letters, commas and stops (no shouting, no symbols, no words of the lists), under one in a hundred fails."""
    lines = {x for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect() for x in r[0].split("\n")}
    plain = [x for x in lines if re.fullmatch(r"[^\W\d_]+([ ,.]+[^\W\d_]+)*\.?", x) and not x.isupper()]
    assert len(plain) > 1000
    assert sum(map(quality.line_fails, plain)) < 0.01 * len(plain)


def test_keep_good(spark):
    prose = " ".join(words(80, 3)) + "."
    d = spark.createDataFrame([(1, prose, 5), (2, "short", 5), (3, prose + "\nAll rights reserved.", 5)], "doc_id bigint, text string, n_chars int")
    assert [tuple(r) for r in quality.keep_good(d).orderBy("doc_id").collect()] == [(1, prose, len(prose)), (3, prose, len(prose))]


# SimHash


def brute_fingerprint(text):
    import xxhash

    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    ws = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not ws:
        return 0
    shingles = [" ".join(ws[i : i + 4]) for i in range(max(1, len(ws) - 3))]
    hs = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_fingerprints():
    for text in ("", " \n", "One", "a b c", "A b C D", "é A b c d É\x1ce", " ".join(words(200, 1))):
        assert simhash.fingerprint(text) == brute_fingerprint(text)


def clusters(n=900):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, n // 3, dtype=np.uint64)
    hot = base[0] ^ np.array([sum(1 << int(b) for b in rng.choice(64, 3, replace=False)) for _ in range(n // 3)], dtype=np.uint64)
    near = base ^ np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 7), replace=False)) for _ in base], dtype=np.uint64)
    return np.unique(np.concatenate([base, hot, near]))


def pairs(fps, radius=4):
    return {(i, i + 1 + int(j)) for i in range(len(fps)) for j in np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= radius)}


def test_bit_sliced_distances():
    fps = clusters(300)
    want = pairs(fps)
    lanes = np.unpackbits(simhash.near(fps, simhash.planes_of(fps), 4).view(np.uint8), axis=1, bitorder="little")[:, : len(fps)]
    assert {(int(a), int(b)) for a, b in zip(*np.nonzero(lanes)) if a < b} == want
    a, b = simhash.shifted_pairs(fps, np.zeros(len(fps), dtype=np.int64), 4, len(fps))
    assert set(zip(a.tolist(), b.tolist())) == want


@pytest.mark.parametrize("most", [4096, 40])
def test_components_of_fingerprints(spark, most):
    from lexspan.llm.common import Tables

    fps = clusters()
    nodes = np.random.default_rng(1).permutation(len(fps))
    table = spark.createDataFrame([(int(f.astype(np.int64)), int(n)) for f, n in zip(fps, nodes)], "fp bigint, node bigint")
    work = Tables(spark, "test")
    labels = {r["node"]: r["label"] for r in simhash.components(work.put("edges", simhash.near_links(table, work, most=most)), work).collect()}
    forest = simhash.Forest()
    for i, j in pairs(fps):
        forest.join(int(nodes[i]), int(nodes[j]))
    assert {int(n): labels.get(int(n), int(n)) for n in nodes} == {int(n): forest.root(int(n)) for n in nodes}


def test_components_of_a_path(spark):
    from lexspan.llm.common import Tables

    order = random.Random(2).sample(range(200), 200)
    edges = spark.createDataFrame(list(zip(order, order[1:])), "a bigint, b bigint")
    rows = simhash.components(edges, Tables(spark, "test")).collect()
    assert {r["node"] for r in rows} == set(range(200))
    assert {r["label"] for r in rows} == {0}


def test_groups(spark):
    a, b = " ".join(words(300, 1)), " ".join(words(300, 2))
    rows = simhash.groups(docs(spark, a, b, a.upper().replace("W", "w"), "", None)).orderBy("doc_id").collect()
    assert [r["component_id"] for r in rows] == [0, 1, 0, 3, 3]
    assert rows[3]["fingerprint"] == "0" * 16
    assert sorted(r["doc_id"] for r in simhash.keep_first(docs(spark, a, b, a)).collect()) == [0, 1]
    rows = [(1, a), (1, a), (1, a + " end"), (1, b), (2, a), (3, "x"), (3, "x"), (None, a), (None, None)]
    left = simhash.keep_first(spark.createDataFrame(rows, DOCS).withColumns({"key": F.lit(1), "h": F.lit("h")})).collect()
    # the text of document 1 without an id is a copy, the empty one has no other
    assert [r["text"] for r in left if r["doc_id"] is None] == [None]
    # id 1 has three texts, so document 2, whose id is its own, comes before its copies among them; the near copy may be within the radius or not
    assert sorted((r["doc_id"], r["text"] == "x") for r in left if r["doc_id"] is not None) in ([(1, False), (2, False), (3, True)], [(1, False), (1, False), (2, False), (3, True)])
