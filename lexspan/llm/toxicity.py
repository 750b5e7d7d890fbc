"""Toxicity: cumulative-link ordinal regression on sparse text features.

P(grade <= j) = sigmoid(theta_j - x.w), with one weight vector for all thresholds theta_0 < theta_1 < ...; the score is the
expected severity, the sum over j of P(grade > j). Features are the document's words (ASCII letters in lower case, without
outer ASCII punctuation) and their beginnings, weighing 1 + ln(count) for each word; the fitted ones are those that tell the
labels apart by chi-square.

The model is fitted on at most `sample` labelled rows (those of least hash of their id, so whatever their order); everything
else reads all rows. The labels of this corpus are 0/1, so training grades come from them: grade 0 is label 0; label 1 is graded
1 to `grades` - 1 by quantiles of the weight of its marked features, those that chi-square ties to label 1.

Cases: a null text is the empty one and scores as the model's floor; null labels are not used; several labels for one document
count as their greatest; of texts that share an id the least is learned from; with no labels of both kinds, every score is 0.0; repeated rows are scored each; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspan.llm.common import Tables, arrow, as_batch, id_text, rows_of

FIELDS = "doc_id long, expected_severity double, grade long, toxic boolean"
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("expected_severity", pa.float64()), ("grade", pa.int64()), ("toxic", pa.bool_())])
MIN_DOCS = 6
_EDGES = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def words_of(text: str) -> Counter:
    """Counts of words, ASCII letters in lower case, as bytes."""
    return Counter(text.encode().lower().split())


def features_of(word: bytes) -> tuple[str, ...]:
    """The word without outer punctuation, and its beginnings of three to five letters, which inflected forms share."""
    w = word.strip(_EDGES).decode()
    return (w, *("^" + w[:n] for n in (3, 4, 5) if len(w) >= n)) if w else ()


def vector_of(text: str) -> dict[str, float]:
    """The document's sparse features: a feature weighs the sum of 1 + ln(count) over the words that have it."""
    out: dict[str, float] = {}
    for word, n in words_of(text).items():
        for f in features_of(word):
            out[f] = out.get(f, 0.0) + 1 + math.log(n)
    return out


@dataclass
class OrdinalModel:
    weights: dict[str, float] = field(default_factory=dict)
    thresholds: list[float] = field(default_factory=list)

    def weight(self, word: bytes) -> float:
        get = self.weights.get
        return math.fsum(get(f, 0.0) for f in features_of(word))

    def score(self, text: str, cache: dict[bytes, float]) -> tuple[float, int, bool]:
        """(expected severity, most probable grade, whether a grade above 0 is likelier than not). The cache holds the weights
        of words seen before; it is emptied at 2^18."""
        if not self.thresholds:
            return 0.0, 0, False
        x = 0.0
        for word, n in words_of(text).items():
            w = cache.get(word)
            if w is None:
                if len(cache) >= 1 << 18:
                    cache.clear()
                w = cache[word] = self.weight(word)
            if w:
                x += w * (1 + math.log(n))
        above = [1 / (1 + math.exp(max(-700.0, min(700.0, t - x)))) for t in self.thresholds]
        steps = [1.0, *above, 0.0]
        return math.fsum(above), max(range(len(steps) - 1), key=lambda j: (steps[j] - steps[j + 1], -j)), above[0] > 0.5


def apart(features: list[dict], toxic: list[int], min_docs: int) -> dict[str, float]:
    """The signed chi-square statistic (2 x 2, by presence) of each feature that `min_docs` documents have; above 0: rather toxic."""
    n1, n0 = sum(map(bool, toxic)), sum(1 for t in toxic if not t)
    a, b = Counter(), Counter()
    for f, t in zip(features, toxic, strict=True):
        (a if t else b).update(f.keys())
    out = {}
    for w in a.keys() | b.keys():
        x, y = a[w], b[w]
        if x + y >= min_docs and n1 and n0 and x + y < n1 + n0:
            d = x * n0 - y * n1
            out[w] = math.copysign(d * d * (n1 + n0) / (n1 * n0 * (x + y) * (n1 + n0 - x - y)), d)
    return out


def grade_labels(features: list[dict], toxic: list[int], chi: dict[str, float], grades: int = 4, least: float = 20.0) -> list[int]:
    """Severity grades for 0/1 labels: label 0 is grade 0; label 1 is graded by quantiles of its marked features' weight."""
    marked = {w for w, x in chi.items() if x >= least}
    hits = [sum(n for w, n in f.items() if w in marked) if t else 0.0 for f, t in zip(features, toxic, strict=True)]
    order = sorted(h for h, t in zip(hits, toxic, strict=True) if t)
    cuts = [order[min(len(order) - 1, len(order) * j // (grades - 1))] for j in range(1, grades - 1)] if order else []
    return [1 + sum(bool(h >= c) for c in cuts) if t else 0 for h, t in zip(hits, toxic, strict=True)]


def fit(features: list[dict], grade: list[int], names: list[str], l2: float = 1e-3, rounds: int = 300) -> OrdinalModel:
    """Maximum likelihood with a ridge, by Adam on all rows at once, on the features named; thresholds stay ordered, as sums of
    positive steps."""
    top = max(grade, default=0)
    if not top or min(grade) > 0:
        return OrdinalModel()
    number = {w: i for i, w in enumerate(names)}
    rows, columns, values = [], [], []
    for i, f in enumerate(features):
        for w, x in f.items():
            if (j := number.get(w)) is not None:
                rows.append(i)
                columns.append(j)
                values.append(x)
    r, c, v = np.array(rows, dtype=np.int64), np.array(columns, dtype=np.int64), np.array(values)
    y, n, k = np.array(grade), len(grade), len(names)
    share = np.array([(y > j).mean() for j in range(top)])
    theta = -np.log(np.clip(share, 1e-4, 1 - 1e-4) / (1 - np.clip(share, 1e-4, 1 - 1e-4)))
    theta = np.maximum.accumulate(theta + 1e-3 * np.arange(top))
    params = np.concatenate([np.zeros(k), [theta[0]], np.log(np.maximum(np.diff(theta), 1e-3))])
    m, s = np.zeros_like(params), np.zeros_like(params)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -50, 50)))
    for step in range(1, rounds + 1):
        w, gaps = params[:k], np.exp(params[k + 1 :])
        theta = params[k] + np.concatenate([[0.0], np.cumsum(gaps)])
        x = np.bincount(r, weights=v * w[c], minlength=n)
        ends = np.concatenate([[-np.inf], theta, [np.inf]])
        hi, lo = sigmoid(ends[y + 1] - x), sigmoid(ends[y] - x)
        hi, lo = np.where(y == top, 1.0, hi), np.where(y == 0, 0.0, lo)
        p = np.maximum(hi - lo, 1e-12)
        dhi, dlo = hi * (1 - hi) / p, lo * (1 - lo) / p  # of log p, by the upper and the lower end
        dx = (dhi - dlo) / n  # of the mean loss, by x
        dtheta = np.array([(dlo[y == j + 1].sum() - dhi[y == j].sum()) / n for j in range(top)])
        grad = np.concatenate([np.bincount(c, weights=v * dx[r], minlength=k) + l2 * w, [dtheta.sum()], np.cumsum(dtheta[::-1])[::-1][1:] * gaps])
        m, s = 0.9 * m + 0.1 * grad, 0.99 * s + 0.01 * grad * grad
        params = params - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
    theta = params[k] + np.concatenate([[0.0], np.cumsum(np.exp(params[k + 1 :]))])
    return OrdinalModel({w: float(x) for w, x in zip(names, params[:k], strict=True)}, theta.tolist())


def learn(texts: list[str], toxic: list[int], grades: int = 4, vocabulary: int = 1 << 14, min_docs: int = MIN_DOCS, least: float = 12.0) -> OrdinalModel:
    """Chooses the features of greatest chi-square (`least` or more, at most `vocabulary`), grades the labels, and fits."""
    features = [vector_of(x) for x in texts]
    chi = apart(features, toxic, min_docs)
    names = sorted((w for w, x in chi.items() if abs(x) >= least), key=lambda w: (-abs(chi[w]), w))[:vocabulary]
    return fit(features, grade_labels(features, toxic, chi, grades), names)


def counted(docs: DataFrame) -> DataFrame:
    """(doc_id, feature, value) of the features of each document."""
    schema = pa.schema([("doc_id", pa.int64()), ("feature", pa.string()), ("value", pa.float64())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in rows_of(batches):
            for key, text in zip(keys, texts, strict=True):
                found = vector_of(text)
                yield as_batch(schema, [key] * len(found), list(found), list(found.values()))

    return arrow(docs.select("doc_id", "text"), task, "doc_id long, feature string, value double")


def train(docs: DataFrame, labels: DataFrame, sample: int = 4000, grades: int = 4, vocabulary: int = 1 << 14, least: float = 12.0) -> OrdinalModel:
    """Fits on at most `sample` labelled documents, half of either label as far as there are so many, and on the `vocabulary` features that tell the labels apart
    best. Features are counted and chosen by the executors; the driver gets the chosen ones' numbers, never a text."""
    by = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    half = [by.where(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample // 2) for t in (0, 1)]
    picked = half[0].unionByName(half[1])
    work = Tables(docs.sparkSession, "toxicity")
    rows = work.put("picked", id_text(docs).join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")))
    toxic = {r["doc_id"]: r["toxic"] for r in rows.select("doc_id", "toxic").collect()}
    found = work.put("features", counted(rows).join(rows.select("doc_id", "toxic"), "doc_id"))
    chi = {r["feature"]: r["chi"] for r in _apart(found, toxic.values()).where(F.abs("chi") >= least).orderBy(F.desc(F.abs("chi")), "feature").limit(vocabulary).collect()}
    features: dict[int, dict] = {k: {} for k in sorted(toxic)}
    # no more than `sample` times `vocabulary` numbers, however long the texts are
    chosen = found.join(F.broadcast(docs.sparkSession.createDataFrame(pd.DataFrame({"feature": list(chi)}), "feature string")), "feature")
    for r in chosen.select("doc_id", "feature", "value").toArrow().sort_by([("doc_id", "ascending"), ("feature", "ascending")]).to_pylist():
        features[r["doc_id"]][r["feature"]] = r["value"]
    work.drop()
    rows, labelled = list(features.values()), [toxic[k] for k in features]
    return fit(rows, grade_labels(rows, labelled, chi, grades), list(chi))


def _apart(found: DataFrame, labels) -> DataFrame:
    """(feature, chi) of found(doc_id, feature, toxic), as apart() gives it."""
    n1, n0 = sum(map(bool, labels)), sum(not x for x in labels)
    by = found.groupBy("feature").agg(F.count_if(F.col("toxic") > 0).cast("double").alias("x"), F.count_if(F.col("toxic") == 0).cast("double").alias("y"))
    n, d = F.col("x") + F.col("y"), F.col("x") * n0 - F.col("y") * n1
    rows = by.where((n >= MIN_DOCS) & F.lit(n1 > 0 and n0 > 0) & (n < n1 + n0))
    return rows.select("feature", (F.signum(d) * d * d * (n1 + n0) / (float(max(1, n1 * n0)) * n * (n1 + n0 - n))).alias("chi"))


def score(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """One row a document: the expected severity, the most probable grade, and whether that grade is above 0. The model goes to
    the workers with the task: its size is bounded by the vocabulary."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[bytes, float] = {}
        for keys, texts in rows_of(batches):
            yield as_batch(_SCHEMA, keys, *zip(*(model.score(x, cache) for x in texts), strict=True))

    return arrow(id_text(docs), task, FIELDS)
