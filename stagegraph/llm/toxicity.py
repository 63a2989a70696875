"""Toxicity: cumulative-link ordinal regression on sparse word features.

P(severity <= j) = sigmoid(theta_j - w . x): one weight vector for all grades, and ordered thresholds. A document's expected severity
is the sum over j of P(severity > j).

The model is fitted on a bounded sample of labelled documents (at most ``MOST``, by a hash of the id). In it,

* the vocabulary is every word of which a smoothed log-odds ratio of toxic against clean documents lies above ``LEAST`` even at its lower
  bound (``Z`` standard errors), in ``SUPPORT`` toxic documents at least; more labels make the bound tighter, not the measure larger;
* a document's grade comes from both its labels, and from no feature: 0 neither toxic nor of low quality, 1 of low quality, 2 toxic.

Everything else reads every document. ``x`` holds log(1 + count) of each word of the vocabulary.

Defined cases: a null or empty text has no features, so its severity is that of the intercept; labels whose toxic or doc_id is null, or
that belong to no document, are left out, a null quality is not low; a doc_id with several labels counts each; with no toxic or no clean
label nothing is toxic; repeated rows each have their row; an empty table gives an empty result; further columns are ignored; a text of
any length is read whole.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stagegraph.llm.common import arrow_schema, pieces, record, table

MOST = 20_000
LEAST, Z, SUPPORT = 1.5, 1.64, 3
GRADES = 2  # above clean; the last is toxic
_WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


class OrdinalModel:
    """Weights by word, and thresholds in ascending order."""

    def __init__(self, vocabulary: dict[str, int], weights: np.ndarray, thresholds: np.ndarray):
        self.vocabulary, self.weights, self.thresholds = vocabulary, weights, thresholds

    def scores(self, rows: list[tuple[list[int], list[float]]]) -> np.ndarray:
        return np.array([float(np.dot(self.weights[i], v)) if i else 0.0 for i, v in rows])

    def above(self, rows) -> np.ndarray:
        """P(severity > j) for each row and threshold."""
        return 1 / (1 + np.exp(-np.clip(self.scores(rows)[:, None] - self.thresholds[None, :], -50, 50)))

    def features(self, text: str | None) -> tuple[list[int], list[float]]:
        known = self.vocabulary
        counts = Counter(known[w] for w in words(text) if w in known)
        return list(counts), [float(np.log1p(c)) for c in counts.values()]


def fit(vocabulary: dict[str, int], rows: list[tuple[list[int], list[float]]], grades: np.ndarray, n_grades: int | None = None, decay: float = 1e-3, rate: float = 0.1, rounds: int = 400) -> OrdinalModel:
    """Maximum likelihood by Adam on all rows; thresholds are a first one and positive steps, so they stay ordered."""
    n = len(grades)
    n_grades = n_grades or max(GRADES, int(grades.max(initial=0)))
    at = np.repeat(np.arange(n), [len(i) for i, _ in rows])
    column = np.array([j for i, _ in rows for j in i], dtype=np.int64)
    value = np.array([x for _, v in rows for x in v])
    share = np.array([(grades > j).mean() for j in range(n_grades)]).clip(1e-4, 1 - 1e-4)
    start = np.maximum.accumulate(np.log((1 - share) / share))
    steps = np.log(np.maximum(np.diff(start), 0.1))
    params = np.concatenate((np.zeros(len(vocabulary)), [start[0]], steps))
    m, v = np.zeros_like(params), np.zeros_like(params)
    size, d = len(vocabulary), n_grades - 1
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -50, 50)))
    rounds = rounds if n else 0
    for t in range(1, rounds + 1):
        w, theta = params[:size], params[size] + np.concatenate(([0], np.cumsum(np.exp(params[size + 1 :]))))
        score = np.bincount(at, weights=w[column] * value, minlength=n)
        upper = np.append(theta, np.inf)[grades]
        lower = np.concatenate(([-np.inf], theta))[grades]
        high, low = sigmoid(upper - score), sigmoid(lower - score)
        high, low = np.where(np.isinf(upper), 1.0, high), np.where(np.isinf(lower), 0.0, low)
        p = np.maximum(high - low, 1e-9)
        dh, dl = high * (1 - high) / p, low * (1 - low) / p  # of the likelihood by its two bounds
        g_score = (dh - dl) / n
        g_theta = (np.bincount(grades, weights=-dh, minlength=n_grades + 1)[:n_grades] + np.bincount(grades, weights=dl, minlength=n_grades + 1)[1:]) / n
        g_w = np.bincount(column, weights=g_score[at] * value, minlength=size) + decay * w / max(1, size)
        back = np.cumsum(g_theta[::-1])[::-1]
        grad = np.concatenate((g_w, [back[0]], back[1:] * np.exp(params[size + 1 :]) if d else []))
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        params = params - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    theta = params[size] + np.concatenate(([0], np.cumsum(np.exp(params[size + 1 :]))))
    return OrdinalModel(vocabulary, params[:size], theta)


def labelled(docs: DataFrame, labels: DataFrame, most: int = MOST) -> DataFrame:
    """(doc_id, text, grade) of at most ``most`` labelled documents."""
    grade = F.when(F.col("toxic") > 0, GRADES).when(F.col("quality") <= 0, 1).otherwise(0)
    some = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").select(F.col("doc_id").cast("long"), grade.alias("grade")).orderBy(F.xxhash64("doc_id"), "doc_id", "grade").limit(most)
    return docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(some), "doc_id")  # bounded by ``most``


def chosen_words(sample: DataFrame, least: float = LEAST, z: float = Z, support: int = SUPPORT) -> list[str]:
    """Words more frequent in toxic documents, by the lower bound of their log-odds ratio."""
    target = arrow_schema(sample.sparkSession, "word string, toxic long, clean long")

    def count(batches):
        for batch in pieces(batches):
            seen = [Counter(), Counter()]
            for text, grade in zip(batch.column("text").to_pylist(), batch.column("grade").to_pylist(), strict=True):
                seen[grade < GRADES].update(set(words(text)))
            every = list(seen[0] | seen[1])
            yield record({"word": every, "toxic": [seen[0][w] for w in every], "clean": [seen[1][w] for w in every]}, target)

    totals = sample.agg(F.count_if(F.col("grade") == GRADES).alias("t"), F.count_if(F.col("grade") < GRADES).alias("c")).first()
    if not totals.t or not totals.c:
        return []
    t, c = F.lit(float(totals.t)), F.lit(float(totals.c))
    by_word = sample.select("text", "grade").mapInArrow(count, "word string, toxic long, clean long").groupBy("word").agg(F.sum("toxic").alias("a"), F.sum("clean").alias("b"))
    cells = [x + 0.5 for x in (F.col("a"), t - F.col("a"), F.col("b"), c - F.col("b"))]
    ratio = F.log(cells[0] / cells[1]) - F.log(cells[2] / cells[3])
    error = F.sqrt(sum((1 / x for x in cells[1:]), 1 / cells[0]))
    return [r.word for r in by_word.where((F.col("a") >= support) & (ratio - z * error >= least)).orderBy("word").collect()]


def train(docs: DataFrame, labels: DataFrame, most: int = MOST) -> OrdinalModel:
    sample = labelled(docs, labels, most)
    vocabulary = {w: i for i, w in enumerate(chosen_words(sample))}
    blank = OrdinalModel(vocabulary, np.zeros(len(vocabulary)), np.zeros(GRADES))
    shape = "grade int, at array<int>, value array<double>"
    target = arrow_schema(docs.sparkSession, shape)

    def sparse(batches):
        for batch in pieces(batches):
            rows = [blank.features(x) for x in batch.column("text").to_pylist()]
            yield record({"grade": batch.column("grade"), "at": [i for i, _ in rows], "value": [v for _, v in rows]}, target)

    found = sample.select("text", "grade").mapInArrow(sparse, shape).collect()  # at most ``most`` rows of vocabulary words
    found.sort(key=lambda r: (r.grade, r.at, r.value))
    rows = [(r.at, r.value) for r in found]
    grades = np.array([r.grade for r in found], dtype=np.int64)
    if not (grades == GRADES).any() or (grades == GRADES).all():
        return OrdinalModel({}, np.zeros(0), np.full(GRADES, 50.0))
    return fit(vocabulary, rows, grades)


SCORED = "doc_id long, expected_severity double, grade int, toxic boolean"


def severity(docs: DataFrame, model: OrdinalModel, reject: float = 0.5) -> DataFrame:
    """SCORED for each row of docs; toxic where the last grade has a probability of at least ``reject``; grade is the likeliest one."""
    shared, target = docs.sparkSession.sparkContext.broadcast(model), arrow_schema(docs.sparkSession, SCORED)

    def score(batches):
        model = shared.value
        for batch in pieces(batches):
            above = model.above([model.features(x) for x in batch.column("text").to_pylist()])
            each = -np.diff(np.column_stack((np.ones(len(above)), above, np.zeros(len(above)))), axis=1)
            yield record({"doc_id": batch.column("doc_id"), "expected_severity": above.sum(axis=1).round(9), "grade": each.argmax(axis=1), "toxic": above[:, -1] >= reject}, target)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(score, SCORED)


def accepted(docs: DataFrame, model: OrdinalModel, reject: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, that are not toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches):
        model = shared.value
        for batch in pieces(batches):
            above = model.above([model.features(x) for x in batch.column("text").to_pylist()])
            yield batch.filter(pa.array(above[:, -1] < reject))

    return docs.mapInArrow(keep, docs.schema)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return severity(docs, train(docs, table(spark, sf_dir, "labels")))
