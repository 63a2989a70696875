from __future__ import annotations

import math
import re

import numpy as np
import pytest
from cases import COLUMNS, frame
from pyspark.sql import functions as F

from stagegraph.llm import toxicity


def test_thresholds_stay_ordered_and_weights_are_shared():
    rng = np.random.default_rng(0)
    counts = rng.poisson(1.0, (2000, 3))
    score = counts @ np.array([1.5, 0.5, 0.0])
    grades = np.digitize(score + rng.logistic(size=2000) * 0.3, [1.5, 2.5, 4.0])
    rows = [([j for j in range(3) if r[j]], [float(r[j]) for j in range(3) if r[j]]) for r in counts]
    model = toxicity.fit({"a": 0, "b": 1, "c": 2}, rows, grades)
    assert (np.diff(model.thresholds) > 0).all()
    assert model.weights[0] > 2 * model.weights[1] > 0 and abs(model.weights[2]) < model.weights[1] / 2
    expected = model.above(rows).sum(axis=1)
    assert np.corrcoef(expected, grades)[0, 1] > 0.85


@pytest.mark.parametrize("size", ["sf0.01"])
def test_held_out_accuracy(spark, size):
    base = f"/root/testdata/{size}"
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    model = toxicity.train(docs, labels.where("doc_id % 3 <> 1"))
    judged = toxicity.severity(docs, model).withColumnRenamed("toxic", "said").join(labels.where("doc_id % 3 = 1"), "doc_id")
    n = {(r.toxic, r.said): r["count"] for r in judged.groupBy("toxic", "said").count().collect()}
    right = n.get((1, True), 0) + n.get((0, False), 0)
    assert right / sum(n.values()) > 0.93 and n.get((0, True), 0) <= 0.01 * sum(n.values())
    said = judged.where("toxic > 0").join(docs.select("doc_id", "text"), "doc_id").collect()
    known = [r.said for r in said if model.features(r.text)[0]]
    assert sum(known) >= 0.95 * len(known) and len(known) >= 0.7 * len(said)  # others hold no word that tells the classes apart
    rows = judged.select("expected_severity", "toxic").collect()
    pairs = [(a.expected_severity > b.expected_severity) + 0.5 * (a.expected_severity == b.expected_severity) for a in rows for b in rows if a.toxic > b.toxic]
    assert sum(pairs) / len(pairs) > 0.85  # rank agreement on documents that the model has not seen


def test_a_small_table_finds_the_words(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    judged = toxicity.severity(docs, toxicity.train(docs, labels)).withColumnRenamed("toxic", "said").join(labels, "doc_id").collect()
    assert sum(r.said for r in judged if r.toxic) >= 0.6 * sum(r.toxic for r in judged) and sum(r.said for r in judged if not r.toxic) <= 1


def test_scores_by_brute_force(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(docs, labels)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in toxicity.severity(docs, model).collect():
        found = re.findall(r"[^\W_]+", (texts[r.doc_id] or "").lower())
        score = sum(model.weights[i] * math.log1p(found.count(w)) for w, i in model.vocabulary.items())
        above = [1 / (1 + math.exp(t - score)) for t in model.thresholds]
        each = [1 - above[0], above[0] - above[1], above[1]]
        assert abs(r.expected_severity - sum(above)) < 1e-6 and r.toxic == (above[-1] >= 0.5) and each[r.grade] >= max(each) - 1e-9


def test_odd_rows_and_tables(spark):
    bad = [(100 + i, f"you are a vile creature number {i} hateful", *[None] * 9) for i in range(20)]
    good = [(200 + i, f"you are a fine creature number {i}", *[None] * 9) for i in range(20)]
    docs = frame(spark).unionByName(spark.createDataFrame(bad + good, COLUMNS))
    labels = spark.createDataFrame([(100 + i, 0, 1) for i in range(20)] + [(200 + i, 1, 0) for i in range(20)] + [(None, 1, 1), (1, 1, 0), (999, 1, 1), (2, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels)
    scored = toxicity.severity(docs, model)
    assert {r.doc_id for r in scored.where("toxic").collect()} == {r[0] for r in bad}
    assert scored.count() == docs.count() and scored.where("expected_severity IS NULL").count() == 0
    kept = toxicity.accepted(docs, model)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 20
    nothing = toxicity.train(docs, labels.limit(0))
    assert toxicity.severity(docs, nothing).where("toxic").count() == 0
    assert toxicity.severity(docs.where(F.lit(False)), model).collect() == []
