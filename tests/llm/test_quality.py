from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from conftest import ODD, documents

from rollcall.llm import quality as Q

HELD = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    """Fitted on three quarters of the labelled documents, judged on the rest."""
    docs, labels = spark.read.parquet(f"{HELD}/documents.parquet"), spark.read.parquet(f"{HELD}/labels.parquet")
    model = Q.model(docs, labels.filter("doc_id % 4 != 0"))
    rest = labels.filter("doc_id % 4 = 0")
    got = Q.scored(docs.join(rest, "doc_id").select("doc_id", "text", "quality", "toxic"), *model).toPandas()
    keep = got.p_top >= Q.LEAST
    good = (got.quality == 1) & (got.toxic == 0)
    assert keep[good].mean() > 0.97
    assert keep[got.toxic == 1].mean() < 0.25 and keep[got.quality == 0].mean() < 0.35
    assert got.expected_grade[good].mean() > got.expected_grade[got.quality == 0].mean() > got.expected_grade[got.toxic == 1].mean()


def test_probabilities():
    p = Q.grade_probabilities(np.array([-40.0, 0.0, 3.0]), np.array([-1.0, 1.0]))
    assert np.allclose(p.sum(axis=1), 1) and p[0, 0] > 0.99 and np.all(p >= 0)
    s = 1 / (1 + np.exp(-1.0))
    assert np.allclose(p[1], [1 - s, 2 * s - 1, 1 - s])


def test_gradient_recovers_an_ordered_scale():
    rng = np.random.default_rng(0)
    n, truth = 4000, np.array([2.0, -1.0, 0.5])
    x = rng.normal(size=(n, 3))
    noise = np.log(1 / rng.uniform(1e-9, 1, n) - 1)
    grade = np.digitize(x @ truth - noise, [-1.0, 1.5])
    w, cuts = Q.fit(np.arange(0, 3 * n + 1, 3), np.tile(np.arange(3), n), x.ravel(), grade)
    assert np.allclose(w[:3] / w[0], truth / truth[0], atol=0.15) and cuts[0] < cuts[1]


def test_odd_tables(spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, None, 0), (99, 0, 0), (6, 0, 0), (6, 1, 1)], "doc_id long, quality int, toxic int")
    rows = Q.op7_quality_classifier(documents(spark, ODD), labels).collect()
    assert len(rows) == len(ODD) and all(0 <= r["p_top"] <= 1 for r in rows)
    assert all(r["keep"] for r in Q.op7_quality_classifier(documents(spark, ODD), labels.limit(0)).collect())
    assert Q.op7_quality_classifier(documents(spark, []), labels).collect() == []


def test_features_of_a_text_are_distinct():
    for _, texts, doc, index, value in Q.features(pa.array(["a A a. b!! 12", "", None, "ü"])):
        assert texts == 4 and len({*zip(doc.tolist(), index.tolist())}) == len(doc) and np.all(value >= 0)
    with pytest.raises(StopIteration):
        next(Q.features(pa.array([], pa.string())))
