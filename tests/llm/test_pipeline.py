from __future__ import annotations

from conftest import SMALL, documents
from pyspark.sql import functions as F
from test_decontaminate import brute as contaminated
from test_ngram_join import brute as groups
from test_packing import verify
from test_pii import brute as personal

import corpus_pipeline as P


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    stage = dict(P.STAGES)
    text = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}

    kept = stage["quality classifier"](spark, docs, SMALL)
    assert kept.columns == docs.columns and 0 < kept.count() <= docs.count()

    before = text(docs)
    alone = stage["n-gram Jaccard join"](spark, docs, SMALL)
    assert alone.columns == docs.columns
    assert set(text(alone)) == {k for k, (_, c) in groups(list(before.items()), 5, 80, 100).items() if c == k}

    clean = stage["benchmark decontamination"](spark, docs, SMALL)
    bad = {d for d, _ in contaminated(list(before.items()), bench, 5, 8)}
    assert clean.columns == docs.columns and set(text(clean)) == set(before) - bad and bad

    safe = stage["PII"](spark, docs, SMALL)
    assert safe.columns == docs.columns
    for k, t in text(safe).items():
        assert not personal(t) and (t == before[k] or personal(before[k]) or "[" in t)

    assert verify(stage["packing"](spark, safe, SMALL).collect(), list(text(safe).items())) == 0


def test_run_and_empty_input(spark):
    assert P.run(spark, SMALL).count() > 0
    docs = documents(spark, []).withColumnRenamed("start", "extra")
    for _, stage in P.STAGES:
        out = stage(spark, docs, SMALL)
        assert out.count() == 0


def test_extra_columns_with_clashing_names(spark):
    names = ["p_top", "expected_grade", "row_id", "_new", "_null", "pii_email", "bad_id", "key", "component", "item_id", "start", "a.b"]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").filter("doc_id < 60")
    docs = docs.select(*docs.columns, *[F.concat(F.lit(f"{n} "), "doc_id").alias(n) for n in names])
    before = {r["doc_id"]: r for r in docs.collect()}
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, SMALL)
        assert out.columns == docs.columns
        rows = out.collect()
        assert rows and len({r["doc_id"] for r in rows}) == len(rows)
        for r in rows:
            assert all(r[n] == before[r["doc_id"]][n] for n in (*names, "lang", "source")), name
    assert verify(P.STAGES[-1][1](spark, docs, SMALL).collect(), [(k, r["text"]) for k, r in before.items()]) == 0


def test_stages_read_what_is_stored(spark, monkeypatch):
    seen = []

    def stage(spark, docs, sf_dir):
        seen.append(docs)
        return docs.filter("doc_id % 7 > 0").withColumn("text", docs.text)

    monkeypatch.setattr(P, "STAGES", [("a", stage), ("b", stage), ("c", stage)])
    out = P.run(spark, SMALL)
    files = [set(d.inputFiles()) for d in seen]
    assert all(files) and not (files[0] & files[1] or files[0] & files[2] or files[1] & files[2])
    assert all("Filter" not in d._jdf.queryExecution().optimizedPlan().toString() for d in seen)
    assert set(out.inputFiles()) == files[2] and out.schema == seen[0].schema and out.count() == seen[0].filter("doc_id % 7 > 0").count()
