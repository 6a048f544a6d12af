from __future__ import annotations

import hashlib
import random

from conftest import ODD, documents
from pyspark.sql import functions as F

from rollcall.llm import fingerprints as FP


def _edited(texts):
    out = {}
    for i, (k, t) in enumerate(texts):
        nxt = texts[(i + 1) % len(texts)][1]
        cut = len(t) // 2
        out[k] = t[: len(t) - cut] + nxt[:cut]
    return out


def _rows(spark, rows):
    return {r["doc_id"]: r for r in FP.op9_document_fingerprints(documents(spark, rows)).collect()}


def test_edited_text_and_defined_cases(spark):
    random.seed(1)
    rows = ODD + [(i * 10**12 + 17, " ".join(random.choices("alpha beta gamma delta epsilon ö".split(), k=random.randint(0, 80)))) for i in range(1, 120)]
    random.shuffle(rows)
    got = _rows(spark, rows)
    texts = sorted((k, t or "") for k, t in rows)
    for k, want in _edited(texts).items():
        assert got[k]["edited_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        assert got[k]["n_chars"] == len(dict(texts)[k])
        assert 0 <= got[k]["near_edited"] <= 1 and 0 <= got[k]["near_next"] <= 1
    assert got[1]["fingerprint"] == got[2]["fingerprint"] == got[3]["fingerprint"] == ""
    assert got[1]["near_next"] == 1.0 and got[3]["near_next"] == 0.0
    assert got[6]["fingerprint"] == got[7]["fingerprint"] and got[6]["near_next"] == 1.0


def test_likeness_is_near_the_true_one(spark):
    random.seed(2)
    vocabulary = [f"w{i}" for i in range(4000)]
    base = random.choices(vocabulary, k=3000)
    rows = []
    for i in range(20):
        changed = list(base)
        for j in random.sample(range(len(base)), 15 * i):
            changed[j] = random.choice(vocabulary)
        rows.append((i, " ".join(changed)))
    got = _rows(spark, rows)

    def grams(t):
        w = t.split()
        return {tuple(w[i: i + 5]) for i in range(len(w) - 4)}

    for i in range(19):
        a, b = grams(rows[i][1]), grams(rows[i + 1][1])
        assert abs(got[i]["near_next"] - len(a & b) / len(a | b)) < 0.12


def test_merged_sketch_is_the_sketch_of_both(spark):
    df = spark.createDataFrame([("a b c d e f g h", "x y z u v w")], "a string, b string")
    both = FP.with_sketch(FP.with_sketch(df, "a", "sa"), "b", "sb").withColumn("m", FP.merged(F.col("sa"), F.col("sb"))).first()
    assert both["m"] == sorted({*both["sa"], *both["sb"]})


def test_empty_table_single_row_repeats_and_null_id(spark):
    assert _rows(spark, []) == {}
    one = _rows(spark, [(5, "abcd")])[5]
    assert one["edited_sha256"] == hashlib.sha256(b"abab").hexdigest() and one["near_next"] == 1.0
    rows = FP.op9_document_fingerprints(documents(spark, [(1, "p q"), (1, "p q"), (None, "r s"), (2, "t")])).collect()
    assert sorted(r["doc_id"] is None for r in rows) == [False, False, False, True]


def test_native(spark):
    plan = FP.op9_document_fingerprints(documents(spark, ODD))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "SinglePartition" not in plan
