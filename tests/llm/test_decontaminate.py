from __future__ import annotations

import random

import pytest
from conftest import ODD, documents

from rollcall.llm import decontaminate as D


def grams(text, n):
    w = (text or "").encode().lower().split()
    return {tuple(w[i: i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def brute(docs, items, n, tenths):
    out = {}
    for d, t in docs:
        have = grams(t, n)
        for i, u in items:
            need = grams(u, n)
            if need and 10 * len(need & have) >= tenths * len(need):
                out[d, i] = (len(need), len(need & have))
    return out


@pytest.mark.parametrize("most", [10**6, 0])
def test_matches_brute_force_on_both_routes(spark, most):
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(200)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(text(rng.choice([3, 5, 9, 30, 60])))) for i in range(40)] + [(100, None), (101, " "), (102, "a b c d e f g"), (103, "word")]
    docs = list(ODD)
    for i in range(200):
        w = text(rng.randint(0, 400))
        item = rng.choice(items[:40])[1].split()
        for _ in range(rng.randint(0, 4)):  # more or less damaged
            item[rng.randrange(len(item))] = "other"
        at = rng.randint(0, len(w))
        w[at:at] = item
        docs.append((1000 + i, " ".join(w).upper() if i % 5 == 0 else " ".join(w)))
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id long")
    got = {(r["doc_id"], r["item_id"]): (r["n_item"], r["n_shared"]) for r in D.contained(documents(spark, docs), bench, most=most).collect()}
    assert got == brute(docs, items, 5, 8) and len(got) > 60


def test_odd_tables_and_native(spark):
    bench = spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string")
    assert D.op8_benchmark_decontamination(documents(spark, []), bench).collect() == []
    assert D.op8_benchmark_decontamination(documents(spark, ODD), bench.limit(0)).collect() == []
    out = D.op8_benchmark_decontamination(documents(spark, [*ODD, (6, "a b c d e f g")]), bench)
    assert sorted((r["doc_id"], r["containment"]) for r in out.collect()) == [(6, 1.0), (7, 1.0)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("most", [10**6, 0])
def test_null_and_repeated_ids(spark, most):
    line = lambda c, n: " ".join(f"{c}{i}" for i in range(n))
    items = [(None, line("a", 9)), (None, line("b", 9)), (1, line("c", 40)), (1, line("d", 9)), (2, line("e", 9)), (2, line("e", 9))]
    half = line("c", 25)  # 21 of 36 shingles: enough for the short text of the same id only
    docs = [(None, "x " + line("a", 9)), (None, "y"), (7, line("b", 9)), (7, "z"), (8, half + " d0 d1 d2 d3 d4"), (9, line("d", 9)), (9, line("c", 36)), (9, line("c", 39)), (10, line("e", 9))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((tuple(r)[:4] for r in D.contained(documents(spark, docs), bench, most=most).collect()), key=str)
    assert got == sorted([(None, None, 5, 5), (7, None, 5, 5), (9, 1, 5, 5), (10, 2, 5, 5)], key=str)
