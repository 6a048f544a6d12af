from __future__ import annotations

import numpy as np
import pytest

from rollcall.operators.knn import nearest_neighbours


def frame(spark, x):
    return spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "id long, x array<double>")


def brute(x, k, ids=None):
    x = np.asarray(x, float)
    out = {}
    for i in range(len(x)) if ids is None else ids:
        d = ((x - x[i]) ** 2).sum(1)
        order = [j for j in np.lexsort((np.arange(len(x)), d)) if j != i][:k]
        out[i] = [(j, d[j]) for j in order]
    return out


def run(spark, x, k, block_rows, ids=None):
    query = None if ids is None else spark.createDataFrame([(i,) for i in ids], "id long")
    got = nearest_neighbours(frame(spark, x), k, block_rows, query)
    out = {}
    for r in got.table.orderBy("qid", "nn").collect():
        out.setdefault(r["qid"], []).append((r["rid"], r["dist"]))
    return out, got.pairs


def clusters(rng, n, size):
    return rng.normal(size=(n, size)) + rng.integers(0, 40, (n, 1)) * 25.0


@pytest.mark.parametrize("kind", ["clusters", "grid", "equal", "offset"])
def test_same_as_brute_force(spark, kind):
    rng = np.random.default_rng(1)
    x = {
        "clusters": clusters(rng, 300, 4),
        "grid": rng.integers(0, 4, (250, 3)),  # many ties
        "equal": np.repeat([[1.0, 2.0], [3.0, 4.0]], 40, axis=0),
        "offset": rng.normal(size=(150, 3)) + 1e6,
    }[kind]
    got, _ = run(spark, x, 5, 20)
    assert got == brute(x, 5)


def test_some_queries_and_few_rows(spark):
    rng = np.random.default_rng(2)
    x = clusters(rng, 120, 3)
    assert run(spark, x, 3, 10, [0, 7, 7, 119])[0] == brute(x, 3, [0, 7, 119])
    assert run(spark, x[:3], 5, 10)[0] == brute(x[:3], 5)
    assert run(spark, x[:1], 5, 10) == ({}, 0) and run(spark, x[:0], 5, 10) == ({}, 0)


def test_pairs_grow_less_than_quadratically(spark):
    rng = np.random.default_rng(3)
    few, many = (run(spark, rng.uniform(0, 1000, (n, 2)), 5, 10)[1] for n in (400, 1600))
    assert few < 400**2 / 2 and many < 1600**2 / 5 and many < 4**1.7 * few, (few, many)


def test_only_rows_within_a_bound_are_told():
    from rollcall.operators.knn import _nearest

    rng = np.random.default_rng(4)
    q, r = rng.normal(size=(300, 5)) + 50.0, rng.normal(size=(400, 5)) + 50.0
    ids, others = np.arange(300), np.arange(200, 600)
    bound = np.where(ids % 3 == 0, np.inf, rng.uniform(0, 3, 300))
    got = {}
    for row in _nearest(ids, q, bound, others, r, 4).to_pylist():
        got.setdefault(row["qid"], []).append((row["dist"], row["rid"]))
    for i in ids:
        d = ((r - q[i]) ** 2).sum(1)
        want = sorted((x, int(j)) for x, j in zip(d, others) if j != i and x <= bound[i])[:4]
        assert got.get(i, []) == want
