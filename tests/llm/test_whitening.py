from __future__ import annotations

import numpy as np
import pytest
from conftest import SMALL

from rollcall.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>, label int, component string, n string"


def frame(spark, vectors):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 1, "x", "y") for i, v in vectors], SCHEMA)


def brute(vectors):
    kept = [(i, v) for i, v in vectors if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    size = max(len(v) for _, v in kept)
    x = np.array([[int(np.floor(256 * float(np.float32(c)))) for c in v] + [0] * (size - len(v)) for _, v in kept], object)
    fit = sorted({tuple(r) for r in x})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    away = np.array(fit, object) * n - np.array(sums, object)
    away = away.astype(float) / n
    values, vectors_ = np.linalg.eigh(away.T @ away / n)
    values, vectors_ = values[::-1], vectors_[:, ::-1]
    dev = [sum((n * int(c) - s) ** 2 for c, s in zip(r, sums)) for r in x]
    return [i for i, _ in kept], n, dev, (n * x - np.array(sums, object)).astype(float) / n, values, vectors_


def check(spark, vectors, exact=1e-9):
    got = W.op12_embedding_whitening(frame(spark, vectors)).collect()
    ids, n, dev, away, values, eigen = brute(vectors)
    k = min(4, len(values))
    assert len(got) == k * len(ids) and {r["n"] for r in got} == {n}
    assert sorted((r["vec_id"], r["component"], r["deviation"]) for r in got) == sorted((i, c + 1, d if d < 2**63 else None) for i, d in zip(ids, dev) for c in range(k))
    trace = values.sum()
    for c in range(k):
        mine = sorted((r for r in got if r["component"] == c + 1), key=lambda r: (r["vec_id"], r["deviation"] or 0))
        if trace and values[c] > 1e-9 * trace:
            assert abs(mine[0]["explained"] * trace / values[c] - 1) < 1e-9
            w = away @ eigen[:, c] / np.sqrt(values[c])
            want = np.array([v for _, _, v in sorted(zip(ids, [d for d in dev], w), key=lambda t: t[:2])])
            have = np.array([r["whitened"] for r in mine])
            gap = min(abs(values[c] - v) for j, v in enumerate(values) if j != c) if len(values) > 1 else 1
            if gap > 1e-6 * values[0]:  # else any turn of the two is as good
                assert min(np.abs(have - want).max(), np.abs(have + want).max()) < exact
            assert mine[0]["identity_error"] < 1e-9
        else:
            assert all(r["whitened"] is None for r in mine)


def test_table(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    check(spark, rows)


def test_repeats_nulls_and_lengths(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(60, 6)) * [9, 5, 3, 2, 1, 0.5] + 1000
    rows = [(i % 50, v.tolist()) for i, v in enumerate(np.repeat(base, 3, axis=0))]
    rows += [(1000 + i, base[0].tolist()) for i in range(200)]  # one very common vector
    rows += [(900, None), (901, [1.0, None, 2.0]), (902, [float("nan")] * 6), (903, [float("inf")] + [0.0] * 5), (904, [3.0, 4.0]), (None, base[1].tolist())]
    rows = [(i if i is not None else -1, v) for i, v in rows]
    check(spark, rows, exact=1e-8)


def test_few_vectors_and_dimensions(spark):
    check(spark, [(1, [0.5, 0.25, -1.0])])  # no variance at all
    check(spark, [(1, [0.0, 1.0]), (2, [3.0, -1.0]), (3, [2.0, 2.0])])
    check(spark, [(1, [float(i) for i in range(9)]), (2, [1.0] * 9), (3, [2.0] * 9)])
    assert W.op12_embedding_whitening(frame(spark, [])).count() == 0
    assert W.op12_embedding_whitening(frame(spark, [(1, []), (2, None)])).count() == 0


def test_large_entries(spark):
    rng = np.random.default_rng(2)
    check(spark, [(i, (1e12 * rng.normal(size=5) * [5, 4, 3, 2, 1]).tolist()) for i in range(40)])


def test_integers_saturate():
    import pyarrow as pa

    got = W.integers(pa.array([[1e30, -1e30, -0.001], [0.999 / 256]]), 3)
    assert got.tolist() == [[2**63 - 1, -(2**63), -1], [0, 0, 0]]


@pytest.mark.parametrize("kind", ["normal", "equal", "graded", "integers", "unit", "offset"])
def test_updates_and_merges_give_the_spectrum(kind):
    rng = np.random.default_rng(3)
    x = {"normal": rng.normal(size=(150, 12)), "equal": np.repeat(rng.normal(size=(9, 12)), 5, axis=0), "graded": rng.normal(size=(90, 12)) * 10.0 ** -np.arange(12),
         "integers": rng.integers(-2, 3, (200, 7)).astype(float), "unit": np.eye(12), "offset": rng.integers(0, 2, (120, 9)) + 1e5}[kind]
    a, b = W.Spectrum.empty(x.shape[1]), W.Spectrum.empty(x.shape[1])
    for v in x[:40]:
        a.add(v)
    for v in x[40:]:
        b.add(v)
    a.merge(b)
    away = x - x.mean(0)
    scatter = away.T @ away
    top = np.linalg.eigvalsh(scatter)[-1]
    assert a.n == len(x) and np.abs(a.mean - x.mean(0)).max() < 1e-9
    limit = 1e-8 if kind == "offset" else 1e-12
    assert np.abs(a.vectors.T @ a.vectors - np.eye(x.shape[1])).max() < 1e-12
    assert np.abs((a.vectors * a.values) @ a.vectors.T - scatter).max() < limit * top


def test_secular_roots_lie_between_poles():
    rng = np.random.default_rng(4)
    d = np.sort(rng.normal(size=20)) * 10
    w = rng.random(20) ** 6 + 1e-12
    delta = W.secular_roots(d, w / w.sum(), 3.0)
    value = 1 / 3.0 + (w / w.sum() / delta).sum(1)
    assert (np.abs(value) < 1e-10 * (1 / 3.0 + np.abs(w / w.sum() / delta).sum(1))).all()
    assert (np.diag(delta) < 0).all() and (delta[np.arange(19), np.arange(1, 20)] > 0).all()
