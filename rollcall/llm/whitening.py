"""Embedding whitening: projections of integer-scaled embeddings on the leading
eigenvectors of their covariance, each divided by its standard deviation.

The covariance is that of the fit list, every different vector once, and is never built:

1. each partition of the fit list keeps a mean and the spectrum of its scatter matrix and
   takes one vector after the other as a centred rank-one update: the new eigenvalues are
   the roots of a secular equation, which is deflated first (directions that the vector
   does not touch, and equal eigenvalues turned so that one of them is not touched);
2. spectra are combined, a few at a time, by successive rank-one updates: one for each
   eigenpair of the other spectrum and one for the difference of the means;
3. the leading vectors are a basis for a Rayleigh-Ritz step: covariance times basis is
   summed over all partitions with the exact mean, and while a residual is above
   rounding it joins the basis and the step is done again.

Sums, counts and deviations are integers and exact. What a task or the driver holds is
bounded by the dimension.

Defined results: rows whose vector is null or has a null or non-finite entry are left out;
shorter vectors count as filled up with zeros; scaled entries outside the range of a long
are its nearest end; a deviation outside it is null; components without variance have
null ``whitened``; with fewer dimensions than components there are as many as dimensions;
repeated rows and ids are rows of their own; an empty table, or one of empty vectors,
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.llm.common import scratch

#: Entries are multiplied by this before they are cut to integers; components returned.
SCALE, COMPONENTS = 256, 4
#: Vectors that the basis has besides the components; spectra combined at a time.
SPARE, FAN = 4, 8
#: Residual of an eigenpair, in units of rounding of the largest eigenvalue, from which
#: the basis is extended.
ROUNDING = 16
_EPS = float(np.finfo(float).eps)


def secular_roots(d: np.ndarray, w: np.ndarray, rho: float) -> np.ndarray:
    """``d[j] - root[i]`` as a matrix [i, j] for the roots of
    1 + rho * sum(w[j] / (d[j] - x)) = 0; ``d`` ascends strictly, ``w`` is positive and sums
    to 1, so there is one root above each pole. A root is held as its distance from the
    nearer pole, so that differences keep their digits."""
    m = len(d)
    upper = np.append(d[1:], d[-1] + rho)
    row = np.arange(m)
    below = row[None, :] <= row[:, None]
    gap = upper - d
    value = 1 / rho + (w / (d - (d + gap / 2)[:, None])).sum(1)
    right = value < 0  # the root is in the upper half
    right[-1] = False  # nothing sits at the end of the last interval
    origin = np.where(right, upper, d)
    far = d[None, :] - origin[:, None]
    lo = np.where(right, -gap / 2, np.where(value < 0, gap / 2, 0.0))
    hi = np.where(right, 0.0, np.where(value < 0, gap, gap / 2))
    tau = np.where(right, -gap / 4, np.where(value < 0, 3 * gap / 4, gap / 4))
    to_lower, to_upper, ones = d - origin, upper - origin, np.ones(m)
    live = row  # roots that are still moving
    for _ in range(100):
        at = tau[live]
        part = w / (far[live] - at[:, None])
        total = part @ ones
        under = (part * below[live]) @ ones
        value, size = 1 / rho + total, 1 / rho + total - 2 * under
        moving = (np.abs(value) > 4 * _EPS * size) & (hi[live] - lo[live] > 2 * _EPS * np.abs(at))
        if not moving.any():
            break
        live, at, value, part = live[moving], at[moving], value[moving], part[moving]
        low, high = np.where(value < 0, at, lo[live]), np.where(value < 0, hi[live], at)
        slope = part * part / w
        slope_all, slope_below = slope @ ones, (slope * below[live]) @ ones
        a_gap, b_gap = to_lower[live] - at, to_upper[live] - at
        # what is left after one pole at each end of the interval carries the slopes
        c = value - a_gap * slope_below - b_gap * (slope_all - slope_below)
        a = (a_gap + b_gap) * value - a_gap * b_gap * slope_all
        b = a_gap * b_gap * value
        with np.errstate(all="ignore"):
            root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
            new = at + np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
        ok = (new > low) & (new < high)
        tau[live], lo[live], hi[live] = np.where(ok, new, (low + high) / 2), low, high
    return far - tau[:, None]


@dataclass
class Spectrum:
    """Count, mean and eigenpairs (ascending) of the scatter matrix of some vectors."""

    n: int
    mean: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @classmethod
    def empty(cls, size: int) -> Spectrum:
        return cls(0, np.zeros(size), np.zeros(size), np.eye(size))

    def add(self, x: np.ndarray) -> None:
        """One more vector."""
        away = x - self.mean
        self.n += 1
        self.mean = self.mean + away / self.n
        if self.n > 1:
            self.update(away, (self.n - 1) / self.n)

    def merge(self, other: Spectrum) -> None:
        """The vectors of another spectrum."""
        away, n = other.mean - self.mean, self.n + other.n
        for value, vector in zip(other.values[::-1].tolist(), other.vectors.T[::-1]):
            if value > 0:
                self.update(vector, value)
        if n:
            self.update(away, self.n * other.n / n)
            self.mean = self.mean + away * (other.n / n)
        self.n = n

    def update(self, direction: np.ndarray, weight: float) -> None:
        """Eigenpairs after ``weight * direction direction'`` is added."""
        z = direction @ self.vectors
        norm = float(z @ z)
        rho = weight * norm
        top = max(float(self.values[-1]), rho) if len(z) else 0.0
        if not rho > _EPS * _EPS * top:
            return
        z = z / np.sqrt(norm)
        tolerance = 8 * _EPS * top
        values, vectors = self.values, self.vectors
        # deflation: equal eigenvalues are turned so that one of two is not touched
        touched = np.flatnonzero(rho * np.abs(z) > tolerance)
        if not len(touched):
            return
        for k in np.flatnonzero(np.diff(values[touched]) * np.abs(z[touched][1:] * z[touched][:-1]) <= tolerance * (z[touched][1:] ** 2 + z[touched][:-1] ** 2)).tolist():
            i, j = touched[k], touched[k + 1]
            r = float(np.hypot(z[i], z[j]))
            if (values[j] - values[i]) * abs(z[i] * z[j]) > tolerance * r * r:
                continue  # the turn before changed z[i]
            c, s = z[j] / r, z[i] / r
            if vectors is self.vectors:
                values, vectors = values.copy(), vectors.copy()
            one, two = vectors[:, i].copy(), vectors[:, j].copy()
            vectors[:, i], vectors[:, j] = c * one - s * two, s * one + c * two
            low, high = values[i], values[j]
            values[i], values[j] = c * c * low + s * s * high, s * s * low + c * c * high
            z[i], z[j] = 0.0, r
        # what is turned may have changed places by rounding
        act = np.flatnonzero(rho * np.abs(z) > tolerance)
        act = act[np.argsort(values[act], kind="stable")]
        keep = np.ones(len(act), bool)
        keep[1:] = np.diff(values[act]) > 0
        act = act[keep]
        d = values[act]
        share = z[act] ** 2
        left = float(share.sum())
        delta = secular_roots(d, share / left, rho * left)  # d[j] - root[i]
        m = len(act)
        # weights for which the roots found are exact: the new vectors are orthogonal
        ratio = -delta
        span = d[None, :] - d[:, None]  # [i, j] = d[j] - d[i]
        lower = np.where(np.arange(m)[:, None] < np.arange(m)[None, :], -span, 1.0)
        if m > 1:
            at = np.arange(m - 1)[:, None] >= np.arange(m)[None, :]
            lower[:-1] = np.where(at, -span[1:], lower[:-1])
        lower[-1] = rho * left
        exact = np.sqrt(np.abs(np.prod(ratio / lower, axis=0))) * np.sign(z[act])
        turn = exact / delta  # row i: new vector i in terms of the old ones
        turn /= np.sqrt((turn * turn).sum(1))[:, None]
        new_values, new_vectors = values.copy(), vectors.copy()
        near = np.argmin(np.abs(delta), axis=1)
        new_values[act] = d[near] - delta[np.arange(m), near]
        new_vectors[:, act] = vectors[:, act] @ turn.T
        order = np.argsort(new_values, kind="stable")
        self.values, self.vectors = new_values[order], new_vectors[:, order]


def usable(vector: Column) -> Column:
    """No null, and no null or non-finite entry."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))
    return F.coalesce(F.forall(vector, lambda c: F.coalesce(finite(c.cast("double")), F.lit(False))), F.lit(False))


def integers(column: pa.Array, size: int) -> np.ndarray:
    """Scaled vectors of a list column, filled up with zeros to ``size``."""
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), float)
    with np.errstate(over="ignore"):
        scaled = np.floor(SCALE * flat)
    entries = np.zeros(len(flat), np.int64)
    inside = np.abs(scaled) < 2.0**63
    entries[inside] = scaled[inside].astype(np.int64)
    entries[~inside] = np.where(scaled[~inside] > 0, 2**63 - 1, -(2**63))
    count = np.asarray(column.value_lengths().to_numpy(zero_copy_only=False), np.int64)
    if (count == size).all():
        return entries.reshape(-1, size)
    out = np.zeros((len(count), size), np.int64)
    begin = np.cumsum(count) - count
    row = np.repeat(np.arange(len(count)), count)
    out[row, np.arange(len(flat)) - begin[row]] = entries
    return out


def vectors_of(column: pa.Array, size: int) -> np.ndarray:
    """Integer vectors of a binary column."""
    return np.frombuffer(b"".join(column.to_pylist()), "<i8").reshape(-1, size)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``n * x - sums`` exactly: as long, or as Python integers where these could overflow."""
    most = max([abs(s) for s in sums] + [n * abs(int(v)) for v in (x.min(), x.max())]) if x.size else 0
    if most < 2**62:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """Vectors less the mean of the fit list."""
    return deviations(x, n, sums).astype(float) / n


def squared(away: np.ndarray) -> list[int | None]:
    """Sums of squares of rows, exactly; None where a long cannot hold one."""
    most = int(np.abs(away).max()) if away.size else 0
    if most * most * max(1, away.shape[1]) < 2**63:
        return (away * away).sum(1).tolist() if away.dtype != object else [int(v) for v in (away * away).sum(1)]
    rows = [sum(int(v) ** 2 for v in r) for r in away]
    return [v if v < 2**63 else None for v in rows]


_STATE = "part long, n long, sums array<decimal(38,0)>, mean array<double>, eigenvalues array<double>, eigenvectors binary"


def spectra(fit: DataFrame, size: int) -> DataFrame:
    """One spectrum for each partition of the fit list (x binary) that has rows."""
    from pyspark import TaskContext

    def rows(batches):
        found, sums = Spectrum.empty(size), [0] * size
        for batch in batches:
            x = vectors_of(batch.column("x"), size)
            for v in x.astype(float):
                found.add(v)
            whole = x if x.size and int(np.abs(x).max() if x.min() > -(2**63) else 2**63) * len(x) < 2**62 else x.astype(object)
            sums = [a + int(b) for a, b in zip(sums, whole.sum(0))]
        if found.n:
            yield pa.RecordBatch.from_arrays(
                [pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([found.n], pa.int64()), pa.array([[Decimal(s) for s in sums]], pa.list_(pa.decimal128(38, 0))),
                 pa.array([found.mean]), pa.array([found.values]), pa.array([found.vectors.tobytes()])],
                ["part", "n", "sums", "mean", "eigenvalues", "eigenvectors"],
            )

    return fit.mapInArrow(rows, _STATE)


def combined(states: DataFrame, size: int) -> DataFrame:
    """Spectra of ``FAN`` neighbouring parts as one."""

    def merge(key, rows: pd.DataFrame) -> pd.DataFrame:
        found, sums = Spectrum.empty(size), [0] * size
        for r in rows.sort_values("part").itertuples():
            other = Spectrum(int(r.n), np.array(r.mean), np.array(r.eigenvalues), np.frombuffer(r.eigenvectors).reshape(size, size))
            sums = [a + int(b) for a, b in zip(sums, r.sums)]
            if found.n:
                found.merge(other)
            else:
                found = other
        return pd.DataFrame([{"part": key[0], "n": found.n, "sums": [Decimal(s) for s in sums], "mean": found.mean, "eigenvalues": found.values, "eigenvectors": found.vectors.tobytes()}])

    return states.groupBy(F.expr(f"part div {FAN}").alias("group")).applyInPandas(merge, _STATE)


def summed(fit: DataFrame, size: int, of: Callable[[np.ndarray], np.ndarray], entries: int) -> np.ndarray:
    """Sum over the whole fit list of what ``of`` gives for a matrix of its vectors."""

    def rows(batches):
        total = np.zeros(entries)
        for batch in batches:
            total += of(vectors_of(batch.column("x"), size)).ravel()
        yield pa.RecordBatch.from_arrays([pa.array([total])], ["total"])

    parts = fit.mapInArrow(rows, "total array<double>").select(F.posexplode("total").alias("at", "value"))
    out = np.zeros(entries)
    for r in parts.groupBy("at").agg(F.sum("value").alias("value")).collect():  # as many rows as entries
        out[r["at"]] = r["value"]
    return out


def rayleigh_ritz(fit: DataFrame, size: int, n: int, sums: list[int], start: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Leading eigenvalues and vectors (columns) of the covariance in the span of
    ``start``, which grows by the residuals until they are no more than rounding."""
    basis = np.linalg.qr(start)[0]
    while True:
        held = basis

        def product(x: np.ndarray) -> np.ndarray:
            away = centred(x, n, sums)
            return away.T @ (away @ held)

        image = summed(fit, size, product, held.size).reshape(held.shape) / n
        small = held.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        vectors, image = held @ turn, image @ turn
        residual = (image - vectors * values)[:, :most]
        left = np.linalg.norm(residual, axis=0)
        if held.shape[1] >= size or (left <= ROUNDING * _EPS * size**0.5 * max(values[0], 0)).all():
            return values[:most], vectors[:, :most]
        wide = np.hstack([vectors, residual[:, left > 0] / left[left > 0]])[:, :size]
        basis = np.linalg.qr(wide)[0]


def whitened(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """One row for each usable row and component: vec_id, component, n, deviation,
    whitened, explained, identity_error."""
    out_schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    spark = embeddings.sparkSession
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).filter(usable(F.col("embedding")))
    size = rows.agg(F.max(F.size("embedding")).alias("size")).first()["size"] or 0
    if not size:
        return spark.createDataFrame([], out_schema)

    def packed(batches):
        for batch in batches:
            x = integers(batch.column("embedding"), size)
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x.astype("<i8")], pa.binary())], ["x"])

    with scratch(spark) as store:
        fit = store(rows.select("embedding").mapInArrow(packed, "x binary").distinct(), "whitening-fit")
        states = store(spectra(fit, size), "whitening-spectra")
        parts = states.agg(F.max("part").alias("last")).first()["last"] + 1
        while parts > 1:
            states = store(combined(states, size), "whitening-spectra")
            parts = -(-parts // FAN)
        state = states.first()
        n, sums = state["n"], [int(s) for s in state["sums"]]
        start = np.frombuffer(state["eigenvectors"]).reshape(size, size)[:, ::-1][:, : components + SPARE]
        values, basis = rayleigh_ritz(fit, size, n, sums, start, min(components, size))
        trace = float(summed(fit, size, lambda x: np.array([(centred(x, n, sums) ** 2).sum()]), 1)[0]) / n
        # either sign is an eigenvector: the largest entry is positive
        basis = basis * np.sign(basis[np.abs(basis).argmax(0), np.arange(basis.shape[1])])
        real = values > 8 * size * _EPS * max(trace, 0)
        projection = basis[:, real] / np.sqrt(values[real])
        k = projection.shape[1]

        def moments(x: np.ndarray) -> np.ndarray:
            w = centred(x, n, sums) @ projection
            return np.r_[w.sum(0), (w.T @ w).ravel()]

        got = summed(fit, size, moments, k + k * k) / n
    error = float(np.abs(got[k:].reshape(k, k) - np.outer(got[:k], got[:k]) - np.eye(k)).max()) if k else None
    explained = [float(v) / trace if trace else None for v in values]
    column = np.cumsum(real) - 1

    def result(batches):
        for batch in batches:
            x = integers(batch.column("embedding"), size)
            away = deviations(x, n, sums)
            w = (away.astype(float) / n) @ projection
            dev, many = squared(away), len(x)
            for c in range(len(values)):
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id"), pa.array([c + 1] * many, pa.int32()), pa.array([n] * many, pa.int64()), pa.array(dev, pa.int64()),
                     pa.array(w[:, column[c]]) if real[c] else pa.nulls(many, pa.float64()), pa.array([explained[c]] * many, pa.float64()), pa.array([error] * many, pa.float64())],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(result, out_schema)


def op12_embedding_whitening(embeddings: DataFrame) -> DataFrame:
    return whitened(embeddings)
