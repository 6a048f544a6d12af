"""Exact k nearest neighbours by a pivot (Voronoi) join.

1. Some rows, chosen by the smallest hashes, are pivots: four for ``block_rows`` rows, but
   no more than the square root of all or ``MOST_PIVOTS``; every row goes
   to the cell of its nearest pivot, and a cell is cut into rings of about ``block_rows``
   rows by the distance from the pivot. Rings are told by approximate quantiles, so no
   cell is sorted by one task.
2. A query first meets the rows of its own ring; the distance of the k-th is a bound.
3. By the triangle inequality a ring holds a nearer row only if the query's distance from
   the ring's pivot is within the bound of the ring's range, and a cell only if the plane
   between the two pivots is: only such rings see the query.

A ring's queries are dealt to as many groups as they need, so no group holds more than a
ring's rows and about ``block_rows`` queries (rows that are equally far from a pivot stay
together: equal rows cannot be told apart by distance, but they are salted as queries).
Distances that decide are sums of squared differences; ties go to the smaller id, so the
result does not depend on how rows are dealt.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rollcall.session import cut_lineage

#: Pivots and rings of a cell at most: what every task is sent is bounded by them.
MOST_PIVOTS, MOST_RINGS = 2048, 64
#: Rounding that bounds allow for, relative to the squared lengths involved.
SLACK, ROUNDING = 1e-9, 1e-12
#: Queries whose distances are held at a time, and pairs whose differences are.
TILE, SOME = 256, 16_384

_FOUND = "qid long, rid long, dist double"


@dataclass
class Neighbours:
    """(qid, rid, dist, nn) with nn = 0..k-1 by (dist, rid), dist the squared distance; and
    how many pairs of a query and a row were looked at."""

    table: DataFrame
    pairs: int


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * a @ b.T, 0.0)


def _matrix(column: pa.Array | pa.ChunkedArray, size: int) -> np.ndarray:
    """Rows of a list column as a matrix, without a Python object for each."""
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    parts = [c.flatten().to_numpy(zero_copy_only=False).reshape(-1, size) for c in chunks if len(c)]
    return np.concatenate(parts) if parts else np.empty((0, size))


def _nearest(qid: np.ndarray, q: np.ndarray, bound: np.ndarray, rid: np.ndarray, r: np.ndarray, k: int) -> pa.Table:
    """The k nearest other rows of each query by (dist, rid), or those of them within its
    bound (a squared distance, infinite if none is known): one product of matrices tells
    which pairs can be near enough, and only their distances are computed."""
    found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
    middle = np.nan_to_num(r).mean(0) if len(r) else 0.0
    b = r - middle  # nearer to zero, so that less is lost to rounding
    half = (b * b).sum(1) / 2
    kk = min(k + 1, len(r))  # a query may meet itself
    for lo in range(0, len(q) if len(r) else 0, TILE):
        a, ids, most = q[lo: lo + TILE] - middle, qid[lo: lo + TILE], bound[lo: lo + TILE]
        squares = (a * a).sum(1)
        near = a @ b.T
        near -= half  # (|a|^2 - |a - b|^2) / 2
        reach = SLACK * (squares + 2 * np.nanmax(half, initial=0.0))
        floor = (squares - most) / 2
        open_ = np.flatnonzero(np.isinf(most))
        if len(open_):
            some = np.where(np.isnan(near[open_]), -np.inf, near[open_])
            floor[open_] = np.partition(some, len(r) - kk, axis=1)[:, len(r) - kk]
        i, j = np.nonzero(near >= (floor - reach)[:, None])
        other = rid[j] != ids[i]
        i, j = i[other], j[other]
        exact = np.concatenate([((r[j[at: at + SOME]] - q[lo + i[at: at + SOME]]) ** 2).sum(1) for at in range(0, len(i), SOME)] or [np.empty(0)])
        fits = exact <= most[i]
        i, j, exact = i[fits], j[fits], exact[fits]
        order = np.lexsort((rid[j], exact, i))
        i, j, exact = i[order], j[order], exact[order]
        best = np.arange(len(i)) - np.searchsorted(i, i, side="left") < k
        found.append((ids[i[best]], rid[j[best]], exact[best]))
    return pa.table([np.concatenate(c) for c in zip(*found)], names=["qid", "rid", "dist"])


def _group(k: int, size: int):
    def run(group: pa.Table) -> pa.Table:
        asks = group["query"].to_numpy()
        ids, x, bound = group["id"].to_numpy(), _matrix(group["x"], size), group["bound"].to_numpy()
        return _nearest(ids[asks], x[asks], bound[asks], ids[~asks], x[~asks], k)

    return run


def _meet(queries: DataFrame, rows: DataFrame, k: int, size: int, block_rows: int) -> DataFrame:
    """Nearest rows for (cell, ring, id, x, bound) of queries in the ring that they name, no
    farther than the bound; a ring's queries are dealt to groups, each with all its rows."""
    count = queries.groupBy("cell", "ring").agg(F.ceil(F.count("*") / F.lit(block_rows)).cast("int").alias("parts"))
    salted = rows.join(count, ["cell", "ring"]).select("cell", "ring", "id", "x", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(False).alias("query"), F.lit(0.0).alias("bound"))
    asked = queries.join(count, ["cell", "ring"]).select("cell", "ring", "id", "x", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), F.lit(True).alias("query"), F.coalesce("bound", F.lit(float("inf"))).alias("bound"))
    return salted.unionByName(asked).groupBy("cell", "ring", "part").applyInArrow(_group(k, size), _FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("qid").orderBy("dist", "rid")
    return found.withColumn("nn", F.row_number().over(order) - 1).filter(F.col("nn") < k)


def nearest_neighbours(rows: DataFrame, k: int, block_rows: int = 8192, query_ids: DataFrame | None = None) -> Neighbours:
    """k nearest other rows of ``rows`` (id unique, x array<double> without nulls) for
    every row, or for the ids in ``query_ids`` (column id)."""
    empty = rows.sparkSession.createDataFrame([], "qid long, rid long, dist double, nn int")
    total = rows.count()
    if total < 2 or k < 1:
        return Neighbours(empty, 0)
    wanted = min(MOST_PIVOTS, math.isqrt(total), 4 * -(-total // block_rows))
    chosen = rows.orderBy(F.xxhash64("id"), "id").limit(wanted).select("x").collect()  # bounded: MOST_PIVOTS
    pivots = np.unique(np.array([r["x"] for r in chosen], float), axis=0)
    size, half = pivots.shape[1], (pivots * pivots).sum(1) / 2

    def to_cells(batches):
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch["x"], size)
                cell = np.concatenate([(half - x[i: i + TILE] @ pivots.T).argmin(1) for i in range(0, len(x), TILE)])
                away = np.sqrt(((x - pivots[cell]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([batch["id"], batch["x"], pa.array(cell, pa.int32()), pa.array(away)], ["id", "x", "cell", "away"])

    cells = cut_lineage(rows.select("id", "x").mapInArrow(to_cells, "id long, x array<double>, cell int, away double"))
    shape = cells.groupBy("cell").agg(F.count("*").alias("n"), F.percentile_approx("away", [i / MOST_RINGS for i in range(1, MOST_RINGS)], 10_000).alias("q")).collect()  # one row a pivot
    cuts: list[tuple[int, list[float]]] = []
    for c in shape:
        rings = min(MOST_RINGS, max(1, -(-c["n"] // block_rows)))
        at = [c["q"][min(MOST_RINGS - 2, i * MOST_RINGS // rings - 1)] for i in range(1, rings)]
        cuts.append((c["cell"], np.unique(np.array(at, float)).tolist()))
    # the ring is the number of cuts below; at most MOST_PIVOTS rows are broadcast for it
    at_cell = F.broadcast(rows.sparkSession.createDataFrame(cuts, "cell int, cuts array<double>"))
    ring_of = F.size(F.filter("cuts", lambda c: c < F.col("away"))).alias("ring")
    ringed = cells.join(at_cell, "cell").select("id", "x", "cell", "away", ring_of)
    ranges = ringed.groupBy("cell", "ring").agg(F.min("away").alias("lo"), F.max("away").alias("hi"), F.count("*").alias("n")).orderBy("cell", "ring").toPandas()  # at most pivots x rings
    queries = ringed if query_ids is None else ringed.join(query_ids.select("id").distinct(), "id", "left_semi")
    own = cut_lineage(_meet(queries.select("cell", "ring", "id", "x", F.lit(None).cast("double").alias("bound")), ringed, k, size, block_rows))
    # the k-th nearest so far; a ring with fewer rows gives no bound
    bound = own.groupBy("qid").agg(F.when(F.count("*") >= k, F.max("dist")).alias("bound"))
    asking = queries.join(bound.withColumnRenamed("qid", "id"), "id", "left").select("id", "x", "cell", "ring", "bound")
    cell, ring = ranges["cell"].to_numpy(), ranges["ring"].to_numpy()
    lo, hi = ranges["lo"].to_numpy(), ranges["hi"].to_numpy()

    def seen_by(x: np.ndarray, home: np.ndarray, at: np.ndarray, reach: np.ndarray) -> np.ndarray:
        """Which rings, but the own one, can hold a row within ``reach`` of each query."""
        squares = _squares(x, pivots)
        far = np.sqrt(squares)
        # what rounding may have taken from a distance, on the safe side
        loose = np.sqrt(ROUNDING * ((x * x).sum(1) + (pivots * pivots).sum(1).max()))
        reach = (reach * (1 + SLACK) + loose)[:, None]
        away = np.maximum(far[:, cell] - hi, lo - far[:, cell])
        apart = np.sqrt(_squares(pivots[home], pivots))
        with np.errstate(divide="ignore", invalid="ignore"):
            plane = (squares - squares[np.arange(len(x)), home][:, None]) / (2 * apart) - loose[:, None] * (1 + loose[:, None] / apart)
        plane = np.where(apart > loose[:, None], plane, 0.0)
        visit = (away <= reach) & (plane[:, cell] <= reach)
        return visit & ~((cell[None, :] == home[:, None]) & (ring[None, :] == at[:, None]))

    def to_others(batches):
        for batch in batches:
            home, at = batch["cell"].to_numpy(), batch["ring"].to_numpy()
            bound = np.nan_to_num(batch["bound"].to_numpy(zero_copy_only=False), nan=np.inf, posinf=np.inf)
            x = _matrix(batch["x"], size)
            for i in range(0, len(x), TILE):
                some = slice(i, i + TILE)
                q, b = np.nonzero(seen_by(x[some], home[some], at[some], np.sqrt(bound[some])))
                for part in range(0, len(q), 10_000):
                    j, k_ = pa.array(i + q[part: part + 10_000]), b[part: part + 10_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(cell[k_]), pa.array(ring[k_]), batch["id"].take(j), batch["x"].take(j), batch["bound"].take(j)], ["cell", "ring", "id", "x", "bound"])

    others = cut_lineage(asking.mapInArrow(to_others, "cell int, ring int, id long, x array<double>, bound double"))
    found = own.unionByName(_meet(others, ringed, k, size, block_rows))
    size_of = ringed.groupBy("cell", "ring").agg(F.count("*").alias("n"))
    met = queries.select("cell", "ring").unionByName(others.select("cell", "ring")).groupBy("cell", "ring").agg(F.count("*").alias("q"))
    pairs = met.join(size_of, ["cell", "ring"]).agg(F.sum(F.col("q") * F.col("n"))).first()[0]
    return Neighbours(_best(found, k), int(pairs or 0))
