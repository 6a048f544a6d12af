"""Exact medians without gathering a column in one task.

All columns go together, in a fixed number of passes: approximate quantiles narrow
each median to a band of values that surely holds it (again inside the band while
that still holds many rows), then the rows below the band are counted, the distinct
values inside it are grouped, and running counts per column pick the middle. Only the
band limits, the counts and the middle values come to the driver.
The middle is the pandas/numpy definition: mean of the two middle values for an
even count.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ACCURACY = 10_000  # rank error of a narrowing pass <= rows / ACCURACY
BAND_ROWS = 1_000_000  # a band with more rows is narrowed again


def exact_medians(df: DataFrame, cols: Sequence[str], accuracy: int = ACCURACY, band_rows: int = BAND_ROWS) -> dict[str, float | None]:
    """Exact median of each column (nulls ignored; None for a column without values)."""
    cols = list(cols)
    if not cols:
        return {}
    eps = 2.0 / accuracy
    x = {c: F.col(f"`{c}`").cast("double") for c in cols}

    def quantiles(at: dict[str, float], inside: dict[str, Column]) -> dict[str, tuple[float, float]]:
        """Values surely below and above a share of the rows that are inside."""
        aggs = [F.percentile_approx(inside[c], [max(0.0, q - eps), min(1.0, q + eps)], accuracy).alias(f"b{i}") for i, (c, q) in enumerate(at.items())]
        row = df.agg(*aggs).first()
        return {c: tuple(map(float, row[f"b{i}"])) for i, c in enumerate(at) if row[f"b{i}"]}

    def in_band(c: str) -> Column:
        lo, hi = bands[c]
        return F.when((x[c] >= F.lit(lo)) & (x[c] <= F.lit(hi)), x[c])

    def counts() -> dict[str, tuple[int, int, int]]:
        """Rows of each column below its band, inside it, and of equal limits."""
        aggs = []
        for i, c in enumerate(bands):
            aggs += [F.count(x[c]).alias(f"n{i}"), F.count(F.when(x[c] < F.lit(bands[c][0]), 1)).alias(f"l{i}"), F.count(in_band(c)).alias(f"m{i}")]
        row = df.agg(*aggs).first()
        return {c: (row[f"n{i}"], row[f"l{i}"], row[f"m{i}"]) for i, c in enumerate(bands)}

    bands = quantiles(dict.fromkeys(cols, 0.5), x)
    out: dict[str, float | None] = {c: None for c in cols if c not in bands}
    if not bands:
        return out
    found = counts()
    wide = {c: ((n - 1) / 2 - low) / m for c, (n, low, m) in found.items() if m > band_rows and bands[c][0] < bands[c][1]}
    if wide:
        bands |= quantiles(wide, {c: in_band(c) for c in wide})
        found = counts()
    values = F.array(*[F.struct(F.lit(c).alias("c"), in_band(c).alias("v")) for c in bands])
    hist = df.select(F.explode(values).alias("x")).filter("x.v is not null").groupBy("x.c", "x.v").agg(F.count(F.lit(1)).alias("k"))
    running = F.sum("k").over(Window.partitionBy("c").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    ranks = F.create_map(*[e for c, (n, low, _) in found.items() for e in (F.lit(c), F.array(F.lit((n - 1) // 2 - low), F.lit(n // 2 - low)))])
    hist = hist.withColumn("upto", running).withColumn("r", ranks[F.col("c")])
    holds = lambda i: (F.col("r")[i] < F.col("upto")) & (F.col("r")[i] >= F.col("upto") - F.col("k"))
    picked = hist.select("c", "v", holds(0).alias("first"), holds(1).alias("second")).filter("first or second").collect()
    middle: dict[str, list[float]] = {c: [] for c in bands}
    for r in picked:
        middle[r["c"]] += [r["v"]] * (r["first"] + r["second"])
    for c, v in middle.items():
        if len(v) != 2:
            raise RuntimeError(f"median band of {c} missed the middle rank")
        out[c] = sum(v) / 2.0
    return out


def fill_median(df: DataFrame, cols: Sequence[str], medians: dict[str, float | None] | None = None) -> tuple[DataFrame, dict]:
    """Replace nulls of ``cols`` with the column median (computed when not given).
    Only columns that contain nulls are touched."""
    if medians is None:
        nulls = df.agg(*[F.sum(F.col(c).isNull().cast("int")).alias(c) for c in cols]).first()
        need = [c for c in cols if nulls[c]]
        medians = exact_medians(df, need)
    fills = {c: F.coalesce(F.col(c).cast("double"), F.lit(v)) for c, v in medians.items() if v is not None}
    return (df.withColumns(fills) if fills else df), medians
