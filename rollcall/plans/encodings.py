"""Encodings of nominal columns as a table (A5, P6, J3), for any number of categories.

``features.fit_feature_state`` keeps the categories at the driver and writes each as a
column of its own. Here they stay a table: one row for each (column, category) with its
outcome sum, count, rate and place in the order of the column's categories. Rates come to
the rows by a join on the category, and all one-hot columns are one sparse vector, whose
slots are those of the single columns: columns in order, categories in order, without the
first of each.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rollcall import constants as K
from rollcall.operators.history import overall_rate
from rollcall.plans import features as P
from rollcall.session import cut_lineage

#: Bytes of a column's categories up to which they are broadcast; above, rows and
#: categories are shuffled, and Spark splits a category that holds many rows.
BROADCAST_BYTES = 10 << 20


def encoding_table(df: DataFrame, columns: Sequence[str] = tuple(K.NOMINAL_COLUMNS), outcome: str = "attended") -> DataFrame:
    """(column, value, y_sum, y_n, rate, place) of every category; nulls are none. One pass
    with a partial aggregate; places are found within ranges of (column, value) and added up
    over the ranges, so no column is numbered in one task."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]))
    long = df.select(pairs.alias("c"), F.col(outcome).alias("_y")).select("c.*", "_y").filter("value is not null")
    sums = long.groupBy("column", "value").agg(F.coalesce(F.sum("_y"), F.lit(0)).cast("long").alias("y_sum"), F.count("_y").alias("y_n"))
    ranges = cut_lineage(sums.repartitionByRange("column", "value").withColumn("_p", F.spark_partition_id()))
    sizes = ranges.groupBy("column", "_p").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("column").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("column", "_p", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    here = F.row_number().over(Window.partitionBy("_p", "column").orderBy("value")) - 1
    placed = ranges.withColumn("_here", here).join(before, ["column", "_p"])
    rate = F.try_divide(F.col("y_sum").cast("double"), F.col("y_n"))
    return cut_lineage(placed.select("column", "value", "y_sum", "y_n", rate.alias("rate"), (F.col("_before") + F.col("_here")).cast("long").alias("place")))


def category_sizes(encodings: DataFrame, columns: Sequence[str]) -> dict[str, tuple[int, int]]:
    """Categories and their bytes, for each column."""
    rows = encodings.groupBy("column").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("value") + 40).alias("bytes")).collect()
    found = {r["column"]: (r["n"], r["bytes"]) for r in rows}
    return {c: found.get(c, (0, 0)) for c in columns}


def join_encodings(df: DataFrame, encodings: DataFrame, rates: dict[str, str], broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with the rate of each column's category (``rates``: column to name of its rate)
    and its place as ``_place_<column>``; both are null for a null or unknown category."""
    sizes = category_sizes(encodings, list(rates))
    for c, name in rates.items():
        e = encodings.filter(F.col("column") == c).select(F.col("value").alias("_value"), F.col("rate").alias(name), F.col("place").alias(f"_place_{c}"))
        e = F.broadcast(e) if sizes[c][1] <= broadcast_bytes else e.hint("merge")
        df = df.join(e, F.col(c).cast("string") == F.col("_value"), "left").drop("_value")
    return df


def one_hot_vector(df: DataFrame, encodings: DataFrame, columns: Sequence[str], out: str = "one_hot") -> DataFrame:
    """Turn the places of ``join_encodings`` into one sparse vector. The first category of a
    column, null and unknown ones have no slot."""
    sizes = category_sizes(encodings, columns)
    # the encoder drops the last slot of a column: that of whatever has none of its own
    last = {c: max(sizes[c][0], 1) - 1 for c in columns}
    slots, hots = [f"_slot_{c}" for c in columns], [f"_hot_{c}" for c in columns]
    widths = df.sparkSession.range(1).select(*[F.lit(float(last[c])).alias(s) for c, s in zip(columns, slots)])
    encoder = OneHotEncoder(inputCols=slots, outputCols=hots, dropLast=True).fit(widths)
    place = {s: F.coalesce(F.when(F.col(f"_place_{c}") > 0, F.col(f"_place_{c}") - 1), F.lit(last[c])).cast("double") for c, s in zip(columns, slots)}
    placed = df.withColumns(place).drop(*[f"_place_{c}" for c in columns])
    return VectorAssembler(inputCols=hots, outputCol=out).transform(encoder.transform(placed)).drop(*slots, *hots)


def wide_features(df: DataFrame, hot_rows: int | None = None, broadcast_bytes: int = BROADCAST_BYTES) -> tuple[DataFrame, DataFrame]:
    """M1 without a bound on categories: the features of ``run_feature_pipeline`` with the
    one-hot columns as the vector ``one_hot``, and the table of encodings."""
    encodings = encoding_table(df, list(P.RATE_FEATURES))
    out = P.student_history(P.temporal_features(df), overall_rate(df), hot_rows)
    out = join_encodings(out, encodings, P.RATE_FEATURES, broadcast_bytes)
    mean = df.agg(F.avg(F.col("num_registrations").cast("double"))).scalar()
    out = P.interaction_features(out.withColumn("registration_density", F.col("num_registrations") / mean))
    none = P.FeatureState(categories={}, rates={}, overall_rate=0.0, mean_registrations=0.0)
    return one_hot_vector(P.encode_categoricals(out, none), encodings, list(K.NOMINAL_COLUMNS)), encodings
