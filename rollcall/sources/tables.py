"""Table loading, star <-> flat conversion and sinks.

Dimension rows are de-duplicated with ``min_by`` over the key and an explicit
order (first occurrence in (event_date, event_id) order for students, the row
itself for events) instead of ``dropDuplicates``, whose survivor is not
deterministic.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollcall.sources.fixtures import EVENT_COLUMNS, FLAT_COLUMNS, REGISTRATION_COLUMNS, STUDENT_COLUMNS

# S1 schema of the flat registration CSV (event_date read as text, parsed later)
REGISTRATION_FLAT = T.StructType(
    [
        T.StructField("student_id", T.StringType()),
        T.StructField("event_id", T.StringType()),
        T.StructField("registration_timing", T.StringType()),
        T.StructField("department", T.StringType()),
        T.StructField("semester", T.IntegerType()),
        T.StructField("club_activity_level", T.StringType()),
        T.StructField("cgpa", T.DoubleType()),
        T.StructField("event_date", T.StringType()),
        T.StructField("topic", T.StringType()),
        T.StructField("speaker_type", T.StringType()),
        T.StructField("day_of_week", T.StringType()),
        T.StructField("time_slot", T.StringType()),
        T.StructField("duration_minutes", T.IntegerType()),
        T.StructField("mode", T.StringType()),
        T.StructField("exam_proximity", T.IntegerType()),
        T.StructField("promotion_level", T.StringType()),
        T.StructField("num_registrations", T.LongType()),
        T.StructField("attended", T.IntegerType()),
        T.StructField("past_attendance_rate", T.DoubleType()),
        T.StructField("past_events_count", T.LongType()),
    ]
)


def scan_registrations(spark: SparkSession, path: str, lenient_dates: bool = True) -> DataFrame:
    """S1 + S2/S3: read the flat CSV with a declared schema; parse ``event_date``.

    ``lenient_dates`` -> bad dates become null (S2); otherwise ANSI ``to_date``
    raises on a bad value (S3)."""
    df = spark.read.schema(REGISTRATION_FLAT).option("header", True).csv(path)
    return df.withColumn("event_date", parse_event_date(F.col("event_date"), lenient=lenient_dates))


def scan_checked(spark: SparkSession, path: str) -> DataFrame:
    """S1 with its faults: all rows of the flat CSV, typed, and ``reasons``: the columns
    whose value could not be read, and ``fields`` for a line with too few or too many.
    One scan; a field that is empty is null and no fault."""
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in REGISTRATION_FLAT] + [T.StructField("_line", T.StringType())])
    raw = spark.read.schema(text).option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_line").csv(path)
    value, fault = [], [F.when(F.col("_line").isNotNull(), F.lit("fields"))]
    for f in REGISTRATION_FLAT:
        c = F.col(f.name)
        typed = parse_event_date(c) if f.name == "event_date" else c.try_cast(f.dataType) if f.dataType != T.StringType() else c
        value.append(typed.alias(f.name))
        if f.dataType != T.StringType() or f.name == "event_date":
            fault.append(F.when(c.isNotNull() & typed.isNull(), F.lit(f.name)))
    return raw.select(*value, "_line", F.array_compact(F.array(*fault)).alias("reasons"))


def accepted(checked: DataFrame) -> DataFrame:
    return checked.filter(F.size("reasons") == 0).drop("_line", "reasons")


def quarantined(checked: DataFrame) -> DataFrame:
    """Rows with a fault, to be stored beside the accepted ones and mended."""
    return checked.filter(F.size("reasons") > 0)


def parse_event_date(col: F.Column, lenient: bool = True) -> F.Column:
    """S2 lenient (``try_to_date``) or S3 strict (``to_date``, fails on bad input under ANSI)."""
    if lenient:
        return F.try_to_date(col.cast("string"), "yyyy-MM-dd")
    return F.to_date(col.cast("string"), "yyyy-MM-dd")


def _first_per_key(df: DataFrame, key: str, columns: list[str], order: list[str]) -> DataFrame:
    """The row with the smallest ``order`` per key, as a partial/final aggregate
    (``min_by``): a key holding many rows never gathers them in one task."""
    rest = [c for c in columns if c != key]
    picked = df.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return picked.select(key, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*columns)


def normalise_students(flat: DataFrame) -> DataFrame:
    """One row per student (first occurrence in history order); cgpa optional."""
    cols = [c for c in STUDENT_COLUMNS if c in flat.columns]
    return _first_per_key(flat, "student_id", cols, ["event_date", "event_id"])


def normalise_events(flat: DataFrame) -> DataFrame:
    """One row per event (11 columns)."""
    return _first_per_key(flat, "event_id", EVENT_COLUMNS, ["student_id"])


def project_registrations(flat: DataFrame) -> DataFrame:
    """The fact table with its declared types."""
    return flat.select(
        "student_id",
        "event_id",
        "registration_timing",
        F.col("attended").cast("int").alias("attended"),
        F.col("past_attendance_rate").cast("double").alias("past_attendance_rate"),
        F.col("past_events_count").cast("long").alias("past_events_count"),
    )


def merge_new_dimension_rows(incoming: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Rows of ``incoming`` whose key is absent from ``existing`` (existing untouched).

    The result is what gets appended; appending it keeps the key unique."""
    return incoming.join(existing.select(key), key, "left_anti")


def load_fact_once(incoming: DataFrame, target: DataFrame | None) -> DataFrame:
    """The fact rows to load -- all of them when the target is empty, none otherwise."""
    if target is None:
        return incoming
    # looked at when the query runs: no job while the plan is built
    held = target.limit(1).agg(F.count(F.lit(1))).scalar()
    return incoming.filter(held == 0)


def denormalise(students: DataFrame, events: DataFrame, registrations: DataFrame) -> DataFrame:
    """Fact JOIN students JOIN events back to the 20-column flat table.

    Inner equi-joins; AQE picks broadcast vs shuffled join from runtime sizes and
    splits skewed partitions of the fact side."""
    return registrations.join(students, "student_id").join(events, "event_id").select(*FLAT_COLUMNS)


def load_with_fallback(spark: SparkSession, table_dir: str | None, csv_path: str) -> DataFrame:
    """Read the star tables and join them; fall back to the flat CSV."""
    if table_dir:
        try:
            s = spark.read.parquet(f"{table_dir}/students")
            e = spark.read.parquet(f"{table_dir}/events")
            r = spark.read.parquet(f"{table_dir}/registrations")
            return denormalise(s, e, r)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
    return scan_registrations(spark, csv_path)


def write_star(students: DataFrame, events: DataFrame, registrations: DataFrame, table_dir: str) -> None:
    """Persist the star tables (registrations bucketed-by-key layout is left to the writer)."""
    students.write.mode("overwrite").parquet(f"{table_dir}/students")
    events.write.mode("overwrite").parquet(f"{table_dir}/events")
    registrations.write.mode("overwrite").parquet(f"{table_dir}/registrations")


def sink_dataset(df: DataFrame, path: str, version: str) -> str:
    """Write the flat dataset to a new versioned path (the previous version stays as backup)."""
    target = f"{path.rstrip('/')}/version={version}"
    df.write.mode("overwrite").parquet(target)
    return target


RETRAIN_LOG_SCHEMA = T.StructType(
    [
        T.StructField("ts", T.TimestampType()),
        T.StructField("model", T.StringType()),
        T.StructField("f1", T.DoubleType()),
        T.StructField("auc", T.DoubleType()),
        T.StructField("deployed", T.BooleanType()),
        T.StructField("rows", T.LongType()),
    ]
)


def retrain_log_append(spark: SparkSession, log_path: str, rows: list[tuple]) -> None:
    """Append retrain attempts to the log table."""
    spark.createDataFrame(rows, RETRAIN_LOG_SCHEMA).write.mode("append").parquet(log_path)


def retrain_log_tail(log: DataFrame, n: int = 10) -> DataFrame:
    """The last ``n`` attempts, oldest first."""
    return log.orderBy(F.col("ts").desc()).limit(n).orderBy("ts")


__all__ = [
    "REGISTRATION_FLAT",
    "REGISTRATION_COLUMNS",
    "scan_registrations",
    "parse_event_date",
    "normalise_students",
    "normalise_events",
    "project_registrations",
    "merge_new_dimension_rows",
    "load_fact_once",
    "denormalise",
    "load_with_fallback",
    "write_star",
    "sink_dataset",
    "retrain_log_append",
    "retrain_log_tail",
]
