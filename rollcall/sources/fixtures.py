"""Map the driver tables onto the registration data model.

customer -> students, part -> workshop events, lineitem JOIN orders grouped per
(customer, part) -> registrations. The label is the rule scorecard compared
with a fixed pseudo-uniform draw (``qty``) that is dropped afterwards, and the
history columns are recomputed with the W7 window. Every step is a DataFrame
transform; the only shuffles are the fact aggregation, the dimension joins and
the per-student window. Rows are shuffled narrow, with the tables' own keys and codes;
texts and dates are functions of those and are added after the last join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall import constants as K
from rollcall.functions.scorecard import score_pct

FLAT_COLUMNS = [
    "student_id",
    "event_id",
    "registration_timing",
    "department",
    "semester",
    "club_activity_level",
    "cgpa",
    "event_date",
    "topic",
    "speaker_type",
    "day_of_week",
    "time_slot",
    "duration_minutes",
    "mode",
    "exam_proximity",
    "promotion_level",
    "num_registrations",
    "attended",
    "past_attendance_rate",
    "past_events_count",
]
STUDENT_COLUMNS = ["student_id", "department", "semester", "club_activity_level", "cgpa"]
EVENT_COLUMNS = [
    "event_id",
    "event_date",
    "topic",
    "speaker_type",
    "day_of_week",
    "time_slot",
    "duration_minutes",
    "mode",
    "exam_proximity",
    "promotion_level",
    "num_registrations",
]
REGISTRATION_COLUMNS = [
    "student_id",
    "event_id",
    "registration_timing",
    "attended",
    "past_attendance_rate",
    "past_events_count",
]


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _pick(index: F.Column, values: list[str]) -> F.Column:
    """values[index] for a 0-based integer column."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def _key(prefix: str, key: str) -> F.Column:
    """Prefix and the key with at least six digits; longer keys stay whole."""
    digits = F.col(key).cast("string")
    return F.concat(F.lit(prefix), F.lpad(digits, F.greatest(F.lit(6), F.length(digits)), "0"))


def _student_columns() -> list[F.Column]:
    """A student's columns, from those of ``customer``."""
    seg = F.col("c_mktsegment")
    return [
        _key("STU_", "c_custkey").alias("student_id"),
        _pick(F.col("c_nationkey") % 4, K.DEPARTMENTS).alias("department"),
        (F.col("c_custkey") % 8 + 1).cast("int").alias("semester"),
        F.when(seg.isin("AUTOMOBILE", "BUILDING"), "Low")
        .when(seg.isin("FURNITURE", "HOUSEHOLD"), "Medium")
        .otherwise("High")
        .alias("club_activity_level"),
        F.when(F.col("c_custkey") % 97 == 0, F.lit(None).cast("double"))
        .otherwise(F.floor(F.lit(300) + (F.col("c_acctbal") + 1000) * 700 / 11000) / F.lit(100.0))
        .alias("cgpa"),
    ]


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")


def students(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _customers(spark, sf_dir).select(*_student_columns())


def _event_date() -> F.Column:
    return F.date_add(F.lit("2024-07-15").cast("date"), (F.col("p_partkey") * 37 % 300).cast("int"))


def _event_keys() -> list[F.Column]:
    """What orders a student's history, from the key of ``part``."""
    return [_key("EVT_", "p_partkey").alias("event_id"), _event_date().alias("event_date")]


def _event_columns() -> list[F.Column]:
    """An event's other columns but ``num_registrations``, from those of ``part``."""
    k = F.col("p_partkey")
    ptype = F.col("p_type")
    return [
        _pick(F.col("p_size") % 16, K.TOPICS).alias("topic"),
        F.when(ptype == "ECONOMY", "Industry")
        .when(ptype == "LARGE", "Alumni")
        .when(ptype.isin("MEDIUM", "PROMO"), "Faculty")
        .otherwise("Student")
        .alias("speaker_type"),
        _pick(F.weekday(_event_date()), K.DAY_ORDER).alias("day_of_week"),
        _pick(k % 3, K.TIME_SLOTS).alias("time_slot"),
        (F.lit(60) + 30 * (k % 5)).cast("int").alias("duration_minutes"),
        F.when(k % 7 < 4, "Offline").otherwise("Online").alias("mode"),
        F.when(k % 11 < 2, 1).when(k % 11 < 6, 2).otherwise(3).cast("int").alias("exam_proximity"),
        F.when(k % 13 < 3, "Low").when(k % 13 < 9, "Medium").otherwise("High").alias("promotion_level"),
    ]


def _parts(spark: SparkSession, sf_dir: str, grain: DataFrame) -> DataFrame:
    """``part`` with ``num_registrations`` (J2: left join of counts, missing -> 0)."""
    counts = grain.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"))
    p = _read(spark, sf_dir, "part").select("p_partkey", "p_type", "p_size")
    counted = p.join(counts, F.col("p_partkey") == F.col("l_partkey"), "left")
    return counted.select("p_partkey", "p_type", "p_size", F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("num_registrations"))


def registration_grain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (customer, part): the hidden draw ``qty`` and the best priority ``pr``."""
    li = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    o = _read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    # priorities are "<digit>-<NAME>": the minimum string is the one with the smallest
    # leading digit, so aggregate the digit (hash aggregate instead of a sort aggregate)
    o = o.select("o_orderkey", "o_custkey", F.substring("o_orderpriority", 1, 1).cast("int").alias("prio"))
    met = li.join(o, li.l_orderkey == o.o_orderkey)
    return met.groupBy("o_custkey", "l_partkey").agg(F.min("l_quantity").alias("qty"), F.min("prio").alias("pr"))


def events(spark: SparkSession, sf_dir: str, grain: DataFrame | None = None) -> DataFrame:
    """Event dimension with ``num_registrations`` (J2: left join of counts, missing -> 0)."""
    grain = grain if grain is not None else registration_grain(spark, sf_dir)
    return _parts(spark, sf_dir, grain).select(*_event_keys(), *_event_columns(), "num_registrations").select(*EVENT_COLUMNS)


def _labelled_rows(spark: SparkSession, sf_dir: str, grain: DataFrame | None) -> tuple[DataFrame, list[F.Column]]:
    """Facts with the dimensions' own narrow columns, the history's keys and the label, and
    the columns of the flat table that are functions of them. ``grain`` is read twice (for
    the counts and for the rows): give a stored one to join the facts once."""
    grain = grain if grain is not None else registration_grain(spark, sf_dir)
    rows = grain.join(_parts(spark, sf_dir, grain), F.col("l_partkey") == F.col("p_partkey")).drop("l_partkey")
    rows = rows.join(_customers(spark, sf_dir), F.col("o_custkey") == F.col("c_custkey")).drop("o_custkey")
    pr = F.col("pr")
    timing = F.when(pr == 1, "Early").when(pr.isin(2, 3), "On-time").otherwise("Late").alias("registration_timing")
    columns = [*_student_columns(), *_event_columns(), timing]
    scored = rows.select(*rows.columns, *_event_keys(), *columns)
    label = F.when(2 * F.col("qty") + 10 <= score_pct(scored.columns), 1).otherwise(0).cast("int")
    kept = [c for c in rows.columns if c != "qty"]
    return scored.select(*kept, "event_id", "event_date", label.alias("attended")), columns


def labelled_flat(spark: SparkSession, sf_dir: str, grain: DataFrame | None = None) -> DataFrame:
    """Flat rows with the planted label, before the history columns."""
    rows, columns = _labelled_rows(spark, sf_dir, grain)
    flat = rows.select("event_id", "event_date", "num_registrations", "attended", *columns)
    first = ["event_id", "student_id", "registration_timing"]
    dimensions = [c for c in (*STUDENT_COLUMNS, *EVENT_COLUMNS) if c not in first]
    return flat.select(*first, *dimensions, "attended")


def registrations_flat(spark: SparkSession, sf_dir: str, grain: DataFrame | None = None) -> DataFrame:
    """The 20-column flat registration table (FLAT_COLUMNS order). The window's rows are
    dealt by the customer's key, as the join before it is."""
    from rollcall.operators.history import recalculate_history

    rows, columns = _labelled_rows(spark, sf_dir, grain)
    known = recalculate_history(rows, entity="c_custkey")
    flat = known.select("event_id", "event_date", "num_registrations", "attended", "past_attendance_rate", "past_events_count", *columns)
    return flat.select(*FLAT_COLUMNS)


def star_tables(spark: SparkSession, sf_dir: str, flat: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(students, events, registrations) of the mapped data (or of a stored ``flat``)."""
    flat = flat if flat is not None else registrations_flat(spark, sf_dir)
    from rollcall.sources.tables import normalise_events, normalise_students, project_registrations

    return normalise_students(flat), normalise_events(flat), project_registrations(flat)


def activity_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second fixture: the driver ``events`` stream as (entity, ts, event_id, outcome, category)."""
    e = _read(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    return e.select(
        F.col("user_id").alias("user_id"),
        F.col("ts"),
        F.col("event_id"),
        F.col("event_type"),
        (F.col("event_type") == "purchase").cast("int").alias("outcome"),
    )
