"""Turnout breakdowns and summaries.

``rate`` is always the mean of the outcome, rounded half-even to 4 decimals
(``bround``). Null group keys are dropped, as the pandas group-by does. Every
breakdown is a partial/final hash aggregate (map-side combine), so a hot group
key never gathers its rows in one task; ``all_breakdowns`` computes all chart
dimensions in ONE scan with grouping sets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall import constants as K
from rollcall.functions.scalar import day_index, lookup


def _rate(outcome: str = "attended", digits: int = 4) -> Column:
    return F.bround(F.avg(F.col(outcome).cast("double")), digits)


def _lit_table(df: DataFrame, name: str, values: Sequence, with_position: bool = True) -> DataFrame:
    """A tiny literal table derived from the session of ``df`` (fixed size)."""
    arr = F.array(*[F.struct(F.lit(v).alias(name), F.lit(i).alias("position")) for i, v in enumerate(values)])
    out = df.sparkSession.range(1).select(F.inline(arr))
    return out if with_position else out.drop("position")


# ---- A1 ---------------------------------------------------------------------------
def overview(df: DataFrame, approx: bool = False) -> DataFrame:
    distinct = F.approx_count_distinct if approx else F.count_distinct
    return df.agg(
        distinct("event_id").cast("long").alias("total_events"),
        distinct("student_id").cast("long").alias("total_students"),
        F.count(F.lit(1)).alias("registrations"),
        F.coalesce(_rate(), F.lit(0.0)).alias("avg_attendance"),
    )


#: log2 of a sketch's registers; the standard error of an estimate is below 1.04 / sqrt(2^k).
SKETCH_BITS = 12


def day_sketches(df: DataFrame, bits: int = SKETCH_BITS) -> DataFrame:
    """A1, approximate: one row a day with counts and mergeable sketches of the distinct
    events and students. Stored once, it answers A1 for any span of days without the rows."""
    return df.groupBy("event_date").agg(
        F.hll_sketch_agg("event_id", bits).alias("events"),
        F.hll_sketch_agg("student_id", bits).alias("students"),
        F.count(F.lit(1)).alias("registrations"),
        F.sum("attended").alias("attended"),
        F.count("attended").alias("known"),
    )


def overview_of_days(days: DataFrame, *by) -> DataFrame:
    """A1 over the days given, for each group of them: sketches are merged, not rows."""
    return days.groupBy(*by).agg(
        F.hll_sketch_estimate(F.hll_union_agg("events")).alias("total_events"),
        F.hll_sketch_estimate(F.hll_union_agg("students")).alias("total_students"),
        F.sum("registrations").alias("registrations"),
        F.coalesce(F.try_divide(F.sum("attended"), F.sum("known")), F.lit(0.0)).alias("avg_attendance"),
    )


# ---- A2 / A3 / A4 / A6 / A7 --------------------------------------------------------
def rate_by(df: DataFrame, col: str, outcome: str = "attended") -> DataFrame:
    """A2: mean outcome per label, highest first (ties by label)."""
    return (
        df.filter(F.col(col).isNotNull())
        .groupBy(F.col(col).alias("label"))
        .agg(_rate(outcome).alias("rate"))
        .orderBy(F.col("rate").desc(), "label")
    )


def rate_by_day(df: DataFrame) -> DataFrame:
    """A3: canonical Monday..Sunday order, only the days present."""
    g = df.filter(F.col("day_of_week").isNotNull()).groupBy(F.col("day_of_week").alias("label")).agg(_rate().alias("rate"))
    return g.filter(day_index("label").isNotNull()).orderBy(day_index("label"))


def rate_by_semester(df: DataFrame) -> DataFrame:
    """A4: sorted by semester; label is the integer as text."""
    g = df.filter(F.col("semester").isNotNull()).groupBy("semester").agg(_rate().alias("rate"))
    return g.orderBy("semester").select(F.col("semester").cast("int").cast("string").alias("label"), "rate")


def rate_by_exam(df: DataFrame) -> DataFrame:
    """Dense labels 1, 2, 3; an absent label has rate 0.0."""
    g = df.groupBy(F.col("exam_proximity").alias("label")).agg(_rate().alias("r"))
    labels = _lit_table(df, "label", [1, 2, 3])
    return (
        labels.join(g, "label", "left")
        .select(F.col("label").cast("int").alias("label"), F.coalesce("r", F.lit(0.0)).alias("rate"), "position")
        .orderBy("position")
        .drop("position")
    )


def rate_by_club(df: DataFrame, dense: bool = False) -> DataFrame:
    """Order Low, Medium, High. ``dense`` keeps all three (0.0 when absent)."""
    g = df.groupBy(F.col("club_activity_level").alias("label")).agg(_rate().alias("r"))
    labels = _lit_table(df, "label", K.LEVELS)
    how = "left" if dense else "inner"
    return (
        labels.join(g, "label", how)
        .select("label", F.coalesce("r", F.lit(0.0)).alias("rate"), "position")
        .orderBy("position")
        .drop("position")
    )


# ---- A8 ---------------------------------------------------------------------------
def monthly_trend(df: DataFrame) -> DataFrame:
    """Per ``yyyy-MM`` registrations, attended and rate; null dates dropped."""
    return (
        drop_null_dates(df)
        .groupBy(F.date_format("event_date", "yyyy-MM").alias("month"))
        .agg(
            F.count(F.lit(1)).alias("registrations"),
            F.sum("attended").cast("long").alias("attended"),
            _rate().alias("rate"),
        )
        .orderBy("month")
    )


def drop_null_dates(df: DataFrame, col: str = "event_date") -> DataFrame:
    """P12."""
    return df.filter(F.col(col).isNotNull())


def day_slot_rates(df: DataFrame) -> DataFrame:
    """A9 in long form, for any number of slots and without a look at the data: one row
    for each canonical day and slot that occur, also where no row has both (rate 0.0)."""
    known = df.filter(F.col("day_of_week").isNotNull() & F.col("time_slot").isNotNull())
    cells = known.groupBy("day_of_week", "time_slot").agg(_rate().alias("rate"))
    # the days are seven at most, so each slot is written out for all that occur
    day = F.array(*[F.lit(d) for d in K.DAY_ORDER])
    present = df.agg(F.collect_set(F.when(F.array_contains(day, F.col("day_of_week")), F.col("day_of_week")))).scalar()
    grid = cells.select("time_slot").distinct().select(F.explode(present).alias("day_of_week"), "time_slot")
    return grid.join(cells, ["day_of_week", "time_slot"], "left").select("day_of_week", "time_slot", F.coalesce("rate", F.lit(0.0)).alias("rate"))


# ---- A9 ---------------------------------------------------------------------------
def day_slot_heatmap(df: DataFrame, slots: Sequence[str] | None = None) -> DataFrame:
    """Days (canonical order, present only) x slots (sorted) of mean rate; missing 0.0.

    The slot list is fitted with one small distinct aggregate when not given."""
    base = df.filter(F.col("day_of_week").isNotNull())
    if slots is None:
        limit = 1000  # pivot columns are categories; refuse a runaway pivot instead of collecting it
        slots = [r[0] for r in base.select("time_slot").where(F.col("time_slot").isNotNull()).distinct().limit(limit + 1).collect()]
        if len(slots) > limit:
            raise ValueError(f"more than {limit} time slots; a pivot is not meaningful")
    slots = sorted(slots)
    pivoted = base.groupBy("day_of_week").pivot("time_slot", slots).agg(_rate())
    return (
        pivoted.fillna(0.0, subset=slots)
        .filter(day_index("day_of_week").isNotNull())
        .orderBy(day_index("day_of_week"))
    )


# ---- P11 + A10-A12 ------------------------------------------------------------------
def filter_school_topic_dates(
    df: DataFrame,
    topic: str | None = None,
    school: str | None = None,
    date_from: str | None = None,
    date_to: str | None = None,
) -> DataFrame:
    """Conditional filter chain. "All ..." or empty means no filter; date bounds are
    inclusive and compared as times (an event counts as midnight of its day), an
    unparsable bound is ignored, null dates drop out when a bound applies."""
    day = F.col("event_date").cast("timestamp")
    asked = [
        (F.col("department"), "=", _choice(school, "All Schools")),
        (day, ">=", _parse_bound(date_from)),
        (day, "<=", _parse_bound(date_to)),
        (F.col("topic"), "=", _choice(topic, "All Topics")),
    ]
    for column, op, value in asked:
        if value is not None:
            df = df.filter(column == value if op == "=" else column >= value if op == ">=" else column <= value)
    return df


def _choice(text: str | None, every: str) -> str | None:
    text = (text or "").strip()
    return text if text and text != every else None


def _parse_bound(text: str | None) -> Column | None:
    """A bound in any common notation, with or without a time; None if there is none."""
    import pandas as pd

    parsed = pd.to_datetime(text, errors="coerce") if text else None
    if parsed is None or pd.isna(parsed):
        return None
    if parsed.tzinfo is not None:
        parsed = parsed.tz_convert(None)
    return F.lit(parsed.isoformat(sep=" ")).cast("timestamp")


def topic_summary(df: DataFrame) -> DataFrame:
    """A10: distinct events, rows, attended, rate of the (filtered) slice; zeros if empty."""
    return df.agg(
        F.count_distinct("event_id").cast("long").alias("events"),
        F.count(F.lit(1)).alias("registrations"),
        F.coalesce(F.sum("attended"), F.lit(0)).cast("long").alias("attended"),
        F.coalesce(_rate(), F.lit(0.0)).alias("rate"),
    )


def topic_mode_breakdown(df: DataFrame) -> DataFrame:
    """Per mode count, attended and rate (sorted by mode)."""
    return (
        df.filter(F.col("mode").isNotNull())
        .groupBy(F.col("mode").alias("label"))
        .agg(F.count(F.lit(1)).alias("count"), F.sum("attended").cast("long").alias("attended"), _rate().alias("rate"))
        .orderBy("label")
    )


def topic_analysis(df: DataFrame, topic=None, school=None, date_from=None, date_to=None) -> dict[str, DataFrame]:
    """The slice and its five breakdowns."""
    s = filter_school_topic_dates(df, topic, school, date_from, date_to)
    return {
        "summary": topic_summary(s),
        "department": rate_by(s, "department"),
        "semester": rate_by_semester(s),
        "mode": topic_mode_breakdown(s),
        "club": rate_by_club(s, dense=True),
    }


# ---- A13 / A14 -----------------------------------------------------------------------
CHART_DIMENSIONS = [
    "topic",
    "day_of_week",
    "month",
    "speaker_type",
    "mode",
    "club_activity_level",
    "exam_proximity",
    "department",
    "semester",
    "day_of_week|time_slot",
]


def all_breakdowns(df: DataFrame) -> DataFrame:
    """Every chart breakdown in ONE scan (grouping sets), long format
    (dimension, label, registrations, attended, rate)."""
    base = df.select(
        "topic",
        "day_of_week",
        F.date_format("event_date", "yyyy-MM").alias("month"),
        "speaker_type",
        "mode",
        "club_activity_level",
        F.col("exam_proximity").cast("string").alias("exam_proximity"),
        "department",
        F.col("semester").cast("string").alias("semester"),
        "time_slot",
        "attended",
    )
    singles = [d for d in CHART_DIMENSIONS if "|" not in d]
    sets = [[d] for d in singles] + [["day_of_week", "time_slot"]]
    cols = singles + ["time_slot"]
    g = base.groupingSets(sets, *cols).agg(
        F.grouping_id(*cols).alias("_gid"),
        F.count(F.lit(1)).alias("registrations"),
        F.sum("attended").cast("long").alias("attended"),
        _rate().alias("rate"),
    )
    n = len(cols)
    dim_expr = None
    label_expr = None
    for s, name in zip(sets, CHART_DIMENSIONS):
        gid = sum(1 << (n - 1 - i) for i, c in enumerate(cols) if c not in s)
        lab = F.concat_ws("|", *[F.col(c) for c in s]) if len(s) > 1 else F.col(s[0])
        ok = F.col(s[0]).isNotNull() if len(s) == 1 else (F.col(s[0]).isNotNull() & F.col(s[1]).isNotNull())
        cond = (F.col("_gid") == gid) & ok
        dim_expr = F.when(cond, F.lit(name)) if dim_expr is None else dim_expr.when(cond, F.lit(name))
        label_expr = F.when(cond, lab) if label_expr is None else label_expr.when(cond, lab)
    return (
        g.select(dim_expr.alias("dimension"), label_expr.alias("label"), "registrations", "attended", "rate")
        .filter(F.col("dimension").isNotNull())
    )


KEY_FACTORS = [
    "club_activity_level",
    "registration_timing",
    "speaker_type",
    "exam_proximity",
    "mode",
    "promotion_level",
    "time_slot",
]


def rate_by_key_factors(df: DataFrame, factors: Sequence[str] = KEY_FACTORS) -> DataFrame:
    """(factor, value, rate) for each factor column, one grouping-sets scan."""
    base = df.select(*[F.col(f).cast("string").alias(f) for f in factors], "attended")
    g = base.groupingSets([[f] for f in factors], *factors).agg(
        F.grouping_id(*factors).alias("_gid"), _rate().alias("rate")
    )
    n = len(factors)
    fac = None
    val = None
    for i, f in enumerate(factors):
        gid = (1 << n) - 1 - (1 << (n - 1 - i))
        cond = (F.col("_gid") == gid) & F.col(f).isNotNull()
        fac = F.when(cond, F.lit(f)) if fac is None else fac.when(cond, F.lit(f))
        val = F.when(cond, F.col(f)) if val is None else val.when(cond, F.col(f))
    return g.select(fac.alias("factor"), val.alias("value"), "rate").filter(F.col("factor").isNotNull())


# ---- A15 ----------------------------------------------------------------------------
NUMERIC_COLUMNS = [
    "semester",
    "cgpa",
    "duration_minutes",
    "exam_proximity",
    "num_registrations",
    "past_attendance_rate",
    "past_events_count",
]


def target_correlations(df: DataFrame, columns: Sequence[str] = NUMERIC_COLUMNS, top: int = K.TOP_CORRELATIONS) -> DataFrame:
    """Pearson correlation of each numeric column with the outcome (pairwise
    complete rows), strongest |corr| first, top ``top``."""
    cols = [c for c in columns if c in df.columns]
    one = df.agg(*[F.corr(F.col(c).cast("double"), F.col("attended").cast("double")).alias(c) for c in cols])
    long = one.select(
        F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("corr")) for c in cols]))
    )
    return long.filter(F.col("corr").isNotNull()).orderBy(F.abs("corr").desc(), "feature").limit(top)


# ---- A17 ----------------------------------------------------------------------------
def class_balance(df: DataFrame, label: str = "attended") -> DataFrame:
    """Class counts, positive share, neg/pos ratio and balanced class weights; a
    ratio over a class without rows is null."""
    y = F.col(label)
    g = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(y == 1, 1)).alias("n_pos"),
        F.count(F.when(y == 0, 1)).alias("n_neg"),
    )
    share = lambda a, b: F.try_divide(F.col(a).cast("double"), b.cast("double"))
    return g.select(
        "n",
        "n_pos",
        "n_neg",
        share("n_pos", F.col("n")).alias("pos_rate"),
        share("n_neg", F.col("n_pos")).alias("scale_pos_weight"),
        share("n", 2 * F.col("n_pos")).alias("weight_pos"),
        share("n", 2 * F.col("n_neg")).alias("weight_neg"),
    )


# ---- A19 / U3 -------------------------------------------------------------------------
OPTION_COLUMNS = {
    "topics": "topic",
    "speaker_types": "speaker_type",
    "time_slots": "time_slot",
    "modes": "mode",
    "promotion_levels": "promotion_level",
}


def distinct_options(df: DataFrame) -> DataFrame:
    """(option, value, position). Sorted distinct non-null values of five columns,
    days in canonical order (all seven when none present), exam proximity 1..3."""
    options = {**OPTION_COLUMNS, "days": "day_of_week"}
    names = list(options.values())
    # one scan: each option is a grouping set of its own
    g = df.select(*[F.col(c).cast("string").alias(c) for c in names]).groupingSets([[c] for c in names], *names)
    g = g.agg(F.grouping_id(*names).alias("_gid"))
    option, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, (key, c) in enumerate(options.items()):
        here = F.col("_gid") == (1 << len(names)) - 1 - (1 << (len(names) - 1 - i))
        option, value = F.when(here, F.lit(key)).otherwise(option), F.when(here, F.col(c)).otherwise(value)
    d = g.select(option.alias("option"), value.alias("value")).filter(F.col("value").isNotNull())
    is_day = F.col("option") == "days"
    d = d.filter(~is_day | day_index("value").isNotNull())
    from pyspark.sql import Window

    w = Window.partitionBy("option").orderBy(F.when(is_day, day_index("value")), "value")
    ranked = d.withColumn("position", (F.row_number().over(w) - 1).cast("int"))
    # all seven days when none is present; exam proximity always 1..3
    days = d.filter(is_day).agg(F.count(F.lit(1))).scalar()
    week = _lit_table(df, "value", K.DAY_ORDER).filter(days == 0).select(F.lit("days").alias("option"), "value", F.col("position").cast("int"))
    exams = _lit_table(df, "value", ["1", "2", "3"]).select(F.lit("exam_proximity").alias("option"), "value", F.col("position").cast("int"))
    return ranked.unionByName(week).unionByName(exams)


# ---- P16 ------------------------------------------------------------------------------
def percent_and_complement(rates: DataFrame, rate_col: str = "rate") -> DataFrame:
    """Rate x 100 and (1 - rate) x 100, one decimal."""
    r = F.col(rate_col)
    return rates.select(
        "*",
        F.round(r * F.lit(100.0), 1).alias("attended_pct"),
        F.round((F.lit(1.0) - r) * F.lit(100.0), 1).alias("not_attended_pct"),
    )


__all__ = [name for name in dir() if not name.startswith("_")] + ["lookup"]
