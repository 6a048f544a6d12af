"""Row-level column expressions (JVM side, whole-stage codegen friendly).

Each function returns a ``Column``; nothing here triggers a job.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from rollcall import constants as K


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def lookup(col: str | Column, mapping: Mapping, otherwise=None) -> Column:
    """Literal lookup as a CASE chain; unknown values -> ``otherwise`` (null)."""
    c = _c(col)
    expr = None
    for key, value in mapping.items():
        expr = F.when(c == F.lit(key), F.lit(value)) if expr is None else expr.when(c == F.lit(key), F.lit(value))
    return expr.otherwise(F.lit(otherwise)) if otherwise is not None else expr


def flag(cond: Column) -> Column:
    """Boolean -> 0/1 int where null counts as false (pandas comparison with NaN)."""
    return F.coalesce(cond.cast("int"), F.lit(0))


# ---- P1 temporal ----------------------------------------------------------
def semester_week(date_col: str | Column = "event_date") -> Column:
    d = _c(date_col)
    start = F.make_date(F.year(d), F.when(F.month(d) >= 8, F.lit(8)).otherwise(F.lit(1)), F.lit(1))
    return F.greatest(F.lit(1), (F.floor(F.datediff(d, start) / 7) + 1).cast("int"))


def is_weekend(day_col: str | Column = "day_of_week") -> Column:
    return flag(_c(day_col).isin(*K.WEEKEND_DAYS))


# ---- P2 / P4 ---------------------------------------------------------------
def cgpa_band_high(cgpa: str | Column = "cgpa") -> Column:
    return flag(_c(cgpa) >= 8.0)


def cgpa_band_low(cgpa: str | Column = "cgpa") -> Column:
    return flag(_c(cgpa) < 6.0)


def exam_is_near(col: str | Column = "exam_proximity") -> Column:
    return flag(_c(col) == 1)


def is_long_workshop(col: str | Column = "duration_minutes") -> Column:
    return flag(_c(col) > 120)


# ---- P3 ordinal codes -------------------------------------------------------
def timing_code(col: str | Column = "registration_timing") -> Column:
    return lookup(col, K.TIMING_CODE)


def level_code(col: str | Column) -> Column:
    return lookup(col, K.LEVEL_CODE)


def mode_code(col: str | Column = "mode") -> Column:
    return lookup(col, K.MODE_CODE)


# ---- P5 ----------------------------------------------------------------------
def dept_topic_match(dept: str | Column = "department", topic: str | Column = "topic") -> Column:
    d, t = _c(dept), _c(topic)
    cond = None
    for school, topics in K.SCHOOL_TOPICS.items():
        one = (d == school) & t.isin(*topics)
        cond = one if cond is None else (cond | one)
    return flag(cond)


# ---- P6 one-hot from a fitted category list ---------------------------------
def one_hot_columns(col: str, categories: Iterable[str], drop_first: bool = True) -> list[Column]:
    cats = sorted(categories)
    if drop_first:
        cats = cats[1:]
    c = F.col(col)
    return [F.when(c == F.lit(v), F.lit(1)).otherwise(F.lit(0)).alias(f"{col}_{v}") for v in cats]


def one_hot_names(col: str, categories: Iterable[str], drop_first: bool = True) -> list[str]:
    cats = sorted(categories)
    return [f"{col}_{v}" for v in (cats[1:] if drop_first else cats)]


# ---- P15 / P16 ---------------------------------------------------------------
def round_half_even(col: str | Column, digits: int = 4) -> Column:
    return F.bround(_c(col), digits)


def percent(col: str | Column, digits: int = 1) -> Column:
    return F.round(_c(col) * F.lit(100.0), digits)


# ---- P17-P20 bands -------------------------------------------------------------
def advice_band(attendees: str | Column) -> Column:
    a = _c(attendees)
    return F.when(a < 20, "Low").when(a < 40, "Moderate").otherwise("High")


def rate_band(rate: str | Column) -> Column:
    r = _c(rate)
    return F.when(r >= 0.7, "high").when(r >= 0.4, "medium").otherwise("low")


def confidence_band(mean_probability: str | Column) -> Column:
    p = _c(mean_probability)
    return F.when(p > K.CONFIDENCE_HIGH, "High").when(p > K.CONFIDENCE_MEDIUM, "Medium").otherwise("Low")


def planning_band(rate: str | Column) -> Column:
    r = _c(rate)
    return F.when(r > 0.75, "large").when(r >= 0.50, "medium").otherwise("small")


# ---- P21 display labels -----------------------------------------------------------
def model_display_name(col: str | Column) -> Column:
    return F.initcap(F.translate(_c(col), "_", " "))


def exam_label(col: str | Column = "exam_proximity") -> Column:
    return lookup(col, K.EXAM_LABELS)


def day_short(col: str | Column = "day_of_week") -> Column:
    return F.substring(_c(col), 1, 3)


def day_index(col: str | Column = "day_of_week") -> Column:
    """0..6 position in the canonical Monday..Sunday order (null if unknown)."""
    return lookup(col, {d: i for i, d in enumerate(K.DAY_ORDER)})
