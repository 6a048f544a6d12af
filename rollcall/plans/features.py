"""Feature pipeline (M1): temporal -> history -> popularity -> interaction -> encode.

Fit/transform split, like a Spark ML estimator: ``fit_feature_state`` runs ONE
grouping-sets aggregate over the nominal columns (plus the empty set for the
global means) and returns a small state -- category lists, per-category target
rates (A5), the overall rate (A16) and the mean registrations (P9). Its size is
bounded by the number of categories, which is also the one-hot width; it is
checked against ``MAX_CATEGORIES`` before it is used. ``transform_features``
applies it as literal map lookups, so the big table is never joined or
re-shuffled for the popularity columns; the only shuffle of the pipeline is the
per-student history window.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall import constants as K
from rollcall.functions import scalar as S
from rollcall.operators.history import history_features

MAX_CATEGORIES = 10_000

RATE_FEATURES = {
    "topic": "topic_popularity",
    "speaker_type": "speaker_pull",
    "department": "dept_engagement",
    "time_slot": "timeslot_popularity",
    "day_of_week": "day_popularity",
}

RAW_NUMERIC = [
    "semester",
    "cgpa",
    "duration_minutes",
    "exam_proximity",
    "num_registrations",
    "past_attendance_rate",
    "past_events_count",
]
DERIVED = [
    "month",
    "is_weekend",
    "semester_week",
    "student_rolling_attendance",
    "student_cumulative_attended",
    "student_total_events",
    "attendance_streak",
    "student_attendance_std",
    "student_recent_3_rate",
    "cgpa_band_high",
    "cgpa_band_low",
    "topic_popularity",
    "speaker_pull",
    "dept_engagement",
    "timeslot_popularity",
    "day_popularity",
    "registration_density",
    "exam_is_near",
    "is_long_workshop",
    "high_promo_popular_topic",
    "club_activity_numeric",
    "student_engagement_score",
    "dept_topic_match",
    "student_quality_score",
    "event_attractiveness",
    "combined_quality_attract",
    "exam_pressure",
    "recent_att_x_event",
    "reg_timing_numeric",
    "registration_commitment",
    "registration_timing_encoded",
    "promotion_level_encoded",
    "mode_encoded",
]


@dataclass
class FeatureState:
    categories: dict[str, list[str]]
    rates: dict[str, dict[str, float]]
    overall_rate: float
    mean_registrations: float
    has_cgpa: bool = True
    medians: dict[str, float] = field(default_factory=dict)
    # outcome sums and row counts per category and overall (for placeholder arithmetic)
    sums: dict[str, dict[str, float]] = field(default_factory=dict)
    counts: dict[str, dict[str, int]] = field(default_factory=dict)
    total_sum: float = 0.0
    total_count: int = 0
    registrations_sum: float = 0.0
    row_count: int = 0

    def feature_columns(self) -> list[str]:
        """The model input columns, in table order (raw, derived, one-hot)."""
        raw = [c for c in RAW_NUMERIC if c != "cgpa" or self.has_cgpa]
        derived = [
            c
            for c in DERIVED
            if self.has_cgpa or c not in ("cgpa_band_high", "cgpa_band_low", "student_quality_score", "combined_quality_attract")
        ]
        onehot = [n for c in K.NOMINAL_COLUMNS for n in S.one_hot_names(c, self.categories.get(c, []))]
        return raw + derived + onehot

    def to_dict(self) -> dict:
        return asdict(self)

    @staticmethod
    def from_dict(d: dict) -> FeatureState:
        return FeatureState(**d)


def fit_feature_state(df: DataFrame, outcome: str = "attended") -> FeatureState:
    """One scan: grouping sets ((topic), (speaker_type), (department), (time_slot),
    (day_of_week), ()) -> rates per category, overall rate, mean registrations."""
    cols = list(RATE_FEATURES)
    g = df.groupingSets([[c] for c in cols] + [[]], *cols).agg(
        F.grouping_id(*cols).alias("gid"),
        F.avg(F.col(outcome).cast("double")).alias("rate"),
        F.avg(F.col("num_registrations").cast("double")).alias("mean_regs"),
        F.sum(F.col(outcome).cast("double")).alias("y_sum"),
        F.count(F.col(outcome)).alias("y_n"),
        F.sum(F.col("num_registrations").cast("double")).alias("regs_sum"),
        F.count(F.lit(1)).alias("rows"),
    )
    n = len(cols)
    key = F.coalesce(*[F.col(c).cast("string") for c in cols])
    rows = g.select("gid", key.alias("value"), "rate", "mean_regs", "y_sum", "y_n", "regs_sum", "rows").limit(MAX_CATEGORIES + 1).collect()
    if len(rows) > MAX_CATEGORIES:
        raise ValueError(f"more than {MAX_CATEGORIES} categories; one-hot encoding would not be meaningful")
    rates: dict[str, dict[str, float]] = {c: {} for c in cols}
    sums: dict[str, dict[str, float]] = {c: {} for c in cols}
    counts: dict[str, dict[str, int]] = {c: {} for c in cols}
    overall, mean_regs, tot = None, None, None
    for r in rows:
        if r["gid"] == (1 << n) - 1:
            overall, mean_regs, tot = r["rate"], r["mean_regs"], r
            continue
        for i, c in enumerate(cols):
            if r["gid"] == (1 << n) - 1 - (1 << (n - 1 - i)) and r["value"] is not None:
                rates[c][r["value"]] = r["rate"]
                sums[c][r["value"]] = r["y_sum"] or 0.0
                counts[c][r["value"]] = r["y_n"] or 0
    categories = {c: sorted(rates[c]) for c in cols}
    return FeatureState(
        categories=categories,
        rates=rates,
        overall_rate=overall if overall is not None else 0.0,
        mean_registrations=mean_regs if mean_regs is not None else 0.0,
        has_cgpa="cgpa" in df.columns,
        sums=sums,
        counts=counts,
        total_sum=float((tot["y_sum"] if tot else 0.0) or 0.0),
        total_count=int((tot["y_n"] if tot else 0) or 0),
        registrations_sum=float((tot["regs_sum"] if tot else 0.0) or 0.0),
        row_count=int((tot["rows"] if tot else 0) or 0),
    )


def _map_lookup(col: str, mapping: dict[str, float]) -> Column:
    if not mapping:
        return F.lit(None).cast("double")
    m = F.create_map(*[x for k, v in sorted(mapping.items()) for x in (F.lit(k), F.lit(float(v)))])
    return F.try_element_at(m, F.col(col))


def temporal_features(df: DataFrame) -> DataFrame:
    """P1."""
    d = F.col("event_date").cast("date")
    return df.withColumns(
        {
            "month": F.month(d),
            "is_weekend": S.is_weekend("day_of_week"),
            "semester_week": S.semester_week(d),
        }
    )


def student_history(df: DataFrame, overall: Column, hot_rows: int | None = None) -> DataFrame:
    """W1-W6 plus P2 cgpa bands."""
    out = history_features(df, overall=overall, hot_rows=hot_rows)
    if "cgpa" in df.columns:
        out = out.withColumns({"cgpa_band_high": S.cgpa_band_high("cgpa"), "cgpa_band_low": S.cgpa_band_low("cgpa")})
    return out


def popularity_features(df: DataFrame, state: FeatureState) -> DataFrame:
    """A5 target-rate encoding (J3 as a map lookup) and P9 registration density."""
    cols = {name: _map_lookup(c, state.rates.get(c, {})) for c, name in RATE_FEATURES.items()}
    cols["registration_density"] = F.col("num_registrations") / F.lit(float(state.mean_registrations))
    return df.withColumns(cols)


def interaction_features(df: DataFrame) -> DataFrame:
    """P4, P5, P10 (13 columns)."""
    c = F.col
    out = df.withColumns(
        {
            "exam_is_near": S.exam_is_near("exam_proximity"),
            "is_long_workshop": S.is_long_workshop("duration_minutes"),
            "high_promo_popular_topic": S.flag(c("promotion_level") == "High") * c("topic_popularity"),
            "club_activity_numeric": S.level_code("club_activity_level"),
        }
    )
    out = out.withColumns(
        {
            "student_engagement_score": c("student_rolling_attendance") * c("club_activity_numeric"),
            "dept_topic_match": S.dept_topic_match("department", "topic"),
        }
    )
    if "cgpa" in df.columns:
        out = out.withColumn(
            "student_quality_score",
            c("cgpa") / F.lit(10.0) * F.lit(0.3)
            + c("club_activity_numeric") / F.lit(3.0) * F.lit(0.3)
            + c("student_rolling_attendance") * F.lit(0.4),
        )
    out = out.withColumn(
        "event_attractiveness",
        c("speaker_pull") * F.lit(0.35)
        + c("topic_popularity") * F.lit(0.35)
        + c("timeslot_popularity") * F.lit(0.15)
        + c("day_popularity") * F.lit(0.15),
    )
    if "cgpa" in df.columns:
        out = out.withColumn("combined_quality_attract", c("student_quality_score") * c("event_attractiveness"))
    out = out.withColumns(
        {
            "exam_pressure": c("exam_is_near") * (F.lit(3) - c("club_activity_numeric")),
            "recent_att_x_event": c("student_recent_3_rate") * c("event_attractiveness"),
            "reg_timing_numeric": S.timing_code("registration_timing"),
        }
    )
    return out.withColumn("registration_commitment", c("reg_timing_numeric") * c("registration_density"))


def encode_categoricals(df: DataFrame, state: FeatureState) -> DataFrame:
    """P3 ordinal codes and P6 one-hot (fitted categories, first dropped)."""
    out = df.withColumns(
        {
            "registration_timing_encoded": S.timing_code("registration_timing"),
            "promotion_level_encoded": S.level_code("promotion_level"),
            "mode_encoded": S.mode_code("mode"),
        }
    )
    return one_hot(out, state)


def one_hot(df: DataFrame, state: FeatureState) -> DataFrame:
    """The columns of the fitted categories, first dropped."""
    return df.select("*", *[col for c in K.NOMINAL_COLUMNS for col in S.one_hot_columns(c, state.categories.get(c, []))])


def transform_features(
    df: DataFrame, state: FeatureState, overall: Column | None = None, hot_rows: int | None = None
) -> DataFrame:
    """Apply the pipeline with a fitted state. ``overall`` defaults to the state's rate."""
    overall = overall if overall is not None else F.lit(float(state.overall_rate))
    out = temporal_features(df)
    out = student_history(out, overall, hot_rows)
    out = popularity_features(out, state)
    out = interaction_features(out)
    return encode_categoricals(out, state)


def run_feature_pipeline(df: DataFrame, hot_rows: int | None = None) -> tuple[DataFrame, list[str], FeatureState]:
    """M1 on one table (fit and transform on the same rows, as the original pipeline)."""
    state = fit_feature_state(df)
    # the fit counted the rows of this same table
    out = transform_features(df, state, hot_rows=hot_rows)
    return out, state.feature_columns(), state


def align_features(df: DataFrame, feature_cols: list[str], keep: list[str] | None = None) -> DataFrame:
    """Trained columns in trained order; absent ones are 0, extras dropped."""
    keep = keep or []
    present = set(df.columns)
    return df.select(*keep, *[F.col(c) if c in present else F.lit(0).alias(c) for c in feature_cols])
