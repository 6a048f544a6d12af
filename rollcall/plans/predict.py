"""Turnout prediction for many planned events in one job.

History is scanned once for all planned events:

1. ``required_fields`` splits planned events into valid and rejected rows (P13);
2. every valid event takes the first ``num_registrations`` students of one seeded
   permutation (T5/J7, no cross product);
3. each candidate gets the student's history state strictly before it with an
   as-of lookup: history and candidate rows are unioned (U1) and a candidate
   takes ``last(state, ignorenulls)`` over the student's rows in (date, history
   first, id) order, so planned rows never see each other (J6);
4. the remaining features come from the feature state fitted on history
   (placeholder rows are excluded from every rate and mean), are aligned to the
   trained columns (P8) and filled with the trained medians;
5. the model scores the rows and one aggregate per event gives the turnout (A18).
"""

from __future__ import annotations

import datetime as _dt

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollcall import constants as K
from rollcall.functions.scalar import confidence_band
from rollcall.operators.history import history_features
from rollcall.operators.sampling import sample_students_per_event
from rollcall.plans.features import (
    FeatureState,
    align_features,
    encode_categoricals,
    interaction_features,
    popularity_features,
    temporal_features,
)
from rollcall.session import cut_lineage
from rollcall.sources.tables import normalise_students

REQUIRED = [
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
PLANNED_COLUMNS = ["event_id", *REQUIRED, "event_date"]


def planned_events_from_history(events: DataFrame, days_ahead: int = 364) -> DataFrame:
    """Next edition of every historical event: same attributes, dated ``days_ahead``
    later (364 keeps the weekday), id ``PLN_<n>``."""
    return events.select(
        F.concat(F.lit("PLN_"), F.substring("event_id", 5, 64)).alias("event_id"),
        *REQUIRED,
        F.date_add("event_date", days_ahead).alias("event_date"),
    )


def required_fields(planned: DataFrame) -> DataFrame:
    """``missing`` = names of absent required fields; casts as the API does; a
    missing date defaults to today. Valid rows have an empty ``missing``."""
    names = F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in REQUIRED])
    return planned.select(
        "event_id",
        *[c for c in REQUIRED if c not in ("duration_minutes", "exam_proximity", "num_registrations")],
        F.col("duration_minutes").cast("int").alias("duration_minutes"),
        F.col("exam_proximity").cast("int").alias("exam_proximity"),
        F.col("num_registrations").cast("long").alias("num_registrations"),
        F.coalesce(F.col("event_date").cast("date"), F.current_date()).alias("event_date"),
        F.filter(names, lambda x: x.isNotNull()).alias("missing"),
    )


def candidate_rows(planned_valid: DataFrame, history: DataFrame, seed: int = K.SEED) -> DataFrame:
    """One row per (planned event, sampled student) with serve-time defaults."""
    students = normalise_students(history)
    picked = sample_students_per_event(planned_valid.select(*PLANNED_COLUMNS), students, "num_registrations", seed)
    return picked.select(
        "student_id",
        "event_id",
        F.lit("On-time").alias("registration_timing"),
        *[c for c in students.columns if c != "student_id"],
        *[c for c in PLANNED_COLUMNS if c != "event_id"],
        F.lit(None).cast("int").alias("attended"),
        F.lit(0.0).alias("past_attendance_rate"),
        F.lit(0).cast("long").alias("past_events_count"),
    )


def union_history_candidates(history: DataFrame, candidates: DataFrame) -> DataFrame:
    """History and planned rows by column name (missing columns become null)."""
    return history.withColumn("_cand", F.lit(0)).unionByName(candidates.withColumn("_cand", F.lit(1)), allowMissingColumns=True)


STATE_COLUMNS = [
    "student_rolling_attendance",
    "student_cumulative_attended",
    "student_total_events",
    "attendance_streak",
    "student_attendance_std",
    "student_recent_3_rate",
]


def history_state(history: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """One row per (student, date): the history features a row placed right after that
    date's last history row would get (0/1 outcomes).

    Built from ``history_features`` (which splits hot students over many tasks) plus the
    row's own outcome, then reduced per (student, date) with ``max_by`` -- a partial
    aggregate -- so later per-student windows see at most one row per calendar day."""
    h = history_features(history.select("student_id", "event_id", "event_date", "attended"), overall=F.lit(0.0),
                         prior_outcomes=True, hot_rows=hot_rows)
    y = F.col("attended")
    n = F.col("student_total_events") + 1
    s = F.col("student_cumulative_attended") + y
    prev = F.col("attendance_streak")
    streak = F.when(y == 1, F.when(prev > 0, prev + 1).otherwise(F.lit(1))).otherwise(
        F.when(prev < 0, prev - 1).otherwise(F.lit(-1))
    )
    var = (s - s * s / n) / (n - 1)  # outcomes are 0/1, so the sum of squares is the sum
    last3 = F.concat(F.array(y), F.slice(F.col("prior_outcomes"), 1, 2))
    state = F.struct(
        (s / n).alias("rolling"),
        s.cast("long").alias("cum"),
        n.cast("long").alias("total"),
        streak.cast("long").alias("streak"),
        F.when(n > 1, F.sqrt(F.greatest(var, F.lit(0.0)))).alias("std"),
        (F.aggregate(last3, F.lit(0.0), lambda acc, v: acc + v) / F.size(last3)).alias("recent3"),
    )
    per_row = h.select("student_id", "event_id", "event_date", state.alias("_state"))
    return per_row.groupBy("student_id", "event_date").agg(
        F.max("event_id").alias("event_id"), F.max_by("_state", "event_id").alias("_state")
    )


def asof_student_state(history: DataFrame, candidates: DataFrame, overall: Column, hot_rows: int | None = None) -> DataFrame:
    """History features of each candidate row computed from the student's history
    rows before it (history rows first on the same date). Candidate rows carry a null
    state, so ``last(..., ignorenulls)`` skips them: planned rows never see each other.
    All events of a day see the same state, so the window runs over one row per
    (student, day) with history or a question, and the answers are joined back."""
    hs = history_state(history, hot_rows).drop("event_id")
    asked = candidates.select("student_id", "event_date").distinct()
    both = union_history_candidates(hs, asked)
    w = Window.partitionBy("student_id").orderBy("event_date", "_cand")
    prev = F.last("_state", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    answers = both.withColumn("_prev", prev).filter(F.col("_cand") == 1).select("student_id", "event_date", "_prev")
    c = candidates.select("student_id", "event_id", "event_date").join(answers, ["student_id", "event_date"], "left")
    return c.select(
        "student_id",
        "event_id",
        F.coalesce(F.col("_prev.rolling"), overall).alias("student_rolling_attendance"),
        F.coalesce(F.col("_prev.cum"), F.lit(0)).cast("long").alias("student_cumulative_attended"),
        F.coalesce(F.col("_prev.total"), F.lit(0)).cast("long").alias("student_total_events"),
        F.coalesce(F.col("_prev.streak"), F.lit(0)).cast("long").alias("attendance_streak"),
        F.coalesce(F.col("_prev.std"), F.lit(0.5)).alias("student_attendance_std"),
        F.coalesce(F.col("_prev.recent3"), overall).alias("student_recent_3_rate"),
    )


def _lookup(col: str, mapping: dict) -> Column:
    if not mapping:
        return F.lit(None).cast("double")
    m = F.create_map(*[x for k, v in sorted(mapping.items()) for x in (F.lit(k), F.lit(float(v)))])
    return F.try_element_at(m, F.col(col))


def _include_placeholders(rows: DataFrame, state: FeatureState) -> DataFrame:
    """placeholder='include': each planned event's own rows (outcome 0) count in the
    overall rate, the five target rates and the mean registrations, exactly as when
    the planned rows are appended to the history before fitting. Per event, by
    arithmetic on the stored sums and counts: rate = sum / (count + planned rows
    sharing the key). Planned events never affect each other."""
    from rollcall.plans.features import RATE_FEATURES

    # planned rows per event, and of each department there: partial aggregates of the stored
    # rows, one row an event, joined back once
    rows = cut_lineage(rows)
    per_dept = rows.groupBy("event_id", "department").agg(F.count(F.lit(1)).cast("double").alias("_md"))
    of_dept = F.collect_list(F.when(F.col("department").isNotNull(), F.struct("department", "_md")))
    per_event = per_dept.groupBy("event_id").agg(F.sum("_md").alias("_m"), F.map_from_entries(of_dept).alias("_mds"))
    out = rows.join(per_event, "event_id", "left").withColumn("_md", F.try_element_at("_mds", "department")).drop("_mds")
    n_tot = F.lit(float(state.total_count)) + F.col("_m")
    out = out.withColumn("_overall", F.lit(state.total_sum) / n_tot)
    out = out.withColumn(
        "_mean_regs", (F.lit(state.registrations_sum) + F.col("_m") * F.col("num_registrations")) / n_tot
    )
    for col, name in RATE_FEATURES.items():
        # topic, speaker, slot and day are the event's own: all its planned rows share them
        same = F.col("_md") if col == "department" else F.col("_m")
        s_ = F.coalesce(_lookup(col, state.sums.get(col, {})), F.lit(0.0))
        c_ = F.coalesce(_lookup(col, state.counts.get(col, {})), F.lit(0.0))
        out = out.withColumn(name, s_ / (c_ + same))
    return out.withColumn("registration_density", F.col("num_registrations") / F.col("_mean_regs"))


def _with_past(rows: DataFrame, past: str) -> DataFrame:
    if past == "zero":
        return rows
    known = F.when(F.col("student_total_events") > 0, F.col("student_rolling_attendance"))
    return rows.withColumns({
        "past_attendance_rate": F.bround(F.coalesce(known, F.lit(0.0)), 3),
        "past_events_count": F.col("student_total_events"),
    })


def planned_event_features(
    history: DataFrame, planned_valid: DataFrame, state: FeatureState, seed: int = K.SEED, placeholder: str = "exclude", past: str = "zero"
) -> DataFrame:
    """D3: model-ready features of the candidate rows (keys + feature columns).

    ``placeholder='exclude'`` (default): rates and means come from the history only,
    an unseen category gets the overall rate. ``'include'``: the original behaviour,
    where each event's placeholder rows enter its own rates (an unseen category -> 0.0).

    ``past='zero'`` (default) serves a past rate and count of 0, as the original does;
    ``'asof'`` the student's own as of the event's day, as the training rows have them."""
    if past not in ("zero", "asof"):
        raise ValueError("past is 'zero' or 'asof'")
    from rollcall.functions import scalar as S
    from rollcall.plans.features import RATE_FEATURES

    cands = cut_lineage(candidate_rows(planned_valid, history, seed))  # the lookup and the join read them
    if placeholder == "include":
        hist_state = asof_student_state(history, cands, F.lit(None).cast("double"))
        rows = _with_past(cands.join(hist_state, ["student_id", "event_id"]), past)
        out = _include_placeholders(rows, state)
        out = out.withColumns({c: F.coalesce(F.col(c), F.col("_overall")) for c in ("student_rolling_attendance", "student_recent_3_rate")})
        out = temporal_features(out)
    else:
        overall = F.lit(float(state.overall_rate))
        hist_state = asof_student_state(history, cands, overall)
        rows = _with_past(cands.join(hist_state, ["student_id", "event_id"]), past)
        out = temporal_features(rows)
        out = popularity_features(out, state)
        # an unseen category falls back to the overall rate
        out = out.withColumns({name: F.coalesce(F.col(name), overall) for name in RATE_FEATURES.values()})
    if "cgpa" in out.columns:
        out = out.withColumns({"cgpa_band_high": S.cgpa_band_high("cgpa"), "cgpa_band_low": S.cgpa_band_low("cgpa")})
    out = interaction_features(out)
    out = encode_categoricals(out, state)
    cols = state.feature_columns()
    # num_registrations is a feature itself: once is enough
    keep = [c for c in ("student_id", "event_id", "num_registrations") if c not in cols]
    aligned = align_features(out, cols, keep=keep)
    fills = {c: F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(v)) for c, v in state.medians.items() if c in cols}
    return aligned.withColumns(fills) if fills else aligned


def _as_vector(df: DataFrame, cols: list[str]) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return df.withColumn("features", array_to_vector(F.array(*[F.col(f"`{c}`").cast("double") for c in cols])))


def score_rows(model: PipelineModel, featured: DataFrame, cols: list[str]) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    out = model.transform(_as_vector(featured, cols))
    return out.withColumn("p", vector_to_array("probability")[1]).withColumn("model_class", F.col("prediction").cast("int"))


def event_turnout(scored: DataFrame, threshold: float) -> DataFrame:
    """Per planned event predicted attendees (p >= threshold), the requested
    registrations, their ratio, mean probability, confidence band, scored students.
    Probabilities are added as whole units of 1e-12, so that the mean does not depend on
    the order in which partitions are added up."""
    units = F.sum(F.round(F.col("p") * F.lit(1e12)).cast("decimal(38,0)"))
    g = scored.groupBy("event_id").agg(
        F.sum(F.when(F.col("p") >= F.lit(threshold), 1).otherwise(0)).cast("long").alias("predicted_attendees"),
        F.first("num_registrations").alias("total_registered"),
        (units.cast("double") / (F.count("p") * F.lit(1e12))).alias("avg_probability"),
        F.count(F.lit(1)).alias("scored_students"),
    )
    return g.select(
        "event_id",
        "predicted_attendees",
        "total_registered",
        (F.col("predicted_attendees") / F.greatest(F.col("total_registered"), F.lit(1))).alias("attendance_rate"),
        "avg_probability",
        confidence_band("avg_probability").alias("confidence"),
        "scored_students",
    )


def predict_planned_events(
    model: PipelineModel, state: FeatureState, threshold: float, history: DataFrame, planned: DataFrame, placeholder: str = "exclude", past: str = "zero"
) -> DataFrame:
    """D1 for a whole table of planned events."""
    checked = required_fields(planned)
    valid = checked.filter(F.size("missing") == 0).drop("missing")
    feats = planned_event_features(history, valid, state, placeholder=placeholder, past=past)
    return event_turnout(score_rows(model, feats, state.feature_columns()), threshold)


def predict_batch(model: PipelineModel, state: FeatureState, history: DataFrame) -> DataFrame:
    """Score every row; the class uses the model's own 0.5, not the tuned threshold."""
    from rollcall.operators.quantile import fill_median
    from rollcall.plans.features import run_feature_pipeline

    featured, cols, _ = run_feature_pipeline(history)
    cols = state.feature_columns()
    aligned = align_features(featured, cols, keep=["student_id", "event_id"])
    filled, _ = fill_median(aligned, cols, state.medians)
    return score_rows(model, filled, cols).select("student_id", "event_id", "p", "model_class")


def today() -> str:
    return _dt.date.today().isoformat()
