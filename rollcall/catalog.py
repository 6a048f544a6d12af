"""Registered queries: name -> (Spark builder, DuckDB oracle SQL or None).

Each builder takes (spark, sf_dir) and returns a DataFrame over the whole
driver tables (or data Spark derives from them)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F_

from rollcall import constants as K
from rollcall import oracle as O
from rollcall.operators import summaries as A
from rollcall.sources import fixtures as X

Builder = Callable[[SparkSession, str], DataFrame]
CATALOG: dict[str, tuple[Builder, str | None]] = {}


def register(name: str, sql: str | None):
    def deco(fn: Builder) -> Builder:
        CATALOG[name] = (fn, sql)
        return fn

    return deco


_MATERIALIZED: dict[str, str] = {}


def materialize(spark: SparkSession, sf_dir: str) -> str:
    """Build the registration table once (ETL step) into the shared checkpoint folder;
    later queries on ``sf_dir`` read the stored table instead of re-deriving it."""
    import uuid

    from rollcall.session import ensure_checkpoint_dir, tune

    tune(spark)
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/rollcall_flat/{uuid.uuid4().hex}"
    flat(spark, sf_dir).write.mode("overwrite").parquet(path)
    _MATERIALIZED[sf_dir] = path
    return path


def flat(spark: SparkSession, sf_dir: str, facts: DataFrame | None = None) -> DataFrame:
    """The registration table; ``facts`` are those of ``shared_facts``, where a query has them."""
    from rollcall.session import tune

    tune(spark)
    if sf_dir in _MATERIALIZED:
        return spark.read.parquet(_MATERIALIZED[sf_dir])
    return X.registrations_flat(spark, sf_dir, facts if facts is not None else grain(spark, sf_dir))


def grain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The facts, joined once and stored: four narrow columns that counts and rows read."""
    from rollcall.session import cut_lineage

    return cut_lineage(X.registration_grain(spark, sf_dir))


def shared_facts(spark: SparkSession, sf_dir: str) -> DataFrame | None:
    """``grain`` for a query that derives both the registrations and the planned events from
    it; none where the registrations are stored already."""
    return None if sf_dir in _MATERIALIZED else grain(spark, sf_dir)


def stored_flat(spark: SparkSession, sf_dir: str, facts: DataFrame | None = None, columns: list[str] | None = None) -> DataFrame:
    """``flat`` (or some of its columns) for a query that reads it more than once: derived
    once and stored."""
    from rollcall.session import cut_lineage

    f = flat(spark, sf_dir, facts).select(*(columns or X.FLAT_COLUMNS))
    return f if sf_dir in _MATERIALIZED else cut_lineage(f)


@register("registrations_flat", O.with_flat("SELECT * FROM r_flat"))
def q_registrations_flat(spark, sf_dir):
    return flat(spark, sf_dir)


@register(
    "rate_by_topic",
    O.with_flat("SELECT topic AS label, round_even(avg(CAST(attended AS DOUBLE)), 4) AS rate FROM r_flat "
                "WHERE topic IS NOT NULL GROUP BY topic ORDER BY rate DESC, label"),
)
def q_rate_by_topic(spark, sf_dir):
    return A.rate_by(flat(spark, sf_dir), "topic")


# ---- M1 feature pipeline ---------------------------------------------------------------
def _feature_names() -> list[str]:
    from rollcall import constants as K
    from rollcall.functions.scalar import one_hot_names
    from rollcall.plans.features import DERIVED, RAW_NUMERIC

    vocab = {
        "department": K.DEPARTMENTS,
        "topic": K.TOPICS,
        "speaker_type": K.SPEAKER_TYPES,
        "time_slot": K.TIME_SLOTS,
        "day_of_week": K.DAY_ORDER,
    }
    return RAW_NUMERIC + DERIVED + [n for c in K.NOMINAL_COLUMNS for n in one_hot_names(c, vocab[c])]


def _quote(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _feature_select_sql() -> str:
    cols = ["student_id", "event_id", "attended"] + [
        "round_even(student_attendance_std, 6) AS student_attendance_std" if c == "student_attendance_std" else _quote(c)
        for c in _feature_names()
    ]
    return "SELECT " + ", ".join(cols) + " FROM r_features"


def features_table(spark: SparkSession, sf_dir: str):
    from rollcall.plans.features import run_feature_pipeline

    return run_feature_pipeline(stored_flat(spark, sf_dir))


@register("feature_pipeline", O.with_features(_feature_select_sql()))
def q_feature_pipeline(spark, sf_dir):
    from pyspark.sql import functions as F

    df, cols, _ = features_table(spark, sf_dir)
    return df.select(
        "student_id",
        "event_id",
        "attended",
        *[F.bround(c, 6).alias(c) if c == "student_attendance_std" else F.col(f"`{c}`") for c in cols],
    )


@register("align_features", O.with_features(
    "SELECT student_id, event_id, num_registrations, 0 AS feature_unknown_here, is_weekend FROM r_features"))
def q_align(spark, sf_dir):
    """Trained columns in trained order; one of them is absent and 0, the rest go."""
    from rollcall.plans.features import align_features

    df, _, _ = features_table(spark, sf_dir)
    return align_features(df, ["num_registrations", "feature_unknown_here", "is_weekend"], keep=["student_id", "event_id"])


# ---- A1-A19 breakdowns ------------------------------------------------------------------
def _rate_sql(col: str = "attended") -> str:
    return f"round_even(avg(CAST({col} AS DOUBLE)), 4)"


@register("overview", O.with_flat(
    "SELECT count(DISTINCT event_id) AS total_events, count(DISTINCT student_id) AS total_students, "
    f"count(*) AS registrations, coalesce({_rate_sql()}, 0.0) AS avg_attendance FROM r_flat"))
def q_overview(spark, sf_dir):
    return A.overview(flat(spark, sf_dir))


def _rate_by_sql(col: str) -> str:
    return O.with_flat(
        f"SELECT {col} AS label, {_rate_sql()} AS rate FROM r_flat WHERE {col} IS NOT NULL GROUP BY {col} "
        "ORDER BY rate DESC, label")


for _name, _col in [("rate_by_speaker", "speaker_type"), ("rate_by_mode", "mode"),
                    ("rate_by_department", "department")]:
    register(_name, _rate_by_sql(_col))(lambda spark, sf_dir, _c=_col: A.rate_by(flat(spark, sf_dir), _c))


_DAY_CASE = "CASE " + " ".join(f"WHEN label = '{d}' THEN {i}" for i, d in enumerate(
    ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"])) + " END"


@register("rate_by_day", O.with_flat(
    f"SELECT * FROM (SELECT day_of_week AS label, {_rate_sql()} AS rate FROM r_flat WHERE day_of_week IS NOT NULL "
    f"GROUP BY day_of_week) WHERE {_DAY_CASE} IS NOT NULL ORDER BY {_DAY_CASE}"))
def q_rate_by_day(spark, sf_dir):
    return A.rate_by_day(flat(spark, sf_dir))


@register("rate_by_semester", O.with_flat(
    f"SELECT CAST(semester AS VARCHAR) AS label, {_rate_sql()} AS rate FROM r_flat WHERE semester IS NOT NULL "
    "GROUP BY semester ORDER BY semester"))
def q_rate_by_semester(spark, sf_dir):
    return A.rate_by_semester(flat(spark, sf_dir))


@register("rate_by_exam", O.with_flat(
    f"SELECT l.label, coalesce(g.r, 0.0) AS rate FROM (SELECT unnest([1, 2, 3]) AS label) l "
    f"LEFT JOIN (SELECT exam_proximity AS label, {_rate_sql()} AS r FROM r_flat GROUP BY exam_proximity) g "
    "ON l.label = g.label ORDER BY l.label"))
def q_rate_by_exam(spark, sf_dir):
    return A.rate_by_exam(flat(spark, sf_dir))


def _club_sql(source: str, dense: bool) -> str:
    join = "LEFT JOIN" if dense else "JOIN"
    return (
        f"SELECT l.label, coalesce(g.r, 0.0) AS rate FROM (SELECT unnest(['Low', 'Medium', 'High']) AS label, "
        f"unnest([0, 1, 2]) AS pos) l {join} (SELECT club_activity_level AS label, {_rate_sql()} AS r FROM {source} "
        "GROUP BY club_activity_level) g ON l.label = g.label ORDER BY l.pos")


@register("rate_by_club", O.with_flat(_club_sql("r_flat", dense=False)))
def q_rate_by_club(spark, sf_dir):
    return A.rate_by_club(flat(spark, sf_dir))


@register("monthly_trend", O.with_flat(
    "SELECT strftime(event_date, '%Y-%m') AS month, count(*) AS registrations, "
    f"CAST(sum(attended) AS BIGINT) AS attended, {_rate_sql()} AS rate FROM r_flat WHERE event_date IS NOT NULL "
    "GROUP BY 1 ORDER BY 1"))
def q_monthly_trend(spark, sf_dir):
    return A.monthly_trend(flat(spark, sf_dir))


_SLOTS = sorted(["Morning (9-11 AM)", "Afternoon (2-4 PM)", "Evening (5-7 PM)"])


@register("day_slot_heatmap", O.with_flat(
    "SELECT day_of_week, " + ", ".join(
        f"coalesce(round_even(avg(CASE WHEN time_slot = '{s}' THEN CAST(attended AS DOUBLE) END), 4), 0.0) AS \"{s}\""
        for s in _SLOTS) +
    " FROM r_flat WHERE day_of_week IS NOT NULL GROUP BY day_of_week"))
def q_day_slot_heatmap(spark, sf_dir):
    return A.day_slot_heatmap(flat(spark, sf_dir))


@register("day_slot_rates", O.with_flat("""
, r_days AS (SELECT DISTINCT day_of_week FROM r_flat WHERE day_of_week IS NOT NULL),
r_slots AS (SELECT DISTINCT time_slot FROM r_flat WHERE day_of_week IS NOT NULL AND time_slot IS NOT NULL)
SELECT d.day_of_week, s.time_slot, coalesce(round_even(avg(CAST(f.attended AS DOUBLE)), 4), 0.0) AS rate
FROM r_days d CROSS JOIN r_slots s LEFT JOIN r_flat f ON f.day_of_week = d.day_of_week AND f.time_slot = s.time_slot
GROUP BY d.day_of_week, s.time_slot"""))
def q_day_slot_rates(spark, sf_dir):
    return A.day_slot_rates(flat(spark, sf_dir))


# P11 slice used by the topic analysis queries (parameters of the feature, not row caps)
SLICE = {"topic": "Data Science", "school": "School of Technology", "date_from": "2024-09-01", "date_to": "2025-01-31"}
_SLICE_SQL = (", r_slice AS (SELECT * FROM r_flat WHERE department = 'School of Technology' "
              "AND event_date >= DATE '2024-09-01' AND event_date <= DATE '2025-01-31' AND topic = 'Data Science')\n")


def _slice(spark, sf_dir):
    return A.filter_school_topic_dates(flat(spark, sf_dir), **SLICE)


@register("filter_school_topic_dates", O.with_flat(_SLICE_SQL + "SELECT * FROM r_slice"))
def q_filter(spark, sf_dir):
    return _slice(spark, sf_dir)


@register("topic_summary", O.with_flat(
    _SLICE_SQL + "SELECT count(DISTINCT event_id) AS events, count(*) AS registrations, "
    f"CAST(coalesce(sum(attended), 0) AS BIGINT) AS attended, coalesce({_rate_sql()}, 0.0) AS rate FROM r_slice"))
def q_topic_summary(spark, sf_dir):
    return A.topic_summary(_slice(spark, sf_dir))


@register("topic_summary_empty", O.with_flat(
    ", r_none AS (SELECT * FROM r_flat WHERE topic = 'Underwater Basket Weaving')\n"
    "SELECT count(DISTINCT event_id) AS events, count(*) AS registrations, "
    f"CAST(coalesce(sum(attended), 0) AS BIGINT) AS attended, coalesce({_rate_sql()}, 0.0) AS rate FROM r_none"))
def q_topic_summary_empty(spark, sf_dir):
    return A.topic_summary(A.filter_school_topic_dates(flat(spark, sf_dir), topic="Underwater Basket Weaving"))


@register("topic_mode_breakdown", O.with_flat(
    _SLICE_SQL + "SELECT mode AS label, count(*) AS count, CAST(sum(attended) AS BIGINT) AS attended, "
    f"{_rate_sql()} AS rate FROM r_slice WHERE mode IS NOT NULL GROUP BY mode ORDER BY mode"))
def q_topic_mode(spark, sf_dir):
    return A.topic_mode_breakdown(_slice(spark, sf_dir))


@register("topic_department", O.with_flat(
    _SLICE_SQL + f"SELECT department AS label, {_rate_sql()} AS rate FROM r_slice WHERE department IS NOT NULL "
    "GROUP BY department ORDER BY rate DESC, label"))
def q_topic_department(spark, sf_dir):
    return A.rate_by(_slice(spark, sf_dir), "department")


@register("topic_semester", O.with_flat(
    _SLICE_SQL + f"SELECT CAST(semester AS VARCHAR) AS label, {_rate_sql()} AS rate FROM r_slice "
    "WHERE semester IS NOT NULL GROUP BY semester ORDER BY semester"))
def q_topic_semester(spark, sf_dir):
    return A.rate_by_semester(_slice(spark, sf_dir))


@register("topic_club", O.with_flat(_SLICE_SQL + _club_sql("r_slice", dense=True)))
def q_topic_club(spark, sf_dir):
    return A.rate_by_club(_slice(spark, sf_dir), dense=True)


_BREAKDOWN_DIMS = [
    ("topic", "topic"), ("day_of_week", "day_of_week"), ("month", "strftime(event_date, '%Y-%m')"),
    ("speaker_type", "speaker_type"), ("mode", "mode"), ("club_activity_level", "club_activity_level"),
    ("exam_proximity", "CAST(exam_proximity AS VARCHAR)"), ("department", "department"),
    ("semester", "CAST(semester AS VARCHAR)"), ("day_of_week|time_slot", "day_of_week || '|' || time_slot"),
]


@register("all_breakdowns", O.with_flat(" UNION ALL ".join(
    f"SELECT '{d}' AS dimension, {e} AS label, count(*) AS registrations, CAST(sum(attended) AS BIGINT) AS attended, "
    f"{_rate_sql()} AS rate FROM r_flat WHERE {e} IS NOT NULL GROUP BY {e}" for d, e in _BREAKDOWN_DIMS)))
def q_all_breakdowns(spark, sf_dir):
    return A.all_breakdowns(flat(spark, sf_dir))


@register("rate_by_key_factors", O.with_flat(" UNION ALL ".join(
    f"SELECT '{f}' AS factor, CAST({f} AS VARCHAR) AS value, {_rate_sql()} AS rate FROM r_flat "
    f"WHERE {f} IS NOT NULL GROUP BY {f}" for f in A.KEY_FACTORS)))
def q_key_factors(spark, sf_dir):
    return A.rate_by_key_factors(flat(spark, sf_dir))


@register("target_correlations", O.with_flat(
    "SELECT feature, round_even(c, 6) AS corr FROM (" + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, corr(CAST({c} AS DOUBLE), CAST(attended AS DOUBLE)) AS c FROM r_flat"
        for c in A.NUMERIC_COLUMNS) + ") WHERE c IS NOT NULL ORDER BY abs(c) DESC, feature LIMIT 10"))
def q_target_correlations(spark, sf_dir):
    from pyspark.sql import functions as F

    return A.target_correlations(flat(spark, sf_dir)).select("feature", F.bround("corr", 6).alias("corr"))


@register("overall_rate", O.with_flat("SELECT avg(CAST(attended AS DOUBLE)) AS overall_rate FROM r_flat"))
def q_overall_rate(spark, sf_dir):
    from pyspark.sql import functions as F

    return flat(spark, sf_dir).agg(F.avg(F.col("attended").cast("double")).alias("overall_rate"))


@register("class_balance", O.with_flat(
    "SELECT n, n_pos, n_neg, n_pos / n AS pos_rate, n_neg / n_pos AS scale_pos_weight, n / (2 * n_pos) AS weight_pos, "
    "n / (2 * n_neg) AS weight_neg FROM (SELECT count(*) AS n, CAST(sum(CASE WHEN attended = 1 THEN 1 ELSE 0 END) AS BIGINT) "
    "AS n_pos, CAST(sum(CASE WHEN attended = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_neg FROM r_flat)"))
def q_class_balance(spark, sf_dir):
    return A.class_balance(flat(spark, sf_dir))


_OPTS = [("topics", "topic"), ("speaker_types", "speaker_type"), ("time_slots", "time_slot"), ("modes", "mode"),
         ("promotion_levels", "promotion_level")]


@register("distinct_options", O.with_flat(
    "SELECT option, value, CAST(row_number() OVER (PARTITION BY option ORDER BY pos, value) - 1 AS INTEGER) AS position "
    "FROM (" + " UNION ".join(
        f"SELECT DISTINCT '{k}' AS option, CAST({c} AS VARCHAR) AS value, 0 AS pos FROM r_flat WHERE {c} IS NOT NULL"
        for k, c in _OPTS) +
    " UNION SELECT DISTINCT 'days' AS option, day_of_week AS value, " + _DAY_CASE.replace("label", "day_of_week") +
    " AS pos FROM r_flat WHERE day_of_week IS NOT NULL) "
    "UNION ALL SELECT 'exam_proximity', unnest(['1', '2', '3']), unnest([0, 1, 2])"))
def q_distinct_options(spark, sf_dir):
    return A.distinct_options(flat(spark, sf_dir))


@register("percent_and_complement", O.with_flat(
    "SELECT label, rate, round(rate * 100, 1) AS attended_pct, round((1 - rate) * 100, 1) AS not_attended_pct FROM "
    f"(SELECT topic AS label, {_rate_sql()} AS rate FROM r_flat WHERE topic IS NOT NULL GROUP BY topic)"))
def q_percent(spark, sf_dir):
    return A.percent_and_complement(A.rate_by(flat(spark, sf_dir), "topic"))


# ---- S2-S9, J2, J4 tables ----------------------------------------------------------------
from rollcall.sources import tables as TB  # noqa: E402

CUTOFF = "2024-08-01"  # incremental-load boundary: history known before it is "existing"


@register("parse_event_date_lenient", O.with_flat(
    ", r_txt AS (SELECT event_id, CASE WHEN right(event_id, 2) = '00' THEN '2024-13-45' "
    "ELSE strftime(event_date, '%Y-%m-%d') END AS event_date_text FROM r_events)\n"
    "SELECT event_id, event_date_text, CAST(try_strptime(event_date_text, '%Y-%m-%d') AS DATE) AS event_date FROM r_txt"))
def q_parse_dates(spark, sf_dir):
    from pyspark.sql import functions as F

    ev = X.events(spark, sf_dir)
    txt = ev.select(
        "event_id",
        F.when(F.substring("event_id", -2, 2) == "00", F.lit("2024-13-45"))
        .otherwise(F.date_format("event_date", "yyyy-MM-dd")).alias("event_date_text"),
    )
    return txt.withColumn("event_date", TB.parse_event_date(F.col("event_date_text"), lenient=True))


_STUDENT_SQL = ("SELECT student_id, department, semester, club_activity_level, cgpa FROM "
                "(SELECT *, row_number() OVER (PARTITION BY student_id ORDER BY event_date, event_id) AS k FROM r_flat) "
                "WHERE k = 1")


@register("normalise_students", O.with_flat(_STUDENT_SQL))
def q_norm_students(spark, sf_dir):
    return TB.normalise_students(flat(spark, sf_dir))


@register("normalise_events", O.with_flat(
    "SELECT event_id, event_date, topic, speaker_type, day_of_week, time_slot, duration_minutes, mode, exam_proximity, "
    "promotion_level, num_registrations FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY student_id) "
    "AS k FROM r_flat) WHERE k = 1"))
def q_norm_events(spark, sf_dir):
    return TB.normalise_events(flat(spark, sf_dir))


@register("project_registrations", O.with_flat(
    "SELECT student_id, event_id, registration_timing, attended, past_attendance_rate, past_events_count FROM r_flat"))
def q_project_regs(spark, sf_dir):
    return TB.project_registrations(flat(spark, sf_dir))


@register("event_registration_counts", O.with_flat("SELECT event_id, num_registrations FROM r_events"))
def q_event_counts(spark, sf_dir):
    return X.events(spark, sf_dir).select("event_id", "num_registrations")


@register("merge_new_dimension_rows", O.with_flat(
    f", r_existing AS (SELECT DISTINCT student_id FROM r_flat WHERE event_date < DATE '{CUTOFF}')\n"
    f"SELECT s.* FROM ({_STUDENT_SQL}) s WHERE s.student_id NOT IN (SELECT student_id FROM r_existing)"))
def q_merge_dims(spark, sf_dir):
    from pyspark.sql import functions as F

    f = stored_flat(spark, sf_dir)
    existing = TB.normalise_students(f.filter(F.col("event_date") < F.lit(CUTOFF).cast("date")))
    return TB.merge_new_dimension_rows(TB.normalise_students(f), existing, "student_id")


@register("load_fact_once", O.with_flat(
    "SELECT student_id, event_id, registration_timing, attended, past_attendance_rate, past_events_count FROM r_flat"))
def q_load_fact_once(spark, sf_dir):
    from pyspark.sql import functions as F

    regs = TB.project_registrations(stored_flat(spark, sf_dir))
    # the target table is empty before the first load -> every row is loaded
    target = regs.filter(F.col("student_id").isNull())
    return TB.load_fact_once(regs, target)


@register("load_fact_once_branches", O.with_flat(
    "SELECT 'empty target' AS target, CAST(count(*) AS BIGINT) AS loaded FROM r_flat UNION ALL SELECT 'loaded target', CAST(0 AS BIGINT)"))
def q_load_fact_branches(spark, sf_dir):
    """S8 against an empty and against a filled target."""
    from pyspark.sql import functions as F

    regs = TB.project_registrations(stored_flat(spark, sf_dir))
    loads = {"empty target": TB.load_fact_once(regs, regs.filter("student_id is null")), "loaded target": TB.load_fact_once(regs, regs)}
    counts = [df.agg(F.count(F.lit(1)).alias("loaded")).select(F.lit(name).alias("target"), "loaded") for name, df in loads.items()]
    return counts[0].unionByName(counts[1])


@register("parse_event_date_strict", O.with_flat("SELECT event_id, CAST(strftime(event_date, '%Y-%m-%d') AS DATE) AS event_date FROM r_events"))
def q_parse_strict(spark, sf_dir):
    """S3: every date is valid here; a bad one raises."""
    from pyspark.sql import functions as F

    text = X.events(spark, sf_dir).select("event_id", F.date_format("event_date", "yyyy-MM-dd").alias("t"))
    return text.select("event_id", TB.parse_event_date(F.col("t"), lenient=False).alias("event_date"))


@register("load_from_star", O.with_flat("SELECT * FROM r_flat"))
def q_load_from_star(spark, sf_dir):
    """S10's first branch: the star tables are there and are joined."""
    import uuid

    from rollcall.session import shared_folder

    root = f"{shared_folder(spark)}/rollcall_star/{uuid.uuid4().hex}"
    TB.write_star(*X.star_tables(spark, sf_dir, stored_flat(spark, sf_dir)), f"{root}/star")
    return TB.load_with_fallback(spark, f"{root}/star", f"{root}/no_csv")


@register("denormalise", O.with_flat("SELECT * FROM r_flat"))
def q_denormalise(spark, sf_dir):
    s, e, r = X.star_tables(spark, sf_dir, stored_flat(spark, sf_dir))
    return TB.denormalise(s, e, r)


# ---- C1-C3 scorecard ------------------------------------------------------------------------
from rollcall.functions import scorecard as SC  # noqa: E402


@register("rule_scorecard", O.with_flat(
    f"SELECT student_id, event_id, CAST({O.SCORE_SQL} AS INTEGER) AS score_pct, "
    f"CAST({O.SCORE_SQL} AS INTEGER) / CAST(100 AS DOUBLE) AS score FROM r_flat"))
def q_rule_scorecard(spark, sf_dir):
    return SC.rule_scorecard(flat(spark, sf_dir))


@register("scorecard_contributions", O.with_flat(" UNION ALL ".join(
    f"SELECT * FROM (SELECT student_id, event_id, '{n}' AS rule, CAST({r} AS INTEGER) AS points FROM r_flat) "
    "WHERE points <> 0" for n, r in O.RULE_SQL)))
def q_scorecard_contributions(spark, sf_dir):
    return SC.scorecard_contributions(flat(spark, sf_dir))


@register("momentum_score", O.with_flat(
    "SELECT student_id, event_id, round_even(least(0.90e0, greatest(0.03e0, CASE WHEN r IS NULL THEN b "
    "ELSE b + (r - 0.3e0) * 0.25e0 END)), 6) AS momentum FROM (SELECT student_id, event_id, "
    f"CAST({O.SCORE_SQL} AS INTEGER) / CAST(100 AS DOUBLE) AS b, avg(attended) OVER (PARTITION BY student_id "
    "ORDER BY event_date, event_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS r FROM r_flat)"))
def q_momentum(spark, sf_dir):
    from pyspark.sql import functions as F

    from rollcall.operators.history import momentum_score

    f = flat(spark, sf_dir)
    m = momentum_score(f, SC.score_probability(f.columns))
    return m.select("student_id", "event_id", F.bround("momentum", 6).alias("momentum"))


# ---- W1-W7 history windows ------------------------------------------------------------------
from rollcall.operators import history as H  # noqa: E402


@register("recalculate_history", O.with_flat(
    "SELECT student_id, event_id, past_attendance_rate, past_events_count FROM r_flat"))
def q_recalc(spark, sf_dir):
    return H.recalculate_history(X.labelled_flat(spark, sf_dir)).select(
        "student_id", "event_id", "past_attendance_rate", "past_events_count")


def _history(spark, sf_dir):
    return H.history_features(flat(spark, sf_dir))


for _col in H.HISTORY_COLUMNS:
    _expr = f"round_even({_col}, 6) AS {_col}" if _col == "student_attendance_std" else _col
    register(_col, O.with_flat(O.HISTORY_CTE + f"\nSELECT student_id, event_id, {_expr} FROM r_hist"))(
        lambda spark, sf_dir, _c=_col: _history(spark, sf_dir).select(
            "student_id", "event_id",
            (__import__("pyspark.sql.functions", fromlist=["bround"]).bround(_c, 6).alias(_c)
             if _c == "student_attendance_std" else _c)))


@register("history_features", O.with_flat(O.HISTORY_CTE + "\nSELECT student_id, event_id, " + ", ".join(
    f"round_even({c}, 6) AS {c}" if c == "student_attendance_std" else c for c in H.HISTORY_COLUMNS) + " FROM r_hist"))
def q_history_all(spark, sf_dir):
    from pyspark.sql import functions as F

    return _history(spark, sf_dir).select(
        "student_id", "event_id",
        *[F.bround(c, 6).alias(c) if c == "student_attendance_std" else F.col(c) for c in H.HISTORY_COLUMNS])


_HIST_DOUBLES = ("student_rolling_attendance", "student_attendance_std", "student_recent_3_rate")


_FLAT_SQL = ", ".join(X.FLAT_COLUMNS)


@register("history_features_skew_route", O.with_flat(O.HISTORY_CTE + f"\nSELECT {_FLAT_SQL}, " + ", ".join(
    f"round_even({c}, 6) AS {c}" if c == "student_attendance_std" else c for c in H.HISTORY_COLUMNS) + " FROM r_hist"))
def q_history_skew(spark, sf_dir):
    """All columns, with every student routed through the segmented (hot-key) scan."""
    from pyspark.sql import functions as F

    out = H.history_features(stored_flat(spark, sf_dir), hot_rows=0)
    return out.withColumn("student_attendance_std", F.bround("student_attendance_std", 6))


@register("feature_pipeline_skew_route", CATALOG["feature_pipeline"][1])
def q_features_skew(spark, sf_dir):
    """M1 with students of more than 45 rows on the segmented route, the others not."""
    from pyspark.sql import functions as F

    from rollcall.plans.features import run_feature_pipeline

    df, cols, _ = run_feature_pipeline(stored_flat(spark, sf_dir), hot_rows=45)
    return df.select("student_id", "event_id", "attended",
                     *[F.bround(c, 6).alias(c) if c == "student_attendance_std" else F.col(f"`{c}`") for c in cols])


_ENCODING_SQL = "\nUNION ALL\n".join(
    f"SELECT '{c}' AS \"column\", {c} AS value, CAST(sum(attended) AS BIGINT) AS y_sum, CAST(count(attended) AS BIGINT) AS y_n, "
    f"round_even(avg(CAST(attended AS DOUBLE)), 9) AS rate, CAST(row_number() OVER (ORDER BY {c}) - 1 AS BIGINT) AS place "
    f"FROM r_flat WHERE {c} IS NOT NULL GROUP BY {c}" for c in K.NOMINAL_COLUMNS)


@register("encoding_table", O.with_flat(_ENCODING_SQL))
def q_encoding_table(spark, sf_dir):
    """A5 as a table, for any number of categories."""
    from pyspark.sql import functions as F

    from rollcall.plans.encodings import encoding_table

    return encoding_table(flat(spark, sf_dir)).withColumn("rate", F.bround("rate", 9))


_WIDTH_SQL = "SELECT " + ", ".join(f"count(CASE WHEN \"column\" = '{c}' THEN 1 END) - 1 AS w{i}" for i, c in enumerate(K.NOMINAL_COLUMNS)) + " FROM r_enc"


@register("wide_features", O.with_features(
    f", r_enc AS ({_ENCODING_SQL}), r_width AS ({_WIDTH_SQL})\n"
    "SELECT f.student_id, f.event_id, round_even(f.topic_popularity, 9) AS topic_popularity, round_even(f.event_attractiveness, 9) AS event_attractiveness, "
    "concat_ws(',', " + ", ".join(
        f"CASE WHEN e{i}.place > 0 THEN CAST(e{i}.place - 1" + "".join(f" + w.w{k}" for k in range(i)) + " AS BIGINT) END" for i in range(len(K.NOMINAL_COLUMNS)))
    + ") AS hot FROM r_features f JOIN r_flat r USING (student_id, event_id) CROSS JOIN r_width w "
    + " ".join(f"LEFT JOIN r_enc e{i} ON e{i}.\"column\" = '{c}' AND e{i}.value = r.{c}" for i, c in enumerate(K.NOMINAL_COLUMNS))))
def q_wide_features(spark, sf_dir):
    """M1 with rates by a join and the one-hot columns as one sparse vector, whose places
    are listed here."""
    from pyspark.ml.functions import vector_to_array
    from pyspark.sql import functions as F

    from rollcall.plans.encodings import wide_features

    df, _ = wide_features(stored_flat(spark, sf_dir))
    hot = F.filter(F.transform(vector_to_array("one_hot"), lambda v, i: F.when(v == 1, i)), lambda i: i.isNotNull())
    return df.select("student_id", "event_id", F.bround("topic_popularity", 9).alias("topic_popularity"), F.bround("event_attractiveness", 9).alias("event_attractiveness"),
                     F.array_join(hot.cast("array<string>"), ",").alias("hot"))


# ---- M9-M15 metrics kit (scored by the rule scorecard) ----------------------------------------
from rollcall.operators import metrics as MT  # noqa: E402


def scored_by_scorecard(spark, sf_dir):
    from pyspark.sql import functions as F

    f = flat(spark, sf_dir)
    return f.select("student_id", "event_id", "department", F.col("attended").alias("label"),
                    SC.score_probability(f.columns).alias("p"))


_GRID = MT.threshold_grid()
_GRID_SQL = ", ".join(f"({i}, CAST('{t!r}' AS DOUBLE))" for i, t in enumerate(_GRID))
_SCORED_CTE = (f", r_scored AS (SELECT student_id, event_id, department, attended AS label, "
               f"CAST({O.SCORE_SQL} AS INTEGER) / CAST(100 AS DOUBLE) AS p FROM r_flat)\n")
_SWEEP_CTE = _SCORED_CTE + (
    f", r_grid(idx, threshold) AS (VALUES {_GRID_SQL})\n"
    ", r_tot AS (SELECT CAST(sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS BIGINT) AS P, "
    "CAST(sum(CASE WHEN label = 1 THEN 0 ELSE 1 END) AS BIGINT) AS N FROM r_scored)\n"
    ", r_cnt AS (SELECT g.idx, g.threshold, CAST(count(CASE WHEN s.label = 1 THEN 1 END) AS BIGINT) AS tp, "
    "CAST(count(CASE WHEN s.label <> 1 THEN 1 END) AS BIGINT) AS fp FROM r_grid g LEFT JOIN r_scored s ON s.p >= g.threshold "
    "GROUP BY g.idx, g.threshold)\n"
    ", r_sweep AS (SELECT CAST(idx AS INTEGER) AS idx, threshold, tp, fp, P - tp AS fn, N - fp AS tn, "
    "CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision, "
    "CASE WHEN P > 0 THEN tp / P ELSE 0.0 END AS recall, "
    "CASE WHEN 2 * tp + fp + (P - tp) > 0 THEN 2 * tp / (2 * tp + fp + (P - tp)) ELSE 0.0 END AS f1 "
    "FROM r_cnt CROSS JOIN r_tot)\n"
    ", r_best AS (SELECT CASE WHEN f1 > 0 THEN threshold ELSE 0.5e0 END AS threshold, f1 FROM r_sweep "
    "ORDER BY f1 DESC, idx ASC LIMIT 1)\n"
)


@register("threshold_sweep", O.with_flat(_SWEEP_CTE + "SELECT * FROM r_sweep"))
def q_threshold_sweep(spark, sf_dir):
    return MT.threshold_sweep(scored_by_scorecard(spark, sf_dir))


@register("best_threshold", O.with_flat(_SWEEP_CTE + "SELECT * FROM r_best"))
def q_best_threshold(spark, sf_dir):
    return MT.best_threshold(MT.threshold_sweep(scored_by_scorecard(spark, sf_dir)))


def _best_scalar(scored):
    return MT.best_threshold(MT.threshold_sweep(scored)).select("threshold").scalar()


_CM_SQL = (", r_cm AS (SELECT CAST(sum(CASE WHEN label <> 1 AND p < t THEN 1 ELSE 0 END) AS BIGINT) AS tn, "
           "CAST(sum(CASE WHEN label <> 1 AND p >= t THEN 1 ELSE 0 END) AS BIGINT) AS fp, "
           "CAST(sum(CASE WHEN label = 1 AND p < t THEN 1 ELSE 0 END) AS BIGINT) AS fn, "
           "CAST(sum(CASE WHEN label = 1 AND p >= t THEN 1 ELSE 0 END) AS BIGINT) AS tp "
           "FROM r_scored CROSS JOIN (SELECT threshold AS t FROM r_best))\n")


@register("confusion_matrix", O.with_flat(_SWEEP_CTE + _CM_SQL + "SELECT * FROM r_cm"))
def q_confusion(spark, sf_dir):
    s = scored_by_scorecard(spark, sf_dir)
    return MT.confusion_matrix(s, _best_scalar(s))


@register("accuracy_f1", O.with_flat(_SWEEP_CTE + _CM_SQL + (
    "SELECT *, CASE WHEN tp + tn + fp + fn > 0 THEN (tp + tn) / (tp + tn + fp + fn) ELSE 0.0 END AS accuracy, "
    "CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END AS f1 FROM r_cm")))
def q_accuracy_f1(spark, sf_dir):
    s = scored_by_scorecard(spark, sf_dir)
    return MT.accuracy_f1(MT.confusion_matrix(s, _best_scalar(s)))


@register("auc_roc", O.with_flat(_SCORED_CTE + (
    ", r_g AS (SELECT p, CAST(sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS pos, "
    "CAST(sum(CASE WHEN label = 1 THEN 0 ELSE 1 END) AS DOUBLE) AS neg FROM r_scored GROUP BY p)\n"
    ", r_c AS (SELECT pos, neg, pos * (coalesce(sum(neg) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) "
    "+ 0.5 * neg) AS c FROM r_g)\n"
    "SELECT CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN sum(c) / (sum(pos) * sum(neg)) END AS auc_roc FROM r_c")))
def q_auc(spark, sf_dir):
    return MT.auc_roc(scored_by_scorecard(spark, sf_dir))


_REPORT_SQL = """
, r_pr AS (SELECT CAST(tp AS DOUBLE) AS tp, CAST(fp AS DOUBLE) AS fp, CAST(fn AS DOUBLE) AS fn, CAST(tn AS DOUBLE) AS tn FROM r_cm)
, r_pr2 AS (SELECT *, tp + fp + fn + tn AS n,
    CASE WHEN tp + fp <> 0 THEN tp / (tp + fp) ELSE 0.0 END AS p1, CASE WHEN tp + fn <> 0 THEN tp / (tp + fn) ELSE 0.0 END AS r1,
    CASE WHEN tn + fn <> 0 THEN tn / (tn + fn) ELSE 0.0 END AS p0, CASE WHEN tn + fp <> 0 THEN tn / (tn + fp) ELSE 0.0 END AS r0,
    tp + fn AS s1, tn + fp AS s0 FROM r_pr)
, r_pr3 AS (SELECT *, CASE WHEN p1 + r1 <> 0 THEN 2 * p1 * r1 / (p1 + r1) ELSE 0.0 END AS f1_1,
    CASE WHEN p0 + r0 <> 0 THEN 2 * p0 * r0 / (p0 + r0) ELSE 0.0 END AS f1_0 FROM r_pr2)
SELECT 'Not Attended' AS class_label, p0 AS precision, r0 AS recall, f1_0 AS f1_score, CAST(s0 AS BIGINT) AS support FROM r_pr3
UNION ALL SELECT 'Attended', p1, r1, f1_1, CAST(s1 AS BIGINT) FROM r_pr3
UNION ALL SELECT 'accuracy', NULL, NULL, CASE WHEN n <> 0 THEN (tp + tn) / n ELSE 0.0 END, CAST(n AS BIGINT) FROM r_pr3
UNION ALL SELECT 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f1_0 + f1_1) / 2, CAST(n AS BIGINT) FROM r_pr3
UNION ALL SELECT 'weighted avg', CASE WHEN n <> 0 THEN (p0 * s0 + p1 * s1) / n ELSE 0.0 END,
  CASE WHEN n <> 0 THEN (r0 * s0 + r1 * s1) / n ELSE 0.0 END, CASE WHEN n <> 0 THEN (f1_0 * s0 + f1_1 * s1) / n ELSE 0.0 END,
  CAST(n AS BIGINT) FROM r_pr3
"""


@register("classification_report", O.with_flat(_SWEEP_CTE + _CM_SQL + _REPORT_SQL))
def q_report(spark, sf_dir):
    s = scored_by_scorecard(spark, sf_dir)
    return MT.classification_report(MT.confusion_matrix(s, _best_scalar(s)))


@register("metrics_by_school", O.with_flat(_SWEEP_CTE + (
    ", r_d AS (SELECT department, CAST(sum(CASE WHEN label = 1 AND p >= t THEN 1 ELSE 0 END) AS BIGINT) AS tp, "
    "CAST(sum(CASE WHEN label <> 1 AND p >= t THEN 1 ELSE 0 END) AS BIGINT) AS fp, "
    "CAST(sum(CASE WHEN label = 1 AND p < t THEN 1 ELSE 0 END) AS BIGINT) AS fn, "
    "CAST(sum(CASE WHEN label <> 1 AND p < t THEN 1 ELSE 0 END) AS BIGINT) AS tn "
    "FROM r_scored CROSS JOIN (SELECT threshold AS t FROM r_best) GROUP BY department)\n"
    "SELECT department, tp, fp, fn, tn, CASE WHEN tp + fp <> 0 THEN CAST(tp AS DOUBLE) / (tp + fp) ELSE 0.0 END AS precision, "
    "CASE WHEN tp + fn <> 0 THEN CAST(tp AS DOUBLE) / (tp + fn) ELSE 0.0 END AS recall, "
    "CASE WHEN 2 * tp + fp + fn <> 0 THEN 2 * CAST(tp AS DOUBLE) / (2 * tp + fp + fn) ELSE 0.0 END AS f1, "
    "tp + fn AS support FROM r_d")))
def q_metrics_by_school(spark, sf_dir):
    s = scored_by_scorecard(spark, sf_dir)
    return MT.metrics_by_group(s, _best_scalar(s), by=["department"])


# ---- T6/T7 split and folds --------------------------------------------------------------------
from rollcall.operators import sampling as SP  # noqa: E402

_SPLIT_CTE = """
, r_keyed AS (SELECT student_id, event_id, attended, md5('42|' || student_id || '|' || event_id) AS h FROM r_flat)
, r_rk AS (SELECT *, row_number() OVER (PARTITION BY attended ORDER BY h) - 1 AS rk FROM r_keyed)
, r_cls AS (SELECT attended, count(*) AS n_c FROM r_flat GROUP BY attended)
, r_cls2 AS (SELECT attended, n_c, sum(n_c) OVER () AS n, (sum(n_c) OVER () + 4) // 5 AS n_test FROM r_cls)
, r_cls3 AS (SELECT *, (n_test * n_c) // n AS q, (n_test * n_c) % n AS r FROM r_cls2)
, r_cls4 AS (SELECT *, n_test - sum(q) OVER () AS short, row_number() OVER (ORDER BY r DESC, attended) AS pos FROM r_cls3)
, r_sizes AS (SELECT attended, CAST(q + CASE WHEN pos <= short THEN 1 ELSE 0 END AS BIGINT) AS test_n FROM r_cls4)
, r_split AS (SELECT k.student_id, k.event_id, k.attended, k.rk < s.test_n AS is_test,
    CASE WHEN k.rk >= s.test_n THEN CAST((k.rk - s.test_n) % 5 AS INTEGER) END AS fold
    FROM r_rk k JOIN r_sizes s ON k.attended = s.attended)
"""


def _split(spark, sf_dir):
    return SP.stratified_split(flat(spark, sf_dir).select("student_id", "event_id", "attended"), label="attended")


@register("stratified_split", O.with_flat(_SPLIT_CTE + "SELECT student_id, event_id, attended, is_test FROM r_split"))
def q_split(spark, sf_dir):
    return _split(spark, sf_dir).select("student_id", "event_id", "attended", "is_test")


@register("stratified_folds", O.with_flat(_SPLIT_CTE + "SELECT student_id, event_id, attended, fold FROM r_split"))
def q_folds(spark, sf_dir):
    return _split(spark, sf_dir).select("student_id", "event_id", "attended", "fold")


# ---- M2-M19 training: each query prepares and fits what it needs, nothing is shared ---------------
def _prepared(spark, sf_dir):
    from rollcall.plans.training import prepare_data

    return prepare_data(stored_flat(spark, sf_dir), stored=True)


_TRAIN_SPLIT = (", r_train AS (SELECT s.attended AS label FROM r_split s WHERE NOT s.is_test)\n")


@register("smote_plan", O.with_flat(_SPLIT_CTE + _TRAIN_SPLIT + (
    ", r_p AS (SELECT count(*) AS n, CAST(sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS BIGINT) AS minority, "
    "CAST(sum(CASE WHEN label = 1 THEN 0 ELSE 1 END) AS BIGINT) AS majority FROM r_train)\n"
    ", r_p2 AS (SELECT *, minority / n AS ratio, least(0.45e0, minority / n * 2.0e0) AS target_ratio FROM r_p)\n"
    ", r_p3 AS (SELECT *, CAST(trunc(target_ratio * majority - minority) AS BIGINT) AS raw FROM r_p2)\n"
    "SELECT n, minority, majority, ratio, target_ratio, ratio < 0.35e0 AS active, raw > 0 AS reachable, "
    "CAST(CASE WHEN ratio < 0.35e0 AND raw > 0 THEN raw ELSE 0 END AS BIGINT) AS n_synthetic FROM r_p3")))
def q_smote_plan(spark, sf_dir):
    from pyspark.sql import functions as F

    from rollcall.operators.smote import smote_plan

    s = _split(spark, sf_dir)
    return smote_plan(s.filter(~F.col("is_test")).withColumnRenamed("attended", "label"))


@register("class_weights", O.with_flat(_SPLIT_CTE + _TRAIN_SPLIT + (
    ", r_c AS (SELECT count(*) AS n, sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS pos FROM r_train)\n"
    "SELECT n, CAST(pos AS BIGINT) AS n_pos, CAST(n - pos AS BIGINT) AS n_neg, n / (2.0e0 * pos) AS balanced_pos, "
    "n / (2.0e0 * (n - pos)) AS balanced_neg, (n - pos) / CAST(pos AS DOUBLE) AS scale_pos_weight FROM r_c")))
def q_class_weights(spark, sf_dir):
    from pyspark.sql import functions as F

    from rollcall.plans.training import weight_table

    return weight_table(_split(spark, sf_dir).filter(~F.col("is_test")), "attended")


@register("fill_median", O.with_features(
    "SELECT * FROM (SELECT 'cgpa' AS feature, median(cgpa) AS median FROM r_features UNION ALL "
    "SELECT 'student_quality_score', median(student_quality_score) FROM r_features UNION ALL "
    "SELECT 'combined_quality_attract', median(combined_quality_attract) FROM r_features) WHERE median IS NOT NULL"))
def q_fill_median(spark, sf_dir):
    from rollcall.operators.quantile import exact_medians

    df, cols, _ = features_table(spark, sf_dir)
    from pyspark.sql import functions as F

    from rollcall.session import cut_lineage

    df = cut_lineage(df.select(*[F.col(f"`{c}`") for c in cols]))  # read by each pass of the medians
    nulls = df.agg(*[F.sum(F.col(f"`{c}`").isNull().cast("int")).alias(c) for c in cols]).first()
    med = exact_medians(df, [c for c in cols if nulls[c]])
    return spark.createDataFrame([(k, float(v)) for k, v in med.items() if v is not None], "feature string, median double")


@register("prepare_data", None)
def q_prepare(spark, sf_dir):
    from pyspark.sql import functions as F

    p = _prepared(spark, sf_dir)
    tr = p.train.select("student_id", "event_id", "label", F.lit(False).alias("is_test"), "is_synthetic", "fold")
    te = p.test.select("student_id", "event_id", "label", F.lit(True).alias("is_test"), F.lit(False).alias("is_synthetic"),
                       F.lit(None).cast("int").alias("fold"))
    return tr.unionByName(te)


@register("similar_events", O.with_flat(
    ", r_ev AS (SELECT event_id, row_number() OVER (ORDER BY md5('42|' || event_id)) - 1 AS id, CAST(min(duration_minutes) AS DOUBLE) AS d, "
    "CAST(count(*) AS DOUBLE) AS n, CAST(sum(attended) AS DOUBLE) AS a FROM r_flat WHERE duration_minutes IS NOT NULL GROUP BY event_id)\n"
    ", r_pair AS (SELECT x.event_id, y.event_id AS similar_id, (x.d - y.d) * (x.d - y.d) + (x.n - y.n) * (x.n - y.n) + (x.a - y.a) * (x.a - y.a) AS dist, y.id "
    "FROM r_ev x JOIN r_ev y ON x.id <> y.id)\n"
    "SELECT event_id, CAST(place AS INTEGER) AS place, similar_id, dist FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY dist, id) - 1 AS place FROM r_pair) WHERE place < 5"))
def q_similar_events(spark, sf_dir):
    """The neighbours that M4 rests on, over events: duration, registrations, attendees."""
    from pyspark.sql import functions as F

    from rollcall.operators.knn import nearest_neighbours
    from rollcall.operators.sampling import hash_rank
    from rollcall.session import cut_lineage

    known = flat(spark, sf_dir).filter("duration_minutes IS NOT NULL").groupBy("event_id")
    events = known.agg(F.min("duration_minutes").cast("double").alias("d"), F.count(F.lit(1)).cast("double").alias("n"), F.sum("attended").cast("double").alias("a"))
    events = cut_lineage(hash_rank(events, ["event_id"], [], out="id").select("event_id", "id", F.array("d", "n", "a").alias("x")))
    got = nearest_neighbours(events.select("id", "x"), 5).table
    names, others = events.select("event_id", F.col("id").alias("qid")), events.select(F.col("event_id").alias("similar_id"), F.col("id").alias("rid"))
    return got.join(names, "qid").join(others, "rid").select("event_id", F.col("nn").cast("int").alias("place"), "similar_id", "dist")


@register("smote_oversample", None)
def q_smote(spark, sf_dir):
    p = _prepared(spark, sf_dir)
    return p.train.filter("is_synthetic").select("student_id", "label", "x", "fold")


def _fit(spark, sf_dir, model_name, history=None):
    """One model, prepared and fitted in this query."""
    from rollcall.plans.training import prepare_data, train_one

    prep = prepare_data(history, stored=True) if history is not None else _prepared(spark, sf_dir)
    return train_one(model_name, prep, cv=False), prep


def _fit_metrics(spark, sf_dir, model_name):
    fitted, prep = _fit(spark, sf_dir, model_name)
    m = fitted.metrics
    row = (model_name, float(m["accuracy"]), float(m["f1_score"]), float(m["auc_roc"]), float(m["threshold"]), int(prep.n_rows), len(prep.feature_cols))
    return spark.createDataFrame([row], "model_name string, accuracy double, f1_score double, auc_roc double, threshold double, n_rows long, n_features int")


for _qname, _mname in [("train_gbt", "xgboost"), ("train_random_forest", "random_forest"),
                       ("train_logistic", "logistic_regression")]:
    register(_qname, None)(lambda spark, sf_dir, _m=_mname: _fit_metrics(spark, sf_dir, _m))


def _cv(spark, sf_dir, model_name):
    """5-fold F1 at 0.5 on the over-sampled train set, with mean and population std."""
    from rollcall.plans.training import _pop_std, cv_f1

    s = cv_f1(model_name, _prepared(spark, sf_dir).train)
    rows = [(model_name, i, float(v), float(sum(s) / len(s)), float(_pop_std(s))) for i, v in enumerate(s)]
    return spark.createDataFrame(rows, "model_name string, fold int, f1 double, mean_f1 double, std_f1 double")


for _qname, _mname in [("cv_f1", "logistic_regression"), ("cv_f1_random_forest", "random_forest"), ("cv_f1_gbt", "xgboost")]:
    register(_qname, None)(lambda spark, sf_dir, _m=_mname: _cv(spark, sf_dir, _m))


def _importances(spark, sf_dir, model_name):
    """One row for each of the model's features."""
    fitted, _ = _fit(spark, sf_dir, model_name)
    return spark.createDataFrame([(model_name, f, float(v)) for f, v in fitted.importances], "model_name string, feature string, importance double")


for _qname, _mname in [("feature_importance", "logistic_regression"), ("feature_importance_random_forest", "random_forest"), ("feature_importance_gbt", "xgboost")]:
    register(_qname, None)(lambda spark, sf_dir, _m=_mname: _importances(spark, sf_dir, _m))


@register("train_all_models", None)
def q_train_all(spark, sf_dir):
    """The three models, each with its cross-validation, and their comparison."""
    from rollcall.plans.training import comparison_frame, train_all_models

    results, _ = train_all_models(stored_flat(spark, sf_dir), stored=True)
    return comparison_frame(spark, results)


@register("retrain", None)
def q_retrain(spark, sf_dir):
    """R5 on a registry of its own: the first training, then a second one that is gated
    against it."""
    import uuid

    from rollcall.plans.registry import Registry, retrain
    from rollcall.session import shared_folder

    reg = Registry(spark, f"{shared_folder(spark)}/rollcall_registry/{uuid.uuid4().hex}")
    f = stored_flat(spark, sf_dir)
    first = retrain(reg, f)
    return first.unionByName(retrain(reg, f))


# ---- R1-R4, R7, M18, T2, T4, S13: the registry's tables -------------------------------------------
# The registry's decisions are functions of small tables. Here these come from the
# mapped data: the scorecard is one "model" in each department, dated behind each other.
_RUN_NAMES = ("xgboost", "random_forest", "logistic_regression", "scorecard")
_RUNS_SQL = _SCORED_CTE + (
    ", r_dep AS (SELECT department, row_number() OVER (ORDER BY department) - 1 AS i, count(*) AS n, "
    "sum(CASE WHEN p >= 0.5e0 AND label = 1 THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN p >= 0.5e0 AND label = 0 THEN 1 ELSE 0 END) AS fp, "
    "sum(CASE WHEN p < 0.5e0 AND label = 1 THEN 1 ELSE 0 END) AS fn, sum(CASE WHEN p < 0.5e0 AND label = 0 THEN 1 ELSE 0 END) AS tn "
    "FROM r_scored GROUP BY department)\n"
    ", r_runs AS (SELECT CAST(i AS INTEGER) AS train_order, " + f"list_extract({list(_RUN_NAMES)!r}, CAST(i % 4 + 1 AS INTEGER)) AS model_name, "
    "TIMESTAMP '2025-01-01' + INTERVAL 1 DAY * i AS trained_on, CAST(n AS BIGINT) AS num_training_rows, "
    "round_even(2 * tp / CAST(2 * tp + fp + fn AS DOUBLE), 6) AS f1_score, round_even((tp / CAST(tp + fn AS DOUBLE) + tn / CAST(tn + fp AS DOUBLE)) / 2, 6) AS auc_roc, "
    "round_even((tp + tn) / CAST(n AS DOUBLE), 6) AS accuracy, 'models/' || department AS model_path FROM r_dep)\n")


def _runs(spark, sf_dir):
    """One row per department: the scorecard's metrics there as a training run."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    hit, y = F.col("p") >= 0.5, F.col("label") == 1
    count = lambda c: F.count(F.when(c, 1)).cast("double")
    d = scored_by_scorecard(spark, sf_dir).groupBy("department").agg(
        F.count(F.lit(1)).alias("num_training_rows"), count(hit & y).alias("tp"), count(hit & ~y).alias("fp"), count(~hit & y).alias("fn"), count(~hit & ~y).alias("tn"))
    # one row per department: a bounded window
    d = d.withColumn("train_order", (F.row_number().over(Window.orderBy("department")) - 1).cast("int"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    names = F.array(*[F.lit(n) for n in _RUN_NAMES])
    return d.select(
        "train_order", F.get(names, F.col("train_order") % 4).alias("model_name"),
        F.expr("timestamp '2025-01-01' + make_interval(0, 0, 0, train_order)").alias("trained_on"), "num_training_rows",
        F.bround(F.try_divide(2 * tp, 2 * tp + fp + fn), 6).alias("f1_score"),
        F.bround((F.try_divide(tp, tp + fn) + F.try_divide(tn, tn + fp)) / 2, 6).alias("auc_roc"),
        F.bround((tp + tn) / F.col("num_training_rows"), 6).alias("accuracy"),
        F.concat(F.lit("models/"), F.col("department")).alias("model_path"))


def _versions(spark, sf_dir):
    """Two generations: the third run is the active version."""
    from rollcall.plans.registry import log_model_version

    runs = _runs(spark, sf_dir)
    old = runs.filter("train_order < 2").withColumn("is_active", F_.lit(True)).drop("train_order")
    return log_model_version(old, runs.filter("train_order = 2").drop("train_order"))


_VERSION_COLUMNS = "model_name, trained_on, num_training_rows, f1_score, auc_roc, accuracy, model_path"


@register("log_model_version", O.with_flat(_RUNS_SQL + f"SELECT {_VERSION_COLUMNS}, train_order = 2 AS is_active FROM r_runs WHERE train_order <= 2"))
def q_log_version(spark, sf_dir):
    return _versions(spark, sf_dir)


@register("active_model", O.with_flat(_RUNS_SQL + f"SELECT {_VERSION_COLUMNS}, true AS is_active FROM r_runs WHERE train_order = 2"))
def q_active(spark, sf_dir):
    from rollcall.plans.registry import active_model

    return active_model(_versions(spark, sf_dir))


def _compared(spark, sf_dir):
    from pyspark.sql import functions as F

    from rollcall.plans.registry import compare_models

    f = flat(spark, sf_dir)
    scored = f.select("department", (F.month("event_date") % 5).alias("fold"), F.col("attended").alias("label"), (SC.score_probability(f.columns) >= 0.5).alias("hit"))
    y = F.col("label") == 1
    parts = scored.groupBy("department", "fold").agg(F.count(F.when(F.col("hit") & y, 1)).alias("tp"), F.count(F.when(F.col("hit") != y, 1)).alias("wrong"))
    folds = parts.select(F.concat(F.lit("models/"), "department").alias("model_path"),
                         F.bround(F.try_divide(2.0 * F.col("tp"), 2.0 * F.col("tp") + F.col("wrong")), 6).alias("f1"))
    runs = _runs(spark, sf_dir)
    out = compare_models(runs.drop("trained_on", "num_training_rows"), folds.join(runs.select("model_path", "model_name"), "model_path").drop("model_path"))
    return out.withColumn("cv_f1_mean", F.bround("cv_f1_mean", 6)).withColumn("cv_f1_std", F.bround("cv_f1_std", 6))


_COMPARISON_SQL = _RUNS_SQL + (
    f", r_fold AS (SELECT department, month(event_date) % 5 AS fold, attended AS label, CAST({O.SCORE_SQL} AS INTEGER) / CAST(100 AS DOUBLE) AS p FROM r_flat)\n"
    ", r_foldf AS (SELECT department, round_even(2 * sum(CASE WHEN p >= 0.5e0 AND label = 1 THEN 1 ELSE 0 END) / "
    "CAST(2 * sum(CASE WHEN p >= 0.5e0 AND label = 1 THEN 1 ELSE 0 END) + sum(CASE WHEN (p >= 0.5e0) <> (label = 1) THEN 1 ELSE 0 END) AS DOUBLE), 6) AS f1 "
    "FROM r_fold GROUP BY department, fold)\n"
    ", r_cv AS (SELECT 'models/' || department AS model_path, round_even(avg(f1), 6) AS cv_f1_mean, round_even(stddev_pop(f1), 6) AS cv_f1_std FROM r_foldf GROUP BY department)\n"
    ", r_comp AS (SELECT model_name, train_order, f1_score, auc_roc, accuracy, model_path, cv_f1_mean, cv_f1_std, "
    "row_number() OVER (ORDER BY f1_score DESC, train_order) = 1 AS is_winner FROM r_runs LEFT JOIN r_cv USING (model_path))\n")


@register("model_comparison", O.with_flat(_COMPARISON_SQL + "SELECT * FROM r_comp"))
def q_comparison(spark, sf_dir):
    return _compared(spark, sf_dir)


@register("pick_winner", O.with_flat(_COMPARISON_SQL + "SELECT * FROM r_comp WHERE is_winner"))
def q_pick_winner(spark, sf_dir):
    return _compared(spark, sf_dir).filter("is_winner")


def _meta(spark, sf_dir):
    """Metadata rows of the runs: two generations of each model, features named by topic."""
    from pyspark.sql import functions as F

    runs = _runs(spark, sf_dir)
    names = F.array(*[F.concat(F.lit(f"feature_{i:02d}_of_"), F.col("model_name")) for i in range(20)])
    both = runs.withColumn("generation", F.explode(F.array(F.lit(1), F.lit(2))))
    return both.select(
        "model_name", F.concat(F.date_format("trained_on", "yyyyMMdd"), F.lit("_"), F.col("generation").cast("string")).alias("timestamp"),
        F.slice(names, F.lit(1), F.col("train_order") + 14).alias("feature_columns"),
        F.struct("accuracy", F.bround(F.col("f1_score") / F.col("generation"), 6).alias("f1_score"), "auc_roc", F.lit(0.42).alias("threshold")).alias("metrics"),
        F.when(F.col("train_order") != 1, F.lit(0.42)).alias("threshold"),
        F.concat_ws("_", "model_path", F.col("generation").cast("string")).alias("model_path"))


@register("resolve_winner", O.with_flat(_COMPARISON_SQL + (
    "SELECT 'comparison' AS asked, model_name, 'comparison' AS source FROM r_comp WHERE is_winner "
    "UNION ALL SELECT 'no comparison', model_name, 'metadata' FROM (SELECT model_name FROM r_runs ORDER BY round_even(f1_score / 2, 6) DESC, "
    "list_position(['xgboost', 'random_forest', 'logistic_regression', 'scorecard'], model_name) LIMIT 1) "
    "UNION ALL SELECT 'winner missing', model_name, 'metadata' FROM (SELECT r.model_name FROM r_runs r JOIN r_comp c USING (model_name) WHERE NOT c.is_winner "
    "ORDER BY round_even(r.f1_score / 2, 6) DESC, list_position(['xgboost', 'random_forest', 'logistic_regression', 'scorecard'], r.model_name) LIMIT 1)")))
def q_resolve(spark, sf_dir):
    """R3 with a comparison, with metadata alone, and with the winner's folder missing."""
    from pyspark.sql import functions as F

    from rollcall.plans.registry import resolve_winner

    comp, meta = _compared(spark, sf_dir), _meta(spark, sf_dir)
    there = meta.join(comp.filter("is_winner").select("model_name"), "model_name", "left_anti").select("model_path")
    asked = {"comparison": resolve_winner(comp, meta), "no comparison": resolve_winner(None, meta), "winner missing": resolve_winner(comp, meta, there)}
    parts = [df.select(F.lit(k).alias("asked"), "model_name", "source") for k, df in asked.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@register("retrain_decision", O.with_flat(_RUNS_SQL + (
    "SELECT n.model_name AS new_model, n.f1_score AS new_f1, o.model_name AS old_model, o.f1_score AS old_f1, "
    "round_even(n.f1_score - o.f1_score, 6) AS improvement, n.f1_score - o.f1_score >= 0.01e0 AS deploy, "
    "CASE WHEN n.f1_score - o.f1_score >= 0.01e0 THEN 'improved' ELSE 'kept current' END AS reason "
    "FROM r_runs n CROSS JOIN (SELECT * FROM r_runs WHERE train_order = 2) o")))
def q_decision(spark, sf_dir):
    """Every run as a challenger of the active version."""
    from pyspark.sql import functions as F

    from rollcall.plans.registry import active_model, retrain_decision

    out = retrain_decision(active_model(_versions(spark, sf_dir)), _runs(spark, sf_dir))
    return out.withColumn("improvement", F.bround("improvement", 6))


def _log(spark, sf_dir):
    """Retrain log: a row per event topic, dated by its rank."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    t = flat(spark, sf_dir).groupBy("topic").agg(F.count(F.lit(1)).alias("rows"), F.bround(F.avg(F.col("attended").cast("double")), 6).alias("f1"))
    t = t.withColumn("i", F.row_number().over(Window.orderBy("topic")))  # one row per topic
    return t.select(F.expr("timestamp '2025-01-01' + make_interval(0, 0, 0, i)").alias("ts"), F.col("topic").alias("model"), "f1",
                    (F.col("f1") / 2).alias("auc"), (F.col("i") % 3 == 0).alias("deployed"), "rows")


_LOG_SQL = (", r_log AS (SELECT TIMESTAMP '2025-01-01' + INTERVAL 1 DAY * row_number() OVER (ORDER BY topic) AS ts, topic AS model, f1, f1 / 2 AS auc, "
            "row_number() OVER (ORDER BY topic) % 3 = 0 AS deployed, n AS rows FROM (SELECT topic, count(*) AS n, "
            "round_even(avg(CAST(attended AS DOUBLE)), 6) AS f1 FROM r_flat GROUP BY topic))\n")


@register("sink_dataset", O.with_flat("SELECT '1' AS version, * FROM r_flat WHERE event_date < DATE '2024-08-01' UNION ALL SELECT '2', * FROM r_flat"))
def q_sink_dataset(spark, sf_dir):
    """Two versions of the dataset written, the earlier one kept, both read back."""
    import uuid

    from pyspark.sql import functions as F

    from rollcall.session import shared_folder
    from rollcall.sources.tables import sink_dataset

    path, f = f"{shared_folder(spark)}/rollcall_dataset/{uuid.uuid4().hex}", stored_flat(spark, sf_dir)
    parts = {"1": f.filter(F.col("event_date") < CUTOFF), "2": f}
    read = [spark.read.parquet(sink_dataset(df, path, v)).select(F.lit(v).alias("version"), *f.columns) for v, df in parts.items()]
    return read[0].unionByName(read[1])


@register("retrain_log_tail", O.with_flat(_LOG_SQL + "SELECT * FROM r_log ORDER BY ts DESC LIMIT 10"))
def q_log_tail(spark, sf_dir):
    """The log appended in two parts to a table, read back, its last ten rows."""
    import uuid

    from rollcall.session import shared_folder
    from rollcall.sources.tables import RETRAIN_LOG_SCHEMA, retrain_log_tail

    path = f"{shared_folder(spark)}/rollcall_log/{uuid.uuid4().hex}"
    log = _log(spark, sf_dir)
    for part in ("ts < timestamp '2025-01-06'", "ts >= timestamp '2025-01-06'"):
        log.filter(part).write.mode("append").parquet(path)
    return retrain_log_tail(spark.read.schema(RETRAIN_LOG_SCHEMA).parquet(path))


_IMPORTANCE_SQL = (", r_imp AS (SELECT 'topic=' || topic AS feature, round_even(avg(CAST(attended AS DOUBLE)), 6) AS importance FROM r_flat GROUP BY topic "
                   "UNION ALL SELECT 'day=' || day_of_week, round_even(avg(CAST(attended AS DOUBLE)), 6) FROM r_flat GROUP BY day_of_week)\n")


@register("top_features", O.with_flat(_IMPORTANCE_SQL + "SELECT * FROM r_imp ORDER BY importance DESC, feature LIMIT 15"))
def q_top_features(spark, sf_dir):
    """T2 over a table of feature weights (attendance rates by topic and day)."""
    from pyspark.sql import functions as F

    from rollcall.plans.registry import top_features

    f = stored_flat(spark, sf_dir)
    rate = F.bround(F.avg(F.col("attended").cast("double")), 6).alias("importance")
    by = lambda col, name: f.groupBy(F.concat(F.lit(f"{name}="), F.col(col)).alias("feature")).agg(rate)
    return top_features(by("topic", "topic").unionByName(by("day_of_week", "day")))


_TITLES = {"xgboost": "XGBoost", "random_forest": "Random Forest", "logistic_regression": "Logistic Regression", "scorecard": "Scorecard"}


@register("model_details", O.with_flat(_COMPARISON_SQL + _LOG_SQL.replace("r_log AS", "r_log AS") + (
    "SELECT w.model_name AS winner, CASE w.model_name " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _TITLES.items()) + " END AS winner_display, "
    "round_even(w.f1_score / 2, 6) AS f1_score, 0.42e0 AS threshold, CAST(w.train_order + 14 AS INTEGER) AS feature_count, "
    "array_to_string(list_transform(range(0, least(15, CAST(w.train_order + 14 AS INTEGER))), lambda j: 'feature_' || lpad(CAST(j AS VARCHAR), 2, '0') || '_of_' || w.model_name), ',') AS first_features, "
    "(SELECT string_agg(model_name || ':' || CAST(is_winner AS VARCHAR), ',' ORDER BY train_order) FROM r_comp) AS comparison, "
    "(SELECT string_agg(model, ',' ORDER BY ts) FROM (SELECT * FROM r_log ORDER BY ts DESC LIMIT 10)) AS retrain_history "
    "FROM r_comp w WHERE is_winner")))
def q_details(spark, sf_dir):
    from pyspark.sql import functions as F

    from rollcall.plans.registry import model_details

    d = model_details(_compared(spark, sf_dir), _meta(spark, sf_dir), _log(spark, sf_dir))
    comparison = F.transform("comparison", lambda c: F.concat(c["model_name"], F.lit(":"), c["is_winner"].cast("string")))
    return d.select("winner", "winner_display", F.col("metrics.f1_score").alias("f1_score"), "threshold", "feature_count",
                    F.array_join("first_features", ",").alias("first_features"), F.array_join(comparison, ",").alias("comparison"),
                    F.array_join(F.transform("retrain_history", lambda h: h["model"]), ",").alias("retrain_history"))


TRAINED_ON = "2025-03-01"


@register("retrain_due", O.with_flat(
    f"SELECT new_events, new_events >= 10 AS due FROM (SELECT CAST(count(DISTINCT event_id) AS BIGINT) AS new_events "
    f"FROM r_flat WHERE event_date > DATE '{TRAINED_ON}')"))
def q_retrain_due(spark, sf_dir):
    from rollcall.plans.registry import retrain_due

    return retrain_due(flat(spark, sf_dir), TRAINED_ON)


# ---- D1-D3, P13, J5-J7, U1, A18 prediction ---------------------------------------------------------
from rollcall.plans import predict as PR  # noqa: E402

_PLANNED_SQL = (
    ", r_planned AS (SELECT 'PLN_' || substr(event_id, 5) AS event_id, topic, speaker_type, day_of_week, time_slot, "
    "duration_minutes, mode, exam_proximity, promotion_level, num_registrations, event_date + 364 AS event_date "
    "FROM r_events)\n")


def planned(spark, sf_dir, facts=None):
    return PR.planned_events_from_history(X.events(spark, sf_dir, facts))


@register("required_fields", O.with_flat(_PLANNED_SQL + (
    "SELECT event_id, topic, speaker_type, day_of_week, time_slot, mode, promotion_level, "
    "CAST(duration_minutes AS INTEGER) AS duration_minutes, CAST(exam_proximity AS INTEGER) AS exam_proximity, "
    "CAST(num_registrations AS BIGINT) AS num_registrations, coalesce(event_date, current_date) AS event_date, "
    "list_filter([" + ", ".join(f"CASE WHEN {c} IS NULL THEN '{c}' END" for c in PR.REQUIRED) +
    "], lambda x: x IS NOT NULL) AS missing FROM r_planned")))
def q_required(spark, sf_dir):
    return PR.required_fields(planned(spark, sf_dir))


_GAPS_SQL = (
    ", r_gaps AS (SELECT event_id, CASE WHEN right(event_id, 1) <> '5' THEN topic END AS topic, speaker_type, day_of_week, time_slot, duration_minutes, mode, "
    "exam_proximity, CASE WHEN right(event_id, 1) NOT IN ('5', '7') THEN promotion_level END AS promotion_level, num_registrations FROM r_planned)\n")


@register("required_fields_missing", O.with_flat(_PLANNED_SQL + _GAPS_SQL + (
    "SELECT event_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN {c} IS NULL THEN '{c}' END" for c in PR.REQUIRED) +
    "], lambda x: x IS NOT NULL), ',') AS missing FROM r_gaps WHERE topic IS NULL OR promotion_level IS NULL")))
def q_required_missing(spark, sf_dir):
    """P13 on planned events that lack fields: only these, with what they lack."""
    from pyspark.sql import functions as F

    p, last = planned(spark, sf_dir), F.substring("event_id", -1, 1)
    p = p.withColumn("topic", F.when(last != "5", F.col("topic"))).withColumn("promotion_level", F.when(~last.isin("5", "7"), F.col("promotion_level")))
    out = PR.required_fields(p).filter(F.size("missing") > 0)
    return out.select("event_id", F.array_join("missing", ",").alias("missing"))


_CAND_SQL = _PLANNED_SQL + (
    ", r_stu AS (" + _STUDENT_SQL + ")\n"
    ", r_stu_rank AS (SELECT *, row_number() OVER (ORDER BY md5('42|' || student_id)) - 1 AS rank FROM r_stu)\n"
    ", r_cand AS (SELECT s.student_id, p.event_id, s.rank, p.event_date, p.num_registrations FROM r_planned p "
    "JOIN r_stu_rank s ON s.rank < p.num_registrations)\n")


@register("sample_students_per_event", O.with_flat(_CAND_SQL + "SELECT event_id, student_id, rank FROM r_cand"))
def q_sample(spark, sf_dir):
    from rollcall.operators.sampling import sample_students_per_event
    from rollcall.sources.tables import normalise_students

    facts = shared_facts(spark, sf_dir)
    s = sample_students_per_event(planned(spark, sf_dir, facts), normalise_students(flat(spark, sf_dir, facts)))
    return s.select("event_id", "student_id", "rank")


@register("candidate_cross", O.with_flat(_CAND_SQL + (
    "SELECT c.student_id, c.event_id, 'On-time' AS registration_timing, s.department, s.semester, s.club_activity_level, "
    "s.cgpa, p.topic, p.speaker_type, p.day_of_week, p.time_slot, p.duration_minutes, p.mode, p.exam_proximity, "
    "p.promotion_level, p.num_registrations, p.event_date FROM r_cand c JOIN r_stu s ON c.student_id = s.student_id "
    "JOIN r_planned p ON c.event_id = p.event_id")))
def q_candidates(spark, sf_dir):
    facts = shared_facts(spark, sf_dir)
    c = PR.candidate_rows(planned(spark, sf_dir, facts), flat(spark, sf_dir, facts))
    return c.select("student_id", "event_id", "registration_timing", "department", "semester", "club_activity_level",
                    "cgpa", "topic", "speaker_type", "day_of_week", "time_slot", "duration_minutes", "mode",
                    "exam_proximity", "promotion_level", "num_registrations", "event_date")


@register("union_history_candidates", O.with_flat(_CAND_SQL + (
    "SELECT student_id, event_id, event_date, 0 AS is_candidate FROM r_flat UNION ALL "
    "SELECT student_id, event_id, event_date, 1 FROM r_cand")))
def q_union(spark, sf_dir):
    facts = shared_facts(spark, sf_dir)
    f = stored_flat(spark, sf_dir, facts)
    c = PR.candidate_rows(planned(spark, sf_dir, facts), f)
    u = PR.union_history_candidates(f.select("student_id", "event_id", "event_date"), c.select("student_id", "event_id", "event_date"))
    return u.withColumnRenamed("_cand", "is_candidate")


_ASOF_SQL = _CAND_SQL + f"""
, r_hs1 AS (SELECT student_id, event_id, event_date, attended, row_number() OVER (w) AS rn,
    coalesce(attended <> lag(attended) OVER (w), true) AS chg FROM r_flat WINDOW w AS ({O._W}))
, r_hs2 AS (SELECT *, max(CASE WHEN chg THEN rn END) OVER ({O._W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS st FROM r_hs1)
, r_hs AS (SELECT student_id, event_id, event_date, 0 AS cand,
    avg(attended) OVER ({O._W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS rolling,
    CAST(sum(attended) OVER ({O._W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS cum,
    CAST(rn AS BIGINT) AS total,
    CAST((CASE WHEN attended = 1 THEN 1 ELSE -1 END) * (rn - st + 1) AS BIGINT) AS streak,
    stddev_samp(attended) OVER ({O._W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sd,
    avg(attended) OVER ({O._W} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS recent3 FROM r_hs2)
, r_asof AS (SELECT c.student_id, c.event_id, h.rolling, h.cum, h.total, h.streak, h.sd, h.recent3 FROM r_cand c
    ASOF LEFT JOIN (SELECT student_id, event_date, max_by(rolling, event_id) AS rolling, max(cum) AS cum, max(total) AS total, max_by(streak, event_id) AS streak,
      max_by(sd, event_id) AS sd, max_by(recent3, event_id) AS recent3 FROM r_hs GROUP BY student_id, event_date) h
    ON c.student_id = h.student_id AND c.event_date >= h.event_date)
, r_ov AS (SELECT avg(CAST(attended AS DOUBLE)) AS overall FROM r_flat)
"""


@register("asof_student_state", O.with_flat(_ASOF_SQL + """
SELECT a.student_id, a.event_id,
  coalesce(a.rolling, o.overall) AS student_rolling_attendance, coalesce(a.cum, 0) AS student_cumulative_attended,
  coalesce(a.total, 0) AS student_total_events, coalesce(a.streak, 0) AS attendance_streak,
  round_even(coalesce(a.sd, 0.5), 6) AS student_attendance_std, coalesce(a.recent3, o.overall) AS student_recent_3_rate
FROM r_asof a CROSS JOIN r_ov o"""))
def q_asof(spark, sf_dir):
    from pyspark.sql import functions as F

    from rollcall.operators.history import overall_rate
    from rollcall.session import cut_lineage

    facts = shared_facts(spark, sf_dir)
    f = stored_flat(spark, sf_dir, facts, [*X.STUDENT_COLUMNS, "event_id", "event_date", "attended"])
    c = cut_lineage(PR.candidate_rows(planned(spark, sf_dir, facts), f).select("student_id", "event_id", "event_date"))
    s = PR.asof_student_state(f, c, overall_rate(f))
    return s.withColumn("student_attendance_std", F.bround("student_attendance_std", 6))


@register("topic_history_reference", O.with_flat(_PLANNED_SQL + (
    ", r_ts AS (SELECT topic, count(DISTINCT event_id) AS events, round_even(avg(CAST(attended AS DOUBLE)), 4) AS rate "
    "FROM r_flat GROUP BY topic)\n"
    "SELECT p.event_id, p.topic, t.events AS historical_events, t.rate AS historical_rate FROM r_planned p "
    "LEFT JOIN r_ts t ON p.topic = t.topic")))
def q_topic_ref(spark, sf_dir):
    from pyspark.sql import functions as F

    facts = shared_facts(spark, sf_dir)
    f = flat(spark, sf_dir, facts)
    ts = f.groupBy("topic").agg(F.count_distinct("event_id").cast("long").alias("historical_events"),
                                F.bround(F.avg(F.col("attended").cast("double")), 4).alias("historical_rate"))
    return planned(spark, sf_dir, facts).select("event_id", "topic").join(ts, "topic", "left").select(
        "event_id", "topic", "historical_events", "historical_rate")


def _served(spark, sf_dir, history):
    """The logistic model, fitted in this query."""
    fitted, prep = _fit(spark, sf_dir, "logistic_regression", history)
    return fitted.model, prep.state, float(fitted.metrics["threshold"])


def _serving_state(history):
    """Feature state fitted on the history alone (rates, means, categories, medians)."""
    from pyspark.sql import functions as F

    from rollcall.operators.quantile import exact_medians
    from rollcall.plans.features import run_feature_pipeline
    from rollcall.session import cut_lineage

    df, cols, state = run_feature_pipeline(history)
    df = cut_lineage(df.select(*[F.col(f"`{c}`") for c in cols]))  # read by each pass of the medians
    nulls = df.agg(*[F.sum(F.col(f"`{c}`").isNull().cast("int")).alias(c) for c in cols]).first()
    state.medians = {k: v for k, v in exact_medians(df, [c for c in cols if nulls[c]]).items() if v is not None}
    return state


_D3_SQL = (
    ", r_med AS (SELECT median(cgpa) AS m_cgpa, median(student_quality_score) AS m_sqs, "
    "median(combined_quality_attract) AS m_cqa FROM r_features)\n"
    ", r_cst AS (SELECT a.student_id, a.event_id, coalesce(a.rolling, o.overall) AS student_rolling_attendance, "
    "coalesce(a.cum, 0) AS student_cumulative_attended, coalesce(a.total, 0) AS student_total_events, "
    "coalesce(a.streak, 0) AS attendance_streak, coalesce(a.sd, 0.5) AS student_attendance_std, "
    "coalesce(a.recent3, o.overall) AS student_recent_3_rate FROM r_asof a CROSS JOIN r_ov o)\n"
    ", r_c0 AS (SELECT c.student_id, c.event_id, 'On-time' AS registration_timing, s.department, s.semester, "
    "s.club_activity_level, s.cgpa, p.event_date, p.topic, p.speaker_type, p.day_of_week, p.time_slot, "
    "p.duration_minutes, p.mode, p.exam_proximity, p.promotion_level, p.num_registrations, 0.0e0 AS past_attendance_rate, "
    "CAST(0 AS BIGINT) AS past_events_count, st.* EXCLUDE (student_id, event_id) FROM r_cand c "
    "JOIN r_stu s ON c.student_id = s.student_id JOIN r_planned p ON c.event_id = p.event_id "
    "JOIN r_cst st ON st.student_id = c.student_id AND st.event_id = c.event_id)\n"
    ", r_c1 AS (SELECT c.*, CAST(month(event_date) AS INTEGER) AS month, "
    "CASE WHEN day_of_week IN ('Saturday', 'Sunday') THEN 1 ELSE 0 END AS is_weekend, "
    "CAST(greatest(1, date_diff('day', make_date(year(event_date), CASE WHEN month(event_date) >= 8 THEN 8 ELSE 1 END, 1), "
    "event_date) // 7 + 1) AS INTEGER) AS semester_week, "
    "CASE WHEN cgpa >= 8.0 THEN 1 ELSE 0 END AS cgpa_band_high, CASE WHEN cgpa < 6.0 THEN 1 ELSE 0 END AS cgpa_band_low, "
    "coalesce(rt.rate, o.overall) AS topic_popularity, coalesce(rs.rate, o.overall) AS speaker_pull, "
    "coalesce(rd.rate, o.overall) AS dept_engagement, coalesce(rl.rate, o.overall) AS timeslot_popularity, "
    "coalesce(ry.rate, o.overall) AS day_popularity, num_registrations / o.mean_regs AS registration_density "
    "FROM r_c0 c CROSS JOIN r_overall o LEFT JOIN r_rate_topic rt ON c.topic = rt.k "
    "LEFT JOIN r_rate_speaker_type rs ON c.speaker_type = rs.k LEFT JOIN r_rate_department rd ON c.department = rd.k "
    "LEFT JOIN r_rate_time_slot rl ON c.time_slot = rl.k LEFT JOIN r_rate_day_of_week ry ON c.day_of_week = ry.k)\n"
)


def _d3_interactions_sql() -> str:
    t = O._ordinal
    return (
        ", r_c2 AS (SELECT *, CASE WHEN exam_proximity = 1 THEN 1 ELSE 0 END AS exam_is_near, "
        "CASE WHEN duration_minutes > 120 THEN 1 ELSE 0 END AS is_long_workshop, "
        f"{t('club_activity_level', K.LEVEL_CODE)} AS club_activity_numeric, "
        f"{t('registration_timing', K.TIMING_CODE)} AS reg_timing_numeric, "
        f"{t('registration_timing', K.TIMING_CODE)} AS registration_timing_encoded, "
        f"{t('promotion_level', K.LEVEL_CODE)} AS promotion_level_encoded, {t('mode', K.MODE_CODE)} AS mode_encoded, "
        "CASE WHEN " + " OR ".join(
            f"(department = '{d}' AND topic IN ({O._q(ts)}))" for d, ts in K.SCHOOL_TOPICS.items()) +
        " THEN 1 ELSE 0 END AS dept_topic_match FROM r_c1)\n"
        ", r_c3 AS (SELECT *, CASE WHEN promotion_level = 'High' THEN 1 ELSE 0 END * topic_popularity AS high_promo_popular_topic, "
        "student_rolling_attendance * club_activity_numeric AS student_engagement_score, "
        "cgpa / CAST(10 AS DOUBLE) * 0.3e0 + club_activity_numeric / CAST(3 AS DOUBLE) * 0.3e0 "
        "+ student_rolling_attendance * 0.4e0 AS student_quality_score, "
        "speaker_pull * 0.35e0 + topic_popularity * 0.35e0 + timeslot_popularity * 0.15e0 + day_popularity * 0.15e0 "
        "AS event_attractiveness, exam_is_near * (3 - club_activity_numeric) AS exam_pressure, "
        "reg_timing_numeric * registration_density AS registration_commitment FROM r_c2)\n"
        ", r_c4 AS (SELECT *, student_quality_score * event_attractiveness AS combined_quality_attract, "
        "student_recent_3_rate * event_attractiveness AS recent_att_x_event, " + O._onehot_sql() + " FROM r_c3)\n"
    )


def _d3_select_sql() -> str:
    fills = {"cgpa": "m_cgpa", "student_quality_score": "m_sqs", "combined_quality_attract": "m_cqa"}
    cols = []
    for c in _feature_names():
        if c in fills:
            cols.append(f"coalesce(CAST({c} AS DOUBLE), {fills[c]}) AS {c}")
        elif c == "student_attendance_std":
            cols.append("round_even(student_attendance_std, 6) AS student_attendance_std")
        else:
            cols.append(_quote(c))
    return "SELECT student_id, event_id, " + ", ".join(cols) + " FROM r_c4 CROSS JOIN r_med"


@register("planned_event_features", O.with_features(_ASOF_SQL + _D3_SQL + _d3_interactions_sql() + _d3_select_sql()))
def q_planned_features(spark, sf_dir):
    from pyspark.sql import functions as F

    facts = shared_facts(spark, sf_dir)
    f = stored_flat(spark, sf_dir, facts)
    state = _serving_state(f)
    valid = PR.required_fields(planned(spark, sf_dir, facts)).filter("size(missing) = 0").drop("missing")
    out = PR.planned_event_features(f, valid, state)
    return out.withColumn("student_attendance_std", F.bround("student_attendance_std", 6))


@register("planned_event_features_asof", O.with_features(_ASOF_SQL + _D3_SQL.replace("0.0e0 AS past_attendance_rate", "round_even(CASE WHEN st.student_total_events > 0 THEN st.student_rolling_attendance ELSE 0 END, 3) AS past_attendance_rate")
    .replace("CAST(0 AS BIGINT) AS past_events_count", "CAST(st.student_total_events AS BIGINT) AS past_events_count") + _d3_interactions_sql() + _d3_select_sql()))
def q_planned_features_asof(spark, sf_dir):
    """D3 with each student's own past as of the event's day."""
    facts = shared_facts(spark, sf_dir)
    f = stored_flat(spark, sf_dir, facts)
    state = _serving_state(f)
    valid = PR.required_fields(planned(spark, sf_dir, facts)).filter("size(missing) = 0").drop("missing")
    out = PR.planned_event_features(f, valid, state, past="asof")
    return out.withColumn("student_attendance_std", F_.bround("student_attendance_std", 6))


def _d3_include_sql() -> str:
    """D3 where each event's own planned rows (outcome 0) enter its rates and means."""
    sums = "".join(
        f", r_sum_{c} AS (SELECT {c} AS k, CAST(sum(attended) AS DOUBLE) AS s, CAST(count(*) AS DOUBLE) AS c FROM r_flat GROUP BY {c})\n"
        for c in ("topic", "speaker_type", "department", "time_slot", "day_of_week"))
    sums += (
        ", r_t AS (SELECT CAST(count(*) AS DOUBLE) AS n, CAST(sum(attended) AS DOUBLE) AS s, CAST(sum(num_registrations) AS DOUBLE) AS regs FROM r_flat)\n"
        ", r_m AS (SELECT c.event_id, s.department, CAST(count(*) AS DOUBLE) AS md, CAST(sum(count(*)) OVER (PARTITION BY c.event_id) AS DOUBLE) AS m "
        "FROM r_cand c JOIN r_stu s ON c.student_id = s.student_id GROUP BY c.event_id, s.department)\n")
    sql = _D3_SQL.replace("coalesce(a.rolling, o.overall)", "a.rolling").replace("coalesce(a.recent3, o.overall)", "a.recent3")
    for alias, name, own in (("rt", "topic_popularity", "m"), ("rs", "speaker_pull", "m"), ("rd", "dept_engagement", "md"), ("rl", "timeslot_popularity", "m"), ("ry", "day_popularity", "m")):
        sql = sql.replace(f"coalesce({alias}.rate, o.overall) AS {name}", f"coalesce({alias}.s, 0) / (coalesce({alias}.c, 0) + mm.{own}) AS {name}")
    whole = "t.s / (t.n + mm.m)"
    sql = sql.replace("num_registrations / o.mean_regs", "num_registrations / ((t.regs + mm.m * num_registrations) / (t.n + mm.m))")
    sql = sql.replace(", r_c1 AS (SELECT c.*, ", f", r_c1 AS (SELECT c.* REPLACE (coalesce(c.student_rolling_attendance, {whole}) AS student_rolling_attendance, "
                      f"coalesce(c.student_recent_3_rate, {whole}) AS student_recent_3_rate), ")
    sql = sql.replace("FROM r_c0 c CROSS JOIN r_overall o ", "FROM r_c0 c CROSS JOIN r_t t JOIN r_m mm ON mm.event_id = c.event_id AND mm.department = c.department ")
    return sums + sql.replace("r_rate_", "r_sum_") + _d3_interactions_sql() + _d3_select_sql()


@register("planned_event_features_include", O.with_features(_ASOF_SQL + _d3_include_sql()))
def q_planned_features_include(spark, sf_dir):
    """D3 with placeholder='include' (each event's own planned rows enter its rates)."""
    facts = shared_facts(spark, sf_dir)
    f = stored_flat(spark, sf_dir, facts)
    state = _serving_state(f)
    valid = PR.required_fields(planned(spark, sf_dir, facts)).filter("size(missing) = 0").drop("missing")
    out = PR.planned_event_features(f, valid, state, placeholder="include")
    return out.withColumn("student_attendance_std", F_.bround("student_attendance_std", 6))


@register("predict_planned_events", None)
def q_predict(spark, sf_dir):
    facts = shared_facts(spark, sf_dir)
    f = stored_flat(spark, sf_dir, facts)
    model, state, t = _served(spark, sf_dir, f)
    return PR.predict_planned_events(model, state, t, f, planned(spark, sf_dir, facts))


@register("event_turnout", O.with_flat(_CAND_SQL + (
    f", r_cs AS (SELECT c.event_id, p.num_registrations, p.p FROM r_cand c JOIN (SELECT student_id, event_id, CAST({O.SCORE_SQL} AS INTEGER) / CAST(100 AS DOUBLE) AS p, "
    "num_registrations FROM (SELECT s.*, p.*, 'On-time' AS registration_timing FROM r_cand k JOIN r_stu s USING (student_id) "
    "JOIN (SELECT event_id, topic, speaker_type, day_of_week, time_slot, duration_minutes, mode, exam_proximity, promotion_level, num_registrations, event_date FROM r_planned) p USING (event_id))) p "
    "USING (student_id, event_id))\n"
    "SELECT event_id, CAST(sum(CASE WHEN p >= 0.5e0 THEN 1 ELSE 0 END) AS BIGINT) AS predicted_attendees, CAST(min(num_registrations) AS BIGINT) AS total_registered, "
    "round_even(sum(CASE WHEN p >= 0.5e0 THEN 1 ELSE 0 END) / CAST(greatest(min(num_registrations), 1) AS DOUBLE), 6) AS attendance_rate, "
    "round_even(CAST(sum(CAST(round(p * 100) AS BIGINT)) AS DOUBLE) / (100 * count(*)), 6) AS avg_probability, CAST(count(*) AS BIGINT) AS scored_students FROM r_cs GROUP BY event_id")))
def q_event_turnout(spark, sf_dir):
    """A18 over the candidates of planned events, scored by the scorecard."""
    from pyspark.sql import functions as F

    facts = shared_facts(spark, sf_dir)
    c = PR.candidate_rows(planned(spark, sf_dir, facts), flat(spark, sf_dir, facts))
    scored = c.select("event_id", "num_registrations", SC.score_probability(c.columns).alias("p"))
    out = PR.event_turnout(scored, 0.5).drop("confidence")
    return out.withColumn("attendance_rate", F.bround("attendance_rate", 6)).withColumn("avg_probability", F.bround("avg_probability", 6))


@register("predict_batch", None)
def q_predict_batch(spark, sf_dir):
    f = stored_flat(spark, sf_dir)
    model, state, _ = _served(spark, sf_dir, f)
    return PR.predict_batch(model, state, f)


# ---- P17-P21 bands and display labels ------------------------------------------------------------
from rollcall.functions import scalar as SS  # noqa: E402

_EVENT_STATS_SQL = (
    f", r_es AS (SELECT event_id, CAST(sum(attended) AS BIGINT) AS attendees, avg(CAST(attended AS DOUBLE)) AS rate, "
    f"avg(CAST({O.SCORE_SQL} AS INTEGER)) / CAST(100 AS DOUBLE) AS mean_score FROM r_flat GROUP BY event_id)\n")


def _event_stats(spark, sf_dir):
    from pyspark.sql import functions as F

    f = flat(spark, sf_dir)
    return f.groupBy("event_id").agg(
        F.sum("attended").cast("long").alias("attendees"),
        F.avg(F.col("attended").cast("double")).alias("rate"),
        # mean of the integer hundredths, divided once: exact summation on every engine
        (F.avg(SC.score_pct(f.columns)) / F.lit(100.0)).alias("mean_score"),
    )


@register("advice_band", O.with_flat(_EVENT_STATS_SQL + (
    "SELECT event_id, attendees, CASE WHEN attendees < 20 THEN 'Low' WHEN attendees < 40 THEN 'Moderate' ELSE 'High' END "
    "AS advice FROM r_es")))
def q_advice(spark, sf_dir):
    return _event_stats(spark, sf_dir).select("event_id", "attendees", SS.advice_band("attendees").alias("advice"))


@register("rate_band", O.with_flat(_EVENT_STATS_SQL + (
    "SELECT event_id, rate, CASE WHEN rate >= 0.7 THEN 'high' WHEN rate >= 0.4 THEN 'medium' "
    "ELSE 'low' END AS band FROM r_es")))
def q_rate_band(spark, sf_dir):
    from pyspark.sql import functions as F

    return _event_stats(spark, sf_dir).select("event_id", "rate", SS.rate_band("rate").alias("band"))


@register("confidence_band", O.with_flat(_EVENT_STATS_SQL + (
    "SELECT event_id, mean_score, CASE WHEN mean_score > 0.3 THEN 'High' "
    "WHEN mean_score > 0.15 THEN 'Medium' ELSE 'Low' END AS confidence FROM r_es")))
def q_confidence(spark, sf_dir):
    from pyspark.sql import functions as F

    s = _event_stats(spark, sf_dir)
    return s.select("event_id", "mean_score", SS.confidence_band("mean_score").alias("confidence"))


@register("planning_band", O.with_flat(_EVENT_STATS_SQL + (
    "SELECT event_id, CASE WHEN rate > 0.75 THEN 'large' WHEN rate >= 0.5 THEN 'medium' ELSE 'small' END AS hall FROM r_es")))
def q_planning(spark, sf_dir):
    return _event_stats(spark, sf_dir).select("event_id", SS.planning_band("rate").alias("hall"))


@register("label_display", O.with_flat(
    "SELECT event_id, CASE exam_proximity WHEN 1 THEN 'Near' WHEN 2 THEN 'Moderate' WHEN 3 THEN 'Far' END AS exam_label, "
    "substr(day_of_week, 1, 3) AS day_short FROM r_events"))
def q_label_display(spark, sf_dir):
    return X.events(spark, sf_dir).select("event_id", SS.exam_label("exam_proximity").alias("exam_label"),
                                          SS.day_short("day_of_week").alias("day_short"))


# ---- S1/S10/S11 CSV source and sink round trip --------------------------------------------------
@register("scan_registrations", O.with_flat("SELECT * FROM r_flat"))
def q_scan_csv(spark, sf_dir):
    """Write the flat table as CSV (sink) into the shared folder, read it back with the
    declared schema (source) and the lenient date parse."""
    import uuid

    from pyspark.sql import functions as F

    from rollcall.session import ensure_checkpoint_dir

    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/rollcall_csv/{uuid.uuid4().hex}"
    f = flat(spark, sf_dir).withColumn("event_date", F.date_format("event_date", "yyyy-MM-dd"))
    f.write.mode("overwrite").option("header", True).csv(path)
    return TB.scan_registrations(spark, path)


_BAD = (("semester", "x"), ("cgpa", "3;1"), ("event_date", "soon"), ("num_registrations", "many"))
_BAD_SQL = ", r_bad AS (SELECT " + ", ".join(f"CASE WHEN md5('{c}|' || student_id || '|' || event_id) < '1' THEN '{c}' END AS b{i}" for i, (c, _) in enumerate(_BAD)) + " FROM r_flat)\n"


@register("scan_quarantine", O.with_flat(_BAD_SQL + (
    ", r_reason AS (" + " UNION ALL ".join(f"SELECT b{i} AS reason FROM r_bad WHERE b{i} IS NOT NULL" for i in range(len(_BAD)))
    + " UNION ALL SELECT 'accepted' FROM r_bad WHERE coalesce(" + ", ".join(f"b{i}" for i in range(len(_BAD))) + ") IS NULL "
    "UNION ALL SELECT 'quarantined' FROM r_bad WHERE coalesce(" + ", ".join(f"b{i}" for i in range(len(_BAD))) + ") IS NOT NULL)\n"
    "SELECT reason, count(*) AS rows FROM r_reason GROUP BY reason")))
def q_quarantine(spark, sf_dir):
    """S1 on a CSV in which a sixteenth of four columns' values cannot be read: rows
    accepted, rows set aside, and rows for each reason."""
    import uuid

    from pyspark.sql import functions as F

    from rollcall.session import shared_folder

    path = f"{shared_folder(spark)}/rollcall_csv/{uuid.uuid4().hex}"
    f = flat(spark, sf_dir).withColumn("event_date", F.date_format("event_date", "yyyy-MM-dd"))
    hit = lambda c: F.md5(F.concat_ws("|", F.lit(c), "student_id", "event_id")) < "1"
    spoilt = dict(_BAD)
    f.select(*[F.when(hit(c), F.lit(spoilt[c])).otherwise(F.col(c).cast("string")).alias(c) if c in spoilt else F.col(c) for c in f.columns]).write.option("header", True).csv(path)
    checked = TB.scan_checked(spark, path)
    kind = F.when(F.size("reasons") > 0, F.array_append("reasons", F.lit("quarantined"))).otherwise(F.array(F.lit("accepted")))
    return checked.select(F.explode(kind).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("rows"))


@register("bernoulli_sample", O.with_flat(
    "SELECT student_id, event_id, attended FROM r_flat WHERE substr(md5('42|' || student_id || '|' || event_id), 1, 8) < CASE attended WHEN 1 THEN '40000000' WHEN 0 THEN '19999999' END"))
def q_bernoulli(spark, sf_dir):
    """T6, approximate: a quarter of those who came and a tenth of the others."""
    return SP.bernoulli_sample(flat(spark, sf_dir), ["student_id", "event_id"], {1: 0.25, 0: 0.1}, "attended").select("student_id", "event_id", "attended")


@register("overview_sketches", O.with_flat(
    "SELECT CAST(date_trunc('month', event_date) AS DATE) AS month, count(*) AS registrations, round_even(avg(CAST(attended AS DOUBLE)), 6) AS avg_attendance, "
    "count(DISTINCT event_id) AS events, count(DISTINCT student_id) AS students, true AS within_bound FROM r_flat WHERE event_date IS NOT NULL GROUP BY 1"))
def q_overview_sketches(spark, sf_dir):
    """A1 by month from sketches kept per day, beside the exact counts: ``within_bound``
    tells that both estimates are within four standard errors."""
    from pyspark.sql import functions as F

    month = F.trunc("event_date", "month").alias("month")
    f = stored_flat(spark, sf_dir).filter("event_date IS NOT NULL")
    about = A.overview_of_days(A.day_sketches(f), month)
    exact = f.groupBy(month).agg(F.count_distinct("event_id").alias("events"), F.count_distinct("student_id").alias("students"))
    bound = 4 * 1.04 / 2 ** (A.SKETCH_BITS / 2)
    near = lambda e, x: F.abs(F.col(e) - F.col(x)) <= bound * F.col(x)
    return about.join(exact, "month").select(
        "month", "registrations", F.bround("avg_attendance", 6).alias("avg_attendance"), "events", "students",
        (near("total_events", "events") & near("total_students", "students")).alias("within_bound"))


@register("load_with_fallback", O.with_flat("SELECT * FROM r_flat"))
def q_fallback(spark, sf_dir):
    """Star tables are absent in a fresh folder -> the loader falls back to the CSV."""
    import uuid

    from pyspark.sql import functions as F

    from rollcall.session import ensure_checkpoint_dir

    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/rollcall_fallback/{uuid.uuid4().hex}"
    f = flat(spark, sf_dir).withColumn("event_date", F.date_format("event_date", "yyyy-MM-dd"))
    f.write.mode("overwrite").option("header", True).csv(f"{root}/flat_csv")
    return TB.load_with_fallback(spark, f"{root}/star", f"{root}/flat_csv")


# ---- the same window operators on the driver's activity stream (entity = user) --------------------
_UW = "PARTITION BY user_id ORDER BY ts, event_id"


_ACTIVITY_SQL = f"""
WITH a AS (SELECT user_id, ts, event_id, CAST(event_type = 'purchase' AS INTEGER) AS outcome FROM events),
o AS (SELECT avg(CAST(outcome AS DOUBLE)) AS overall FROM a),
h1 AS (SELECT *, row_number() OVER (w) AS rn, coalesce(outcome <> lag(outcome) OVER (w), true) AS chg FROM a WINDOW w AS ({_UW})),
h2 AS (SELECT *, max(CASE WHEN chg THEN rn END) OVER ({_UW} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS st FROM h1),
h3 AS (SELECT *, (CASE WHEN outcome = 1 THEN 1 ELSE -1 END) * (rn - st + 1) AS run FROM h2)
SELECT user_id, event_id,
  round_even(coalesce(avg(outcome) OVER ({_UW} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), o.overall), 9) AS rolling_rate,
  CAST(coalesce(sum(outcome) OVER ({_UW} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS prior_outcomes,
  CAST(rn - 1 AS BIGINT) AS prior_events,
  CAST(coalesce(lag(run) OVER ({_UW}), 0) AS BIGINT) AS streak,
  round_even(coalesce(stddev_samp(outcome) OVER ({_UW} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.5), 6) AS consistency,
  round_even(coalesce(avg(outcome) OVER ({_UW} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), o.overall), 9) AS recent_3_rate
FROM h3 CROSS JOIN o"""


@register("activity_history", _ACTIVITY_SQL)
def q_activity_history(spark, sf_dir, **split):
    from pyspark.sql import functions as F

    from rollcall.operators.history import history_features

    a = X.activity_events(spark, sf_dir)
    h = history_features(a, entity="user_id", order=("ts", "event_id"), outcome="outcome", **split)
    return h.select(
        "user_id", "event_id",
        F.bround("student_rolling_attendance", 9).alias("rolling_rate"),
        F.col("student_cumulative_attended").alias("prior_outcomes"),
        F.col("student_total_events").alias("prior_events"),
        F.col("attendance_streak").alias("streak"),
        F.bround("student_attendance_std", 6).alias("consistency"),
        F.bround("student_recent_3_rate", 9).alias("recent_3_rate"),
    )


@register("activity_history_split", _ACTIVITY_SQL)
def q_activity_history_split(spark, sf_dir):
    """W1-W6 on activity with every user on the segmented route, a segment an hour."""
    return q_activity_history(spark, sf_dir, hot_rows=0, span="hour")


@register("activity_rate_by_type", """
SELECT event_type AS label, round_even(avg(CAST(event_type = 'purchase' AS INTEGER)), 4) AS rate, count(*) AS n
FROM events WHERE event_type IS NOT NULL GROUP BY event_type""")
def q_activity_rates(spark, sf_dir):
    from pyspark.sql import functions as F

    a = X.activity_events(spark, sf_dir)
    return a.filter(F.col("event_type").isNotNull()).groupBy(F.col("event_type").alias("label")).agg(
        F.bround(F.avg("outcome"), 4).alias("rate"), F.count(F.lit(1)).alias("n"))
