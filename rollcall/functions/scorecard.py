"""Transparent additive rule scorecard.

The score is a sum of rule contributions in integer hundredths, clamped to
[3, 90]; ``score_probability`` divides by 100 once at the end, so the value is
exact and identical on every engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall import constants as K


def _rules(df_columns: list[str]) -> list[tuple[str, Column]]:
    """(rule name, contribution in hundredths as INT) for every rule."""
    c = F.col
    club, timing = c("club_activity_level"), c("registration_timing")
    sem, speaker, topic = c("semester"), c("speaker_type"), c("topic")
    slot, exam, mode, promo = c("time_slot"), c("exam_proximity"), c("mode"), c("promotion_level")
    day, dur, regs, dept = c("day_of_week"), c("duration_minutes"), c("num_registrations"), c("department")
    # missing cgpa column -> 7.0; a null cgpa matches no band (comparisons are false)
    cgpa = c("cgpa") if "cgpa" in df_columns else F.lit(K.CGPA_DEFAULT_WHEN_ABSENT)

    def w(expr: Column) -> Column:
        return F.coalesce(expr, F.lit(0)).cast("int")

    school_match = None
    for school, topics in K.SCHOOL_TOPICS.items():
        one = (dept == school) & topic.isin(*topics)
        school_match = one if school_match is None else (school_match | one)

    return [
        ("club", w(F.when(club == "High", 20).when(club == "Medium", 6).otherwise(-8))),
        ("timing", w(F.when(timing == "Early", 14).when(timing == "Late", -8).otherwise(0))),
        ("cgpa", w(F.when(cgpa >= 8.5, 10).when(cgpa >= 7.0, 4).when(cgpa < 5.5, -6).otherwise(0))),
        ("semester", w(F.when(sem.isin(4, 5, 6), 6).when(sem <= 2, -4).when(sem >= 7, 2).otherwise(0))),
        ("speaker", w(F.when(speaker == "Industry", 16).when(speaker == "Alumni", 8).when(speaker == "Student", -6).otherwise(0))),
        (
            "topic_tier",
            w(
                F.when(topic.isin(*K.HOT_TOPICS), 14)
                .when(topic.isin(*K.WARM_TOPICS), 7)
                .when(topic.isin(*K.MILD_TOPICS), 2)
                .when(topic.isin(*K.COLD_TOPICS), -8)
                .otherwise(0)
            ),
        ),
        ("time_slot", w(F.when(slot == "Afternoon (2-4 PM)", 8).when(slot == "Evening (5-7 PM)", 3).otherwise(-6))),
        ("exam", w(F.when(exam == 1, -18).when(exam == 2, -4).when(exam == 3, 8).otherwise(0))),
        ("mode", w(F.when(mode == "Offline", 5).otherwise(-4))),
        ("promotion", w(F.when(promo == "High", 10).when(promo == "Low", -8).otherwise(0))),
        (
            "day",
            w(F.when(day.isin(*K.MIDWEEK_DAYS), 5).when(day.isin(*K.WEEKEND_DAYS), -10).when(day == "Monday", -4).otherwise(0)),
        ),
        ("duration", w(F.when(dur > 150, -8).when(dur > 120, -3).when(dur <= 60, 5).when(dur <= 90, 3).otherwise(0))),
        ("registrations", w(F.when(regs > 90, 7).when(regs > 60, 3).when(regs < 25, -5).otherwise(0))),
        ("school_topic", w(F.when(school_match, 10).otherwise(0))),
        ("cross_school", w(F.when(topic.isin(*K.CROSS_SCHOOL_TOPICS), 5).otherwise(0))),
        (
            "creative_coding",
            w(F.when(dept.isin("School of Design", "School of Music") & (topic == "Creative Coding"), 6).otherwise(0)),
        ),
        ("club_x_early", w(F.when((club == "High") & (timing == "Early"), 8).otherwise(0))),
        ("low_late_near", w(F.when((club == "Low") & (timing == "Late") & (exam == 1), -10).otherwise(0))),
        ("industry_hot", w(F.when((speaker == "Industry") & topic.isin(*K.HOT_TOPICS), 8).otherwise(0))),
        (
            "promo_offline_afternoon",
            w(F.when((promo == "High") & (mode == "Offline") & (slot == "Afternoon (2-4 PM)"), 6).otherwise(0)),
        ),
    ]


def score_pct(df_columns: list[str]) -> Column:
    """C1 in integer hundredths, clamped to [SCORE_MIN, SCORE_MAX]."""
    total = F.lit(K.SCORE_BASE)
    for _, contribution in _rules(df_columns):
        total = total + contribution
    return F.least(F.lit(K.SCORE_MAX), F.greatest(F.lit(K.SCORE_MIN), total)).cast("int")


def score_probability(df_columns: list[str]) -> Column:
    return score_pct(df_columns) / F.lit(100.0)


def rule_scorecard(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """One row per input row with ``score_pct`` and ``score``."""
    keep = keep if keep is not None else ["student_id", "event_id"]
    return df.select(*keep, score_pct(df.columns).alias("score_pct"), score_probability(df.columns).alias("score"))


def scorecard_contributions(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """One row per (input row, rule that fired) with its contribution."""
    keep = keep if keep is not None else ["student_id", "event_id"]
    rules = F.array(*[F.struct(F.lit(name).alias("rule"), expr.alias("points")) for name, expr in _rules(df.columns)])
    fired = F.filter(rules, lambda r: r["points"] != 0)
    return (
        df.select(*keep, F.explode(fired).alias("r"))
        .select(*keep, F.col("r.rule").alias("rule"), F.col("r.points").alias("points"))
    )
