import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from rollcall.operators.smote import knn_minority, smote_oversample, smote_plan


def test_knn_equals_brute_force(spark):
    rng = np.random.default_rng(0)
    X = rng.normal(size=(300, 4))
    df = spark.createDataFrame([(i, [float(v) for v in X[i]]) for i in range(300)], "id long, x array<double>")
    got = knn_minority(df, k=5, block_rows=64).collect()
    nn = {}
    for r in got:
        nn.setdefault(r["qid"], []).append((r["nn"], r["rid"]))
    d = ((X[:, None, :] - X[None, :, :]) ** 2).sum(-1)
    np.fill_diagonal(d, np.inf)
    for q in range(300):
        want = list(np.argsort(d[q], kind="stable")[:5])
        assert [rid for _, rid in sorted(nn[q])] == want


def test_smote_rows_lie_between_minority_rows(spark):
    rows = [(f"s{i}", "e", 1 if i % 9 < 2 else 0, [float(i % 7), float(i % 5)], i % 5) for i in range(90)]
    train = spark.createDataFrame(rows, "student_id string, event_id string, label int, x array<double>, fold int")
    plan = smote_plan(train).first()
    assert plan["active"] and plan["n_synthetic"] == int(min(0.45, 2 * 20 / 90) * 70 - 20) > 0
    out = smote_oversample(train, plan["n_synthetic"], block_rows=8)
    syn = out.filter("is_synthetic").collect()
    assert len(syn) == plan["n_synthetic"]
    mins = np.array([r[3] for r in rows if r[2] == 1])
    lo, hi = mins.min(0), mins.max(0)
    for r in syn:
        assert r["label"] == 1 and all(lo[i] - 1e-9 <= r["x"][i] <= hi[i] + 1e-9 for i in range(2))


def test_smote_unreachable_band(spark):
    rows = [(f"s{i}", "e", 1 if i < 33 else 0, [0.0], 0) for i in range(100)]  # r = 0.33
    plan = smote_plan(spark.createDataFrame(rows, "student_id string, event_id string, label int, x array<double>, fold int")).first()
    assert plan["active"] and not plan["reachable"] and plan["n_synthetic"] == 0


import pytest


@pytest.mark.parametrize("hot_rows", [None, 0])
def test_asof_planned_rows_do_not_see_each_other(spark, hot_rows):
    from rollcall.plans.predict import asof_student_state

    h = spark.createDataFrame(
        [("A", "E1", dt.date(2024, 9, 1), 1), ("A", "E2", dt.date(2024, 9, 2), 1), ("A", "E3", dt.date(2024, 9, 3), 0)],
        "student_id string, event_id string, event_date date, attended int",
    )
    c = spark.createDataFrame(
        [("A", "P1", dt.date(2024, 9, 2)), ("A", "P2", dt.date(2025, 1, 1)), ("A", "P3", dt.date(2025, 1, 1)), ("B", "P1", dt.date(2024, 9, 2))],
        "student_id string, event_id string, event_date date",
    )
    out = {(r["student_id"], r["event_id"]): r for r in asof_student_state(h, c, F.lit(0.25), hot_rows=hot_rows).collect()}
    p1 = out[("A", "P1")]  # sees E1 and E2 (history first on equal date)
    assert p1["student_total_events"] == 2 and p1["attendance_streak"] == 2 and p1["student_rolling_attendance"] == 1.0
    for k in ("P2", "P3"):
        r = out[("A", k)]
        assert r["student_total_events"] == 3 and r["attendance_streak"] == -1
        assert abs(r["student_recent_3_rate"] - 2 / 3) < 1e-12
    b = out[("B", "P1")]
    assert b["student_total_events"] == 0 and b["student_rolling_attendance"] == 0.25 and b["student_attendance_std"] == 0.5


def test_logistic_beats_constant_on_planted_signal(spark):
    from tests.conftest import SF0001
    from rollcall.plans.training import prepare_data, train_one
    from rollcall.sources.fixtures import registrations_flat

    prep = prepare_data(registrations_flat(spark, SF0001))
    r = train_one("logistic_regression", prep, cv=False)
    assert r.metrics["auc_roc"] > 0.6 and r.metrics["f1_score"] > 0.4
    assert len(prep.feature_cols) == 69


def test_placeholder_include_matches_appending_the_rows(spark):
    """'include' equals fitting the rates on history + that event's placeholder rows."""
    from rollcall.plans.features import fit_feature_state
    from rollcall.plans.predict import planned_event_features, required_fields

    d = dt.date(2024, 9, 2)
    hist = spark.createDataFrame(
        [
            ("A", "E1", "Early", "School of Design", 3, "High", 7.5, d, "Data Science", "Industry", "Monday", "Morning (9-11 AM)", 90, "Offline", 2, "High", 40, 1, 0.0, 0),
            ("B", "E1", "Late", "School of Music", 5, "Low", 6.5, d, "Data Science", "Industry", "Monday", "Morning (9-11 AM)", 90, "Offline", 2, "High", 40, 0, 0.0, 0),
            ("C", "E2", "On-time", "School of Design", 1, "Medium", None, d, "Sound Design", "Student", "Tuesday", "Evening (5-7 PM)", 60, "Online", 1, "Low", 20, 1, 0.0, 0),
        ],
        "student_id string, event_id string, registration_timing string, department string, semester int, club_activity_level string, "
        "cgpa double, event_date date, topic string, speaker_type string, day_of_week string, time_slot string, duration_minutes int, "
        "mode string, exam_proximity int, promotion_level string, num_registrations long, attended int, past_attendance_rate double, "
        "past_events_count long",
    )
    state = fit_feature_state(hist)
    planned = spark.createDataFrame(
        [("P1", "Data Science", "Industry", "Monday", "Morning (9-11 AM)", 90, "Offline", 3, "High", 2, dt.date(2025, 1, 6))],
        "event_id string, topic string, speaker_type string, day_of_week string, time_slot string, duration_minutes int, mode string, "
        "exam_proximity int, promotion_level string, num_registrations long, event_date date",
    )
    valid = required_fields(planned).drop("missing")
    out = {r["student_id"]: r for r in planned_event_features(hist, valid, state, placeholder="include").collect()}
    assert len(out) == 2
    # topic "Data Science": history 1 of 2 attended, plus 2 placeholder rows -> 1 / 4
    for r in out.values():
        assert abs(r["topic_popularity"] - 0.25) < 1e-12
        assert abs(r["registration_density"] - 2 / ((40 + 40 + 20 + 2 * 2) / 5)) < 1e-12
    # department rates see only the planned rows of their own department
    depts = {r["student_id"]: r["department"] for r in hist.select("student_id", "department").collect()}
    for sid, r in out.items():
        want = {"School of Design": (1 + 1) / (2 + sum(1 for x in out if depts[x] == "School of Design")),
                "School of Music": 0 / (1 + sum(1 for x in out if depts[x] == "School of Music"))}[depts[sid]]
        assert abs(r["dept_engagement"] - want) < 1e-12
