import datetime as dt

from rollcall.functions import scalar as S
from rollcall.functions.scorecard import rule_scorecard, scorecard_contributions


def test_july_week(spark):
    df = spark.createDataFrame([(dt.date(2024, 7, 31),), (dt.date(2024, 8, 1),), (dt.date(2024, 1, 1),), (dt.date(2024, 12, 31),)], "d date")
    assert [r[0] for r in df.select(S.semester_week("d")).collect()] == [31, 1, 1, 22]


def test_cgpa_bands_null(spark):
    df = spark.createDataFrame([(None,), (5.9,), (6.0,), (8.0,)], "cgpa double")
    got = [(r[0], r[1]) for r in df.select(S.cgpa_band_high("cgpa"), S.cgpa_band_low("cgpa")).collect()]
    assert got == [(0, 0), (0, 1), (0, 0), (1, 0)]


def test_ordinals_unknown_is_null(spark):
    df = spark.createDataFrame([("Early",), ("Late",), ("Weird",)], "t string")
    assert [r[0] for r in df.select(S.timing_code("t")).collect()] == [3, 1, None]


def test_scorecard_range_and_contributions(spark):
    from tests.conftest import SF0001
    from rollcall.sources.fixtures import registrations_flat

    flat = registrations_flat(spark, SF0001)
    sc = rule_scorecard(flat)
    lo, hi = sc.agg({"score_pct": "min"}).first()[0], sc.agg({"score_pct": "max"}).first()[0]
    assert 3 <= lo <= hi <= 90
    # unclamped rows: base + contributions = score
    contrib = scorecard_contributions(flat).groupBy("student_id", "event_id").sum("points")
    j = sc.join(contrib, ["student_id", "event_id"], "left").fillna(0, subset=["sum(points)"])
    bad = j.filter("score_pct > 3 AND score_pct < 90 AND score_pct <> 18 + `sum(points)`").count()
    assert bad == 0


def test_bands(spark):
    df = spark.createDataFrame([(19, 0.69, 0.31, 0.76), (39, 0.4, 0.16, 0.5), (40, 0.39, 0.15, 0.49)], "a int, r double, p double, q double")
    got = [tuple(r) for r in df.select(S.advice_band("a"), S.rate_band("r"), S.confidence_band("p"), S.planning_band("q")).collect()]
    assert got == [("Low", "medium", "High", "large"), ("Moderate", "medium", "Medium", "medium"), ("High", "low", "Low", "small")]


def test_display_labels(spark):
    df = spark.createDataFrame([("logistic_regression", 1, "Wednesday")], "m string, e int, d string")
    r = df.select(S.model_display_name("m"), S.exam_label("e"), S.day_short("d")).first()
    assert tuple(r) == ("Logistic Regression", "Near", "Wed")
