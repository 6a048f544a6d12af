import datetime as dt

import pytest
from pyspark.sql import functions as F

from rollcall.operators.history import HISTORY_COLUMNS, history_features, recalculate_history


def _hist(spark, rows_):
    return spark.createDataFrame(rows_, "student_id string, event_id string, event_date date, attended int")


def _streak6(spark):
    base = dt.date(2024, 9, 1)
    outs = [1, 1, 0, 0, 1, 0]
    return _hist(spark, [("S1", f"E{i}", base + dt.timedelta(days=i), y) for i, y in enumerate(outs)])


@pytest.mark.parametrize("hot_rows", [None, 0])
def test_streak_6(spark, hot_rows):
    df = _streak6(spark)
    out = history_features(df, hot_rows=hot_rows).orderBy("event_date").collect()
    assert [r["attendance_streak"] for r in out] == [0, 1, 2, -1, -2, 1]
    assert [round(r["student_rolling_attendance"], 3) for r in out] == [0.5, 1.0, 1.0, 0.667, 0.5, 0.6]
    assert [round(r["student_attendance_std"], 3) for r in out] == [0.5, 0.5, 0.0, 0.577, 0.577, 0.548]
    assert [r["student_total_events"] for r in out] == [0, 1, 2, 3, 4, 5]
    assert [r["student_cumulative_attended"] for r in out] == [0, 1, 2, 2, 2, 3]
    assert [round(r["student_recent_3_rate"], 3) for r in out] == [0.5, 1.0, 1.0, 0.667, 0.333, 0.333]


def test_first_event_fills(spark):
    df = _hist(spark, [("A", "E1", dt.date(2024, 9, 1), 1), ("B", "E2", dt.date(2024, 9, 2), 0)])
    out = {r["student_id"]: r for r in history_features(df).collect()}
    for r in out.values():
        assert r["student_rolling_attendance"] == 0.5
        assert r["student_cumulative_attended"] == 0
        assert r["student_attendance_std"] == 0.5
        assert r["attendance_streak"] == 0


def test_date_tie_breaks_on_event_id(spark):
    d = dt.date(2024, 9, 1)
    df = _hist(spark, [("A", "E2", d, 0), ("A", "E1", d, 1)])
    out = {r["event_id"]: r for r in history_features(df).collect()}
    assert out["E1"]["student_total_events"] == 0
    assert out["E2"]["student_total_events"] == 1 and out["E2"]["attendance_streak"] == 1


def _same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


@pytest.mark.parametrize("hot_rows", [0, 45])
def test_segmented_route_equals_plain_written_out(spark, tmp_path, hot_rows):
    """All columns of the registration table, written out on both routes."""
    from rollcall.sources.fixtures import registrations_flat
    from tests.conftest import SF0001

    flat = registrations_flat(spark, SF0001)
    for name, rows in (("plain", None), ("hot", hot_rows)):
        history_features(flat, hot_rows=rows).write.parquet(str(tmp_path / name))
    a, b = spark.read.parquet(str(tmp_path / "plain")), spark.read.parquet(str(tmp_path / "hot"))
    assert a.columns == b.columns and len(a.columns) >= 20
    assert a.count() == b.count() == flat.count() and _same(a, b)


def test_routes_agree_with_nulls_and_many_rows_a_day(spark):
    import random

    random.seed(4)
    rows = [(f"S{random.randint(0, 3)}", f"E{i:04d}", dt.date(2024, 9, 1) + dt.timedelta(days=random.randint(0, 25)), random.choice([0, 1, 1, None])) for i in range(900)]
    df = _hist(spark, rows)
    kw = {"overall": F.lit(0.5), "prior_outcomes": True}
    a, b = history_features(df, **kw), history_features(df, hot_rows=0, **kw)
    assert a.count() == len(rows) and _same(a, b)


@pytest.mark.parametrize("hot_rows", [None, 0])
def test_null_outcome_gives_zero_and_does_not_end_the_run(spark, hot_rows):
    base = dt.date(2024, 9, 1)
    df = _hist(spark, [("S", f"E{i}", base + dt.timedelta(days=i), y) for i, y in enumerate([1, 1, None, 1, 0])])
    out = history_features(df, hot_rows=hot_rows).orderBy("event_date").collect()
    assert [r["attendance_streak"] for r in out] == [0, 1, 2, 0, 3]
    assert out[4]["student_rolling_attendance"] == 1.0


def test_no_job_while_the_plan_is_built(spark):
    df = _streak6(spark)
    seen = len(spark.sparkContext.statusTracker().getJobIdsForGroup())
    history_features(df, hot_rows=3)
    recalculate_history(df)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup()) == seen


def test_long_keys_stay_whole(spark, tmp_path):
    from rollcall.sources import fixtures

    df = spark.createDataFrame([(1,), (1000000,), (1000001,), (100000,)], "k long").select(fixtures._key("STU_", "k").alias("id"))
    assert sorted(r["id"] for r in df.collect()) == ["STU_000001", "STU_100000", "STU_1000000", "STU_1000001"]


def test_later_rows_do_not_change_earlier_features(spark):
    df = _streak6(spark)
    changed = df.withColumn("attended", F.when(F.col("event_id") == "E5", 1 - F.col("attended")).otherwise(F.col("attended")))
    # the global fill value is the whole-table mean by definition; fix it to test the windows
    a = history_features(df, overall=F.lit(0.5)).filter("event_id <> 'E5'").drop("attended")
    b = history_features(changed, overall=F.lit(0.5)).filter("event_id <> 'E5'").drop("attended")
    assert a.exceptAll(b).count() == 0


def test_partition_count_independent(spark):
    df = _streak6(spark)
    a = history_features(df.repartition(1))
    b = history_features(df.repartition(5))
    assert a.exceptAll(b).count() == 0


def test_recalculate_history(spark):
    out = recalculate_history(_streak6(spark)).orderBy("event_date").collect()
    assert [r["past_events_count"] for r in out] == [0, 1, 2, 3, 4, 5]
    assert [r["past_attendance_rate"] for r in out] == [0.0, 1.0, 1.0, 0.667, 0.5, 0.6]


def test_history_plan_has_one_exchange_and_sort(spark):
    df = _streak6(spark)
    plan = history_features(df, hot_rows=None, overall=F.lit(0.5))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert "BatchEvalPython" not in plan


@pytest.mark.parametrize("span", ["day", "hour", "minute"])
def test_segments_of_any_span_equal_the_plain_route(spark, span):
    # one user with all rows on two days, runs and nulls across hours and minutes
    df = spark.range(4000).select(
        (F.col("id") % 7 == 0).cast("int").alias("u"), F.timestamp_seconds(1_700_000_000 + F.col("id") * 37).alias("ts"), "id",
        F.when(F.hash("id") % 11 != 0, (F.hash(F.col("id") / 5) % 3 == 0).cast("int")).alias("y"))
    kw = {"entity": "u", "order": ("ts", "id"), "outcome": "y", "prior_outcomes": True}
    key = lambda out: sorted(tuple(r) for r in out.withColumns({c: F.round(c, 9) for c in ("student_rolling_attendance", "student_attendance_std", "student_recent_3_rate")})
                             .withColumn("prior_outcomes", F.size(F.filter("prior_outcomes", lambda v: v.isNotNull()))).drop("y", "ts").collect())
    assert key(history_features(df, **kw)) == key(history_features(df, hot_rows=0, span=span, **kw))


def test_when_all_entities_are_hot_nothing_is_looked_up(spark):
    """Rows are dealt by segment only; rows without an entity are those of the plain route."""
    day = dt.date(2024, 9, 1)
    rows = [(s, f"E{i:02d}", day + dt.timedelta(days=i // 2), y) for s in ("A", "B", None) for i, y in enumerate([1, 0, 0, None, 1, 1, 0])]
    df = _hist(spark, rows)
    out = history_features(df, hot_rows=0, overall=F.lit(0.5))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" not in plan and "LeftSemi" not in plan and plan.count("Join") == 1
    assert out.count() == len(rows) and _same(out, history_features(df, overall=F.lit(0.5)))


def test_rows_are_shuffled_once_for_both_routes(spark, tmp_path):
    """The parts of hot and of other students differed by a filter, so all rows were shuffled for each."""
    rows = spark.range(3000).select(
        F.when(F.col("id") % 50 > 0, F.concat(F.lit("S"), (F.col("id") % 7 * (F.col("id") % 3)).cast("string"))).alias("student_id"),
        F.concat(F.lit("E"), F.col("id").cast("string")).alias("event_id"), F.expr("date_add(DATE'2024-01-01', int(id % 40))").alias("event_date"),
        (F.col("id") % 5 < 2).cast("int").alias("attended"))
    rows.write.parquet(str(tmp_path / "rows"))
    df = spark.read.parquet(str(tmp_path / "rows"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        split = history_features(df, overall=F.lit(0.4), hot_rows=300)
        got = sorted(map(tuple, split.collect()), key=repr)
        final = split._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == sorted(map(tuple, history_features(df, overall=F.lit(0.4)).collect()), key=repr) and len(got) == 3000
    # the exchange of the whole rows is used by both routes, the second of them in two places
    assert sum("ReusedExchange" in x and "attended" in x for x in final.splitlines()) == 2, final
