"""What is stored and shuffled between the steps of the star queries."""

import os

from pyspark.sql import functions as F

from rollcall.operators import sampling as SP
from rollcall.session import cut_lineage, ensure_checkpoint_dir

SMALL = "/root/testdata/sf0.001"


def _size(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(folder.removeprefix("file:")) for f in files)


def test_cut_is_columnar_and_takes_a_fraction_of_the_rows(spark):
    wide = spark.range(20_000).select("id", *[(F.col("id") % i).cast("double").alias(f"a, {i}") for i in range(1, 60)])
    before = _size(ensure_checkpoint_dir(spark))
    cut = cut_lineage(wide)
    assert "Range" not in cut._jdf.queryExecution().toString() and cut.columns == wide.columns
    assert _size(ensure_checkpoint_dir(spark)) - before < 20_000 * 60 * 8 / 4
    assert cut.agg(F.sum("`a, 7`")).first()[0] == wide.agg(F.sum("`a, 7`")).first()[0]


def test_cut_of_no_rows(spark):
    assert cut_lineage(spark.range(0)).count() == 0


def test_hash_is_not_shuffled(spark):
    df = spark.range(1000).select(F.col("id").cast("string").alias("k"), (F.col("id") % 3).alias("g"))
    ranked = SP.hash_rank(df, ["k"], ["g"])
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    window = plan[plan.index("Window"):]
    between = window[: window.index("Exchange")]
    assert "md5" in between  # found again behind the exchange
    want = {}
    for k, g, h in sorted(map(tuple, df.select("k", "g", SP.seeded_hash(["k"])).collect()), key=lambda r: (r[1], r[2])):
        want[k] = len([1 for x in want if int(x) % 3 == g])
    assert {r["k"]: r["_rank"] for r in ranked.collect()} == want


def test_the_window_of_the_flat_table_reads_keys_and_codes_only(spark):
    from rollcall.sources import fixtures

    rows, columns = fixtures._labelled_rows(spark, SMALL, None)
    assert set(rows.columns) == {"qty", "pr", "p_partkey", "p_type", "p_size", "num_registrations", "c_custkey", "c_nationkey",
                                 "c_acctbal", "c_mktsegment", "event_id", "event_date", "attended"} - {"qty"}
    assert "department" in rows.select(*columns).columns


def test_facts_are_joined_once(spark):
    from rollcall import catalog

    plan = catalog.flat(spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan and "rollcall_cut" in catalog.flat(spark, SMALL).inputFiles()[0]


def test_rows_without_an_outcome_stay_in_the_history(spark):
    from rollcall.plans.training import prepare_data

    from rollcall.sources.fixtures import registrations_flat

    flat = registrations_flat(spark, SMALL)
    some = flat.withColumn("attended", F.when(F.crc32("event_id") % 5 > 0, F.col("attended")))
    prep = prepare_data(some, oversample=False)
    assert prep.n_rows == some.filter("attended is not null").count()
    seen = prep.train.select("student_id", "event_id", F.col("x")[prep.feature_cols.index("student_total_events")].alias("n"))
    from rollcall.operators.history import history_features

    want = history_features(some).select("student_id", "event_id", F.col("student_total_events").cast("double").alias("want"))
    assert seen.join(want, ["student_id", "event_id"]).filter("n != want").count() == 0


def test_forest_caches_no_node_ids():
    from rollcall.plans.training import rf_estimator

    assert not rf_estimator().getStages()[0].getCacheNodeIds()


def test_facts_are_joined_once_for_registrations_and_planned_events(spark, monkeypatch):
    from rollcall import catalog
    from rollcall.sources import fixtures

    joined, join = [], fixtures.registration_grain
    monkeypatch.setattr(fixtures, "registration_grain", lambda *a: joined.append(a) or join(*a))
    stored, store = [], catalog.stored_flat
    monkeypatch.setattr(catalog, "stored_flat", lambda *a: stored.append(store(*a)) or stored[-1])
    state = catalog.q_asof(spark, SMALL)
    assert len(joined) == 1 and "past_attendance_rate" not in stored[0].columns
    want = catalog.q_candidates(spark, SMALL).select("student_id", "event_id")
    assert len(joined) == 2 and state.count() == want.count() > 0
    assert state.select("student_id", "event_id").exceptAll(want).count() == 0
