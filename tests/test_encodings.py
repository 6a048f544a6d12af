from conftest import SF0001
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from rollcall import constants as K
from rollcall.catalog import flat as build
from rollcall.plans import encodings as E
from rollcall.plans.features import run_feature_pipeline


def test_fifty_thousand_topics(spark):
    n = 50_000
    # a third of the rows have one topic, every other topic two rows
    rows = spark.range(3 * n).select(
        F.when(F.col("id") < n, F.lit("t0")).otherwise(F.concat(F.lit("t"), (F.col("id") % n).cast("string"))).alias("topic"),
        F.when(F.col("id") % 2 == 0, F.lit("x")).alias("mode"), (F.col("id") % 3 == 0).cast("int").alias("attended"), "id")
    table = E.encoding_table(rows, ["topic", "mode"])
    want = {c: r for r, c in enumerate(sorted(f"t{i}" for i in range(n)))}
    got = {r["value"]: r for r in table.filter("column = 'topic'").collect()}
    assert {v: r["place"] for v, r in got.items()} == want and got["t7"]["y_n"] == 2 and got["t0"]["y_n"] == n + 2
    assert [(r["value"], r["place"]) for r in table.filter("column = 'mode'").collect()] == [("x", 0)]
    both = []
    for limit in (E.BROADCAST_BYTES, 0):
        joined = E.join_encodings(rows, table, {"topic": "topic_rate", "mode": "mode_rate"}, limit)
        out = E.one_hot_vector(joined, table, ["topic", "mode"])
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert ("BroadcastHashJoin" in plan) == (limit > 0) and "CartesianProduct" not in plan
        some = out.filter("id % 9973 = 5 or id < 2").orderBy("id").select("id", "topic", "topic_rate", "mode_rate", "one_hot").collect()
        assert out.count() == 3 * n
        for r in some:
            place = want[r["topic"]]
            assert r["one_hot"].size == n - 1 and list(r["one_hot"].indices) == ([place - 1] if place else [])
            assert abs(r["topic_rate"] - got[r["topic"]]["y_sum"] / got[r["topic"]]["y_n"]) < 1e-12
        both.append([tuple(r[:4]) for r in some])
    assert both[0] == both[1]


def test_nulls_unknown_categories_and_empty_table(spark):
    rows = spark.createDataFrame([("a", 1), ("b", None), (None, 1), ("c", 0)], "topic string, attended int")
    table = E.encoding_table(rows, ["topic"])
    assert [(r["value"], r["y_n"], r["rate"], r["place"]) for r in table.orderBy("place").collect()] == [("a", 1, 1.0, 0), ("b", 0, None, 1), ("c", 1, 0.0, 2)]
    new = spark.createDataFrame([("a",), ("c",), ("z",), (None,)], "topic string")
    out = E.one_hot_vector(E.join_encodings(new, table, {"topic": "rate"}), table, ["topic"]).collect()
    assert sorted((r["topic"] or "", r["rate"], r["one_hot"].toArray().tolist()) for r in out if r["topic"] in ("a", "c")) == [("a", 1.0, [0, 0]), ("c", 0.0, [0, 1])]
    assert all(r["rate"] is None and r["one_hot"].toArray().tolist() == [0, 0] for r in out if r["topic"] in ("z", None))
    assert E.encoding_table(rows.limit(0), ["topic"]).collect() == []


def test_vector_equals_single_columns(spark):
    flat = build(spark, SF0001)
    single, cols, state = run_feature_pipeline(flat)
    wide, _ = E.wide_features(flat)
    hot = [f"{c}_{v}" for c in K.NOMINAL_COLUMNS for v in sorted(state.categories[c])[1:]]
    a = single.select("student_id", "event_id", *[F.col(f"`{c}`").cast("double").alias(f"f{i}") for i, c in enumerate(x for x in cols if x not in hot)], F.array(*[F.col(f"`{h}`").cast("double") for h in hot]).alias("v"))
    b = wide.select("student_id", "event_id", *[F.col(f"`{c}`").cast("double").alias(f"f{i}") for i, c in enumerate(x for x in cols if x not in hot)], vector_to_array("one_hot").alias("v"))
    left = {(r[0], r[1]): r for r in a.collect()}
    right = {(r[0], r[1]): r for r in b.collect()}
    assert left.keys() == right.keys() and len(left) > 100
    for k, r in left.items():
        assert r["v"] == right[k]["v"]
        assert all((x is None and y is None) or abs(x - y) < 1e-9 for x, y in zip(r[2:-1], right[k][2:-1]))
