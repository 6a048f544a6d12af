import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rollcall.operators.quantile import exact_medians
from rollcall.operators.summaries import class_balance, distinct_options, filter_school_topic_dates


@pytest.mark.parametrize("accuracy, band_rows", [(10_000, 1_000_000), (20, 10)])
def test_medians_are_exact(spark, accuracy, band_rows):
    random.seed(1)
    rows = [(random.choice([None, random.gauss(0, 1e6)]), float(random.randint(0, 5)), None, 7.0 if i % 3 else 1e300) for i in range(2001)]
    got = exact_medians(spark.createDataFrame(rows, "a double, `b.c` double, d double, e double"), ["a", "b.c", "d", "e"], accuracy, band_rows)
    for i, c in enumerate(["a", "b.c", "d", "e"]):
        values = [r[i] for r in rows if r[i] is not None]
        assert got[c] == (float(np.median(values)) if values else None)


def test_no_day_present_gives_the_whole_week(spark):
    cols = ["topic", "speaker_type", "time_slot", "mode", "promotion_level", "day_of_week"]
    df = spark.createDataFrame([("t", None, "s", "m", "p", None)], ", ".join(f"{c} string" for c in cols))
    got = {}
    for r in distinct_options(df).collect():
        got.setdefault(r["option"], []).append((r["position"], r["value"]))
    assert len(got["days"]) == 7 and sorted(got["days"])[0][1] == "Monday" and got["topics"] == [(0, "t")]
    some = {r["value"] for r in distinct_options(df.withColumn("day_of_week", F.lit("Friday"))).filter("option = 'days'").collect()}
    assert some == {"Friday"}


def test_date_bounds_with_times(spark):
    df = spark.createDataFrame([("2025-01-01",), ("2025-01-02",), (None,)], "d string").select(F.to_date("d").alias("event_date"), F.lit("A").alias("topic"), F.lit("S").alias("department"))
    count = lambda **kw: filter_school_topic_dates(df, **kw).count()
    assert count() == 3 and count(date_from="nonsense") == 3
    assert count(date_from="2025-01-01") == 2 and count(date_from="2025-01-01 10:00") == 1
    assert count(date_to="Jan 1, 2025") == 1 and count(date_to="2025-01-01T23:59") == 1 and count(topic="B") == 0


def test_one_class_has_null_ratios(spark):
    r = class_balance(spark.createDataFrame([(1,), (1,)], "attended int")).first()
    assert (r["n_pos"], r["n_neg"], r["weight_neg"], r["pos_rate"]) == (2, 0, None, 1.0)
    assert class_balance(spark.createDataFrame([], "attended int")).first()["pos_rate"] is None
