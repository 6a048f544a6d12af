"""Plan-shape assertions on the fixture tables."""

import re

from tests.conftest import SF0001


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_breakdowns_single_scan_no_python(spark):
    from rollcall.operators.summaries import all_breakdowns

    stored = spark.read.parquet(_stored(spark))
    plan = _plan(all_breakdowns(stored))
    assert "Expand" in plan  # grouping sets: one scan feeds every dimension
    assert plan.count("FileScan") == 1
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_feature_pipeline_has_one_window_exchange(spark):
    from pyspark.sql import functions as F

    from rollcall.operators.history import history_features

    stored = spark.read.parquet(_stored(spark))
    plan = _plan(history_features(stored, hot_rows=None, overall=F.lit(0.5)))
    assert len(re.findall(r"Exchange hashpartitioning\(student_id", plan)) == 1
    assert "BatchEvalPython" not in plan


def test_threshold_sweep_is_codegen_only(spark):
    from pyspark.sql import functions as F

    from rollcall.operators.metrics import threshold_sweep

    stored = spark.read.parquet(_stored(spark))
    plan = _plan(threshold_sweep(stored.select(F.col("attended").alias("label"), (F.col("semester") / 10.0).alias("p"))))
    assert "BatchEvalPython" not in plan and "LambdaFunction" not in plan


_PATH = {}


def _stored(spark):
    if "p" not in _PATH:
        import tempfile

        from rollcall.sources.fixtures import registrations_flat

        p = tempfile.mkdtemp(prefix="rollcall-plan-") + "/flat"
        registrations_flat(spark, SF0001).write.parquet(p)
        _PATH["p"] = p
    return _PATH["p"]


def test_long_generated_loops_are_not_interpreted(spark):
    """HotSpot compiles no method of more than 8000 bytes; wide projections were interpreted."""
    from rollcall.session import tune

    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "65535")
    assert tune(spark).conf.get("spark.sql.codegen.hugeMethodLimit") == "8000"
