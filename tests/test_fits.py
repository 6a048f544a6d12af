import pytest
from pyspark.sql import functions as F

from rollcall.plans import training as T


@pytest.fixture
def train(spark):
    key = F.concat(F.lit("s"), F.col("id").cast("string")).alias("student_id")
    return spark.range(200).select(
        key, F.lit("e").alias("event_id"), (F.col("id") % 3 == 0).cast("int").alias("label"), F.array(F.rand(1), F.rand(2)).alias("x"), (F.col("id") % 5).cast("int").alias("fold")
    )


@pytest.mark.parametrize("name", ["xgboost", "random_forest", "logistic_regression"])
def test_input_is_not_cached_beside_the_estimators_own_copy(spark, train, name, monkeypatch):
    """The estimators cache blocks or binned rows; a second copy went to disk."""
    seen, real = [], T.estimator_for

    class Watched:
        def __init__(self, weighted):
            self.weighted = weighted

        def fit(self, df):
            seen.append(df.storageLevel.useMemory or df.storageLevel.useDisk)
            return real("logistic_regression", self.weighted).fit(df)

    monkeypatch.setattr(T, "estimator_for", lambda n, weighted: Watched(weighted))
    prep = T.Prepared(train, train, ["a", "b"], None, {"n": 200, "n_synthetic": 0})
    T.fit_one(name, prep)
    T.fold_f1(name, train, 0)
    assert seen == [False, False]


def test_large_input_is_dealt_in_whole_waves(spark, train, monkeypatch):
    cores = spark.sparkContext.defaultParallelism
    monkeypatch.setattr(T, "LEAST_PARTITION_BYTES", 1)
    monkeypatch.setattr(T, "TARGET_PARTITION_BYTES", 1600)  # a row of two features has 16 bytes
    assert T.fit_partitions(train, 100 * (cores + 1), 2).rdd.getNumPartitions() == 2 * cores
    assert T.fit_partitions(train, 100 * cores, 2).rdd.getNumPartitions() == cores
    # beyond that the input is not shuffled for every reading of an estimator
    far = T.fit_partitions(train, 100 * 50 * cores, 2)
    assert "Exchange" not in far._jdf.queryExecution().executedPlan().toString()
    assert far.count() == 200


def test_fits_side_by_side_fit_into_memory(spark, train, monkeypatch):
    assert T.fits_at_once(spark, "random_forest", 1000, 69) == T.PARALLEL_FITS
    monkeypatch.setattr(T, "CACHE_BYTES_PER_CORE", 4_000_000 // spark.sparkContext.defaultParallelism)
    at_once = {n: T.fits_at_once(spark, n, 2500, 69) for n in T.CACHED_ROW_BYTES}
    assert at_once == {"xgboost": 4, "random_forest": 1, "logistic_regression": 2}
    assert T.fits_at_once(spark, "random_forest", 10**12, 69) == 1 and T.fits_at_once(spark, "xgboost", 0, 69) == T.PARALLEL_FITS

    asked = []
    monkeypatch.setattr(T, "side_by_side", lambda spark, tasks, parallel=6: asked.append((len(tasks), parallel)) or [0.0] * len(tasks))
    monkeypatch.setattr(T, "fits_at_once", lambda spark, name, rows, width, parallel=6: (name, rows, width))
    T.cv_f1("random_forest", train)
    assert asked == [(5, ("random_forest", 200, 2))]


def test_boosting_stores_no_node_ids():
    """One tree is grown at a time; ids of nodes were stored again for every level."""
    assert not T.gbt_estimator().getStages()[0].getCacheNodeIds()


def test_whole_matrix_is_stored_before_the_fits_only(spark, monkeypatch):
    from tests.conftest import SF0001
    from rollcall.sources.fixtures import registrations_flat

    stored, cut = [], T.cut_lineage
    monkeypatch.setattr(T, "cut_lineage", lambda df: stored.append(df.columns) or cut(df))
    prep = T.prepare_data(registrations_flat(spark, SF0001))
    assert len(prep.feature_cols) == 69 and stored
    assert not any("x" in c or any(n.startswith("topic_") and n != "topic_popularity" for n in c) for c in stored)
    assert prep.train.count() == prep.train_rows and prep.train.filter("size(x) != 69").isEmpty()
