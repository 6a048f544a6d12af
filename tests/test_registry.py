import datetime as dt
from concurrent.futures import ThreadPoolExecutor

from rollcall.plans.registry import Registry, active_model, log_model_version, resolve_winner, retrain_decision


def _new(spark, f1):
    return spark.createDataFrame([("xgboost", f1)], "model_name string, f1_score double")


def _cur(spark, f1):
    return spark.createDataFrame([("logistic_regression", f1)], "model_name string, f1_score double")


def test_registry_gate(spark):
    keep = retrain_decision(_cur(spark, 0.7337), _new(spark, 0.7401)).first()
    edge = retrain_decision(_cur(spark, 0.7337), _new(spark, 0.7437)).first()
    forced = retrain_decision(_cur(spark, 0.7337), _new(spark, 0.70), force=True).first()
    fresh = retrain_decision(None, _new(spark, 0.1)).first()
    assert (keep["deploy"], edge["deploy"], forced["deploy"], fresh["deploy"]) == (False, True, True, True)


def test_log_version_and_active(spark):
    schema = "model_name string, trained_on timestamp, num_training_rows long, f1_score double, auc_roc double, accuracy double, model_path string, is_active boolean"
    v1 = log_model_version(None, spark.createDataFrame([("rf", dt.datetime(2024, 1, 1), 10, 0.5, 0.6, 0.7, "p1", True)], schema))
    v2 = log_model_version(v1, spark.createDataFrame([("lr", dt.datetime(2024, 2, 1), 10, 0.6, 0.6, 0.7, "p2", True)], schema))
    assert v2.filter("is_active").count() == 1
    assert active_model(v2).first()["model_name"] == "lr"


def test_resolve_winner_fallbacks(spark):
    comp = spark.createDataFrame([("random_forest", True), ("xgboost", False)], "model_name string, is_winner boolean")
    meta = spark.createDataFrame(
        [("xgboost", "1", (0.0, 0.9, 0.0, 0.5)), ("logistic_regression", "1", (0.0, 0.2, 0.0, 0.5))],
        "model_name string, timestamp string, metrics struct<accuracy:double,f1_score:double,auc_roc:double,threshold:double>",
    )
    assert resolve_winner(comp, meta).first()["model_name"] == "random_forest"
    assert resolve_winner(None, meta).first()["model_name"] == "xgboost"


METRICS = {"f1_score": 0.5, "auc_roc": 0.6, "accuracy": 0.7}


def _registry(spark, tmp_path):
    return Registry(spark, str(tmp_path / "registry"))


def test_empty_registry(spark, tmp_path):
    reg = _registry(spark, tmp_path)
    assert reg.versions() is None and reg.meta() is None and reg.comparison() is None and reg.retrain_log() is None


def test_second_writer_takes_the_next_generation(spark, tmp_path):
    """Another writer commits after this one has read, each way round a rename can lose."""
    for late in ("_stage", "_place"):
        mine, other = _registry(spark, tmp_path / late), _registry(spark, tmp_path / late)
        mine.log_version("old", 1, METRICS, "p0")
        plain, calls = getattr(mine, late), []

        def interrupted(*args, plain=plain, calls=calls, other=other):
            if not calls:
                calls.append(1)
                other.log_version("theirs", 2, METRICS, "p1")
            return plain(*args)

        setattr(mine, late, interrupted)
        mine.log_version("mine", 3, METRICS, "p2")
        rows = mine.versions().collect()
        assert sorted(r["model_name"] for r in rows) == ["mine", "old", "theirs"]
        assert [r["model_name"] for r in rows if r["is_active"]] == ["mine"]
        assert sorted(mine._names(f"{mine.root}/model_versions")) == ["gen=1", "gen=2", "gen=3"]


def test_rename_onto_a_folder_that_came_in_between(spark, tmp_path):
    """The target appears after it was looked for: the rename moves below it and is undone."""
    reg = _registry(spark, tmp_path)
    one, two = (spark.createDataFrame([(x,)], "x string") for x in ("first", "second"))
    first, second = reg._stage(one, "t"), reg._stage(two, "t")
    assert reg._place("t", first, "gen=1")
    plain = reg._file_system

    class Blind:
        """A file system that does not see the target yet."""

        def __init__(self, fs):
            self.fs = fs

        def exists(self, path):
            return False if str(path.getName()) == "gen=1" else self.fs.exists(path)

        def __getattr__(self, name):
            return getattr(self.fs, name)

    reg._file_system = lambda path: (lambda fs, p: (Blind(fs), p))(*plain(path))
    assert not reg._place("t", second, "gen=1")
    assert [r["x"] for r in reg._generation("t", 1).collect()] == ["first"]
    assert reg._names(f"{reg.root}/t") == ["gen=1"] and not any(n.startswith("_staged") for n in reg._names(f"{reg.root}/t/gen=1"))


def test_many_writers_lose_nothing(spark, tmp_path):
    root = tmp_path
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda i: _registry(spark, root).log_version(f"m{i}", i, METRICS, f"p{i}"), range(8)))
        list(pool.map(lambda i: _registry(spark, root).log_retrain(f"m{i}", 0.5, 0.6, False, i), range(8)))
    reg = _registry(spark, root)
    assert sorted(r["model_name"] for r in reg.versions().collect()) == [f"m{i}" for i in range(8)]
    assert reg.versions().filter("is_active").count() == 1
    assert sorted(r["rows"] for r in reg.retrain_log().collect()) == list(range(8))


def test_readers_keep_the_generation_they_opened(spark, tmp_path):
    reg = _registry(spark, tmp_path)
    table = lambda x: spark.createDataFrame([(x, True)], "model_name string, is_winner boolean")
    reg.save_comparison(table("a"))
    opened = reg.comparison()
    reg.save_comparison(table("b"))
    assert opened.first()["model_name"] == "a" and reg.comparison().first()["model_name"] == "b"
