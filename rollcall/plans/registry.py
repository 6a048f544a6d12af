"""Model registry and gated retraining.

The registry is a folder of tables: ``model_versions`` (a generation for each model
that is made active), ``meta`` (one row per saved model: features, metrics, threshold,
fitted feature state as JSON), ``comparison`` (per training run),
``feature_importance`` and ``retrain_log``.
Models are Spark ML ``PipelineModel`` folders. Every decision is a DataFrame
expression over those tables; the functions also accept in-memory DataFrames.
"""

from __future__ import annotations

import datetime as _dt
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rollcall import constants as K
from rollcall.functions.scalar import model_display_name
from rollcall.sources.tables import RETRAIN_LOG_SCHEMA

VERSIONS_SCHEMA = (
    "model_name string, trained_on timestamp, num_training_rows long, f1_score double, auc_roc double, "
    "accuracy double, model_path string, is_active boolean"
)
META_SCHEMA = (
    "model_name string, timestamp string, feature_columns array<string>, "
    "metrics struct<accuracy:double,f1_score:double,auc_roc:double,threshold:double>, threshold double, "
    "model_path string, feature_state string"
)


# ---- R1 / R2 ----------------------------------------------------------------------------
def log_model_version(versions: DataFrame | None, new_row: DataFrame) -> DataFrame:
    """Every existing row inactive, the new row active (returns the next generation)."""
    new = new_row.withColumn("is_active", F.lit(True)).select(*[c.split()[0] for c in VERSIONS_SCHEMA.split(", ")])
    if versions is None:
        return new
    return versions.withColumn("is_active", F.lit(False)).unionByName(new)


def active_model(versions: DataFrame) -> DataFrame:
    """R2: the active row (none when no model is active)."""
    return versions.filter(F.col("is_active")).orderBy(F.col("trained_on").desc()).limit(1)


# ---- R3 ----------------------------------------------------------------------------------
def resolve_winner(comparison: DataFrame | None, meta: DataFrame | None, saved: DataFrame | None = None) -> DataFrame:
    """The comparison's winner; else the best F1 among saved models (first model
    of the train order when none has a metric); else any saved model. Empty -> none.

    ``saved`` (model_path) lists the model folders that exist. With it, a winner or a
    model whose folder is missing, or that has no metadata, is passed over."""
    if saved is not None and meta is not None:
        meta = meta.join(saved.select("model_path").distinct(), "model_path", "left_semi")
        if comparison is not None:
            comparison = comparison.join(meta.select("model_name").distinct(), "model_name", "left_semi")
    if comparison is None and meta is None:
        raise ValueError("pass a comparison or a metadata table")
    spark = (comparison if comparison is not None else meta).sparkSession
    known = F.array_position(F.array(*[F.lit(m) for m in K.MODEL_ORDER]), F.col("model_name"))
    # an unknown name comes after the known ones
    order = F.when(known > 0, known).otherwise(F.lit(len(K.MODEL_ORDER) + 1))
    picks = []
    if comparison is not None:
        picks.append(comparison.filter(F.col("is_winner")).select("model_name", F.lit(1).alias("src"), F.lit(0.0).alias("k1"), order.alias("k2")))
    if meta is not None:
        latest = meta.withColumn("_r", F.row_number().over(Window.partitionBy("model_name").orderBy(F.col("timestamp").desc())))
        latest = latest.filter(F.col("_r") == 1)
        picks.append(latest.select("model_name", F.lit(2).alias("src"), (-F.coalesce(F.col("metrics.f1_score"), F.lit(0.0))).alias("k1"), order.alias("k2")))
    if not picks:
        return spark.createDataFrame([], "model_name string, source string")
    allp = picks[0]
    for p in picks[1:]:
        allp = allp.unionByName(p)
    best = allp.orderBy("src", "k1", "k2").limit(1)
    return best.select("model_name", F.when(F.col("src") == 1, "comparison").otherwise("metadata").alias("source"))


# ---- R4 / R6 ---------------------------------------------------------------------------------
def retrain_decision(current: DataFrame | None, new: DataFrame, force: bool = False, min_improvement: float = K.MIN_IMPROVEMENT) -> DataFrame:
    """For each new model, deploy when forced, when no current model exists, or when
    its F1 beats the old one by at least ``min_improvement`` (absolute)."""
    j = new.select(F.col("model_name").alias("new_model"), F.col("f1_score").alias("new_f1"))
    if current is None:
        j = j.withColumns({"old_model": F.lit(None).cast("string"), "old_f1": F.lit(None).cast("double")})
    else:
        cur = current.limit(1)
        # one-row scalar subqueries, null where there is no current model
        j = j.withColumns({"old_model": cur.select("model_name").scalar(), "old_f1": cur.select(F.col("f1_score").cast("double")).scalar()})
    improvement = F.col("new_f1") - F.col("old_f1")
    better = improvement >= F.lit(min_improvement)
    deploy = F.lit(force) | F.col("old_f1").isNull() | better
    reason = F.when(F.lit(force), "forced").when(F.col("old_f1").isNull(), "no current model").when(better, "improved").otherwise("kept current")
    return j.select("new_model", "new_f1", "old_model", "old_f1", improvement.alias("improvement"), deploy.alias("deploy"), reason.alias("reason"))


# ---- M18 / T2 ----------------------------------------------------------------------------------
def compare_models(metrics: DataFrame, folds: DataFrame) -> DataFrame:
    """A row per model with its metrics, the mean and population deviation of its
    fold F1 (``folds``: model_name, f1), and the winner: best F1, first in train order
    on ties. One row per model, so the ranking window is bounded."""
    cv = folds.groupBy("model_name").agg(F.avg("f1").alias("cv_f1_mean"), F.stddev_pop("f1").alias("cv_f1_std"))
    w = Window.orderBy(F.col("f1_score").desc(), F.col("train_order").asc())
    return metrics.join(cv, "model_name", "left").withColumn("is_winner", F.row_number().over(w) == 1)


def top_features(importance: DataFrame, n: int = 15) -> DataFrame:
    """The ``n`` most important features, ties by name."""
    return importance.orderBy(F.col("importance").desc(), "feature").limit(n)


def retrain_due(history: DataFrame, trained_on: str, min_new_events: int = K.RETRAIN_MIN_NEW_EVENTS) -> DataFrame:
    """Number of distinct events dated after the last training and whether it
    reaches the documented trigger."""
    after = history.filter(F.col("event_date") > F.lit(trained_on).cast("date"))
    return after.agg(F.count_distinct("event_id").cast("long").alias("new_events")).select(
        "new_events", (F.col("new_events") >= min_new_events).alias("due")
    )


# ---- storage -------------------------------------------------------------------------------------
class Registry:
    """Tables under ``root``. A table that is replaced (versions, comparison, importances)
    is a folder of generations, and the highest is the table; one that grows (meta,
    retrain log) is a folder of entries. Both are written aside and renamed into place, so
    a reader sees a whole generation or entry or none, and of two writers that aim at the
    same generation one takes the next. The file system must rename folders atomically."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _file_system(self, path: str):
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), hadoop

    def _names(self, folder: str) -> list[str]:
        fs, path = self._file_system(folder)
        return [str(f.getPath().getName()) for f in fs.listStatus(path)] if fs.exists(path) else []

    def _stage(self, df: DataFrame, name: str) -> str:
        """Write ``df`` to a folder that readers skip, marked as this writer's."""
        token = uuid.uuid4().hex
        staged = f"{self.root}/{name}/_staged-{token}"
        df.write.parquet(staged)
        fs, mark = self._file_system(f"{staged}/_by-{token}")
        fs.create(mark).close()
        return token

    def _place(self, name: str, token: str, target: str) -> bool:
        """Rename what was staged to ``target``; False where another writer has it."""
        fs, staged = self._file_system(f"{self.root}/{name}/_staged-{token}")
        _, there = self._file_system(f"{self.root}/{name}/{target}")
        if not fs.exists(there) and fs.rename(staged, there):
            # a rename onto a folder that has come in between moves below it
            _, mark = self._file_system(f"{self.root}/{name}/{target}/_by-{token}")
            if fs.exists(mark):
                return True
            staged = self._file_system(f"{self.root}/{name}/{target}/_staged-{token}")[1]
        fs.delete(staged, True)
        return False

    def _newest(self, name: str) -> int:
        """The highest generation, 0 where there is none."""
        return max((int(n[4:]) for n in self._names(f"{self.root}/{name}") if n.startswith("gen=")), default=0)

    def _replace(self, name: str, make: Callable[[DataFrame | None], DataFrame]) -> DataFrame:
        """Commit ``make(newest generation)`` as the next; when another writer was first,
        again from theirs, so that nothing is lost."""
        while True:
            newest = self._newest(name)
            token = self._stage(make(self._generation(name, newest)), name)
            if self._place(name, token, f"gen={newest + 1}"):
                return self._generation(name, newest + 1)

    def _generation(self, name: str, number: int) -> DataFrame | None:
        return self.spark.read.parquet(f"{self.root}/{name}/gen={number}") if number else None

    def _add(self, name: str, df: DataFrame) -> None:
        token = self._stage(df, name)
        if not self._place(name, token, f"entry={token}"):
            raise FileExistsError(f"{self.root}/{name}/entry={token}")

    def _entries(self, name: str) -> DataFrame | None:
        """All entries, or None where there is none yet."""
        if not any(n.startswith("entry=") for n in self._names(f"{self.root}/{name}")):
            return None
        return self.spark.read.parquet(f"{self.root}/{name}").drop("entry")

    def versions(self) -> DataFrame | None:
        return self._generation("model_versions", self._newest("model_versions"))

    def log_version(self, model_name: str, num_rows: int, metrics: dict, model_path: str) -> DataFrame:
        row = self.spark.createDataFrame(
            [(model_name, _dt.datetime.now(), int(num_rows), float(metrics["f1_score"]), float(metrics["auc_roc"] or 0.0),
              float(metrics["accuracy"]), model_path, True)],
            VERSIONS_SCHEMA,
        )
        return self._replace("model_versions", lambda versions: log_model_version(versions, row))

    def save_model(self, trained, feature_cols: list[str], state_json: str) -> str:
        ts = _dt.datetime.now().strftime("%Y%m%d_%H%M%S_%f")
        path = f"{self.root}/models/{trained.name}_{ts}"
        trained.model.write().overwrite().save(path)
        m = trained.metrics
        meta = self.spark.createDataFrame(
            [(trained.name, ts, feature_cols, (float(m["accuracy"]), float(m["f1_score"]), float(m["auc_roc"] or 0.0), float(m["threshold"])),
              float(m["threshold"]), path, state_json)],
            META_SCHEMA,
        )
        self._add("meta", meta)
        return path

    def meta(self) -> DataFrame | None:
        return self._entries("meta")

    def save_comparison(self, comparison: DataFrame) -> None:
        self._replace("comparison", lambda _: comparison)

    def comparison(self) -> DataFrame | None:
        return self._generation("comparison", self._newest("comparison"))

    def save_importance(self, importances: list[tuple[str, float]] | None) -> None:
        if importances:
            rows = self.spark.createDataFrame(importances, "feature string, importance double")
            self._replace("feature_importance", lambda _: rows)

    def importance(self) -> DataFrame | None:
        return self._generation("feature_importance", self._newest("feature_importance"))

    def log_retrain(self, model: str, f1: float, auc: float, deployed: bool, rows: int) -> None:
        attempt = [(_dt.datetime.now(), model, float(f1), float(auc or 0.0), bool(deployed), int(rows))]
        self._add("retrain_log", self.spark.createDataFrame(attempt, RETRAIN_LOG_SCHEMA))

    def retrain_log(self) -> DataFrame | None:
        return self._entries("retrain_log")

    def saved_models(self) -> DataFrame:
        """Model folders that exist, by their metadata files; the list is as long as the
        registry has models."""
        schema = "model_path string"
        names = self._names(f"{self.root}/models")
        return self.spark.createDataFrame([(f"{self.root}/models/{n}",) for n in names], schema)

    def load_winner(self):
        """(PipelineModel, meta row) of the resolved winner; a winner whose folder or
        metadata is missing gives way to the best saved model."""
        from pyspark.ml import PipelineModel

        meta = self.meta()
        saved = self.saved_models()
        win = resolve_winner(self.comparison(), meta, saved).first() if meta is not None else None
        if win is None:
            raise FileNotFoundError("no trained model in the registry")
        there = meta.join(saved, "model_path", "left_semi").filter(F.col("model_name") == win["model_name"])
        row = there.orderBy(F.col("timestamp").desc()).first()
        return PipelineModel.load(row["model_path"]), row


def publish(reg: Registry, results, prep, deploy: bool = True) -> DataFrame:
    """Save all models, comparison, importances and log the winner (train_all / retrain)."""
    from rollcall.plans.training import comparison_frame

    comp = comparison_frame(reg.spark, results)
    if not deploy:
        return comp
    state_json = json.dumps(prep.state.to_dict())
    paths = {r.name: reg.save_model(r, prep.feature_cols, state_json) for r in results}
    reg.save_comparison(comp)
    winner = comp.filter("is_winner").first()["model_name"]
    best = next(r for r in results if r.name == winner)
    reg.save_importance(best.importances)
    rows = [(r.name, f, float(v)) for r in results for f, v in (r.importances or [])]
    if rows:
        every = reg.spark.createDataFrame(rows, "model_name string, feature string, importance double")
        reg._replace("feature_importance_all", lambda _: every)
    reg.log_version(winner, prep.n_rows, best.metrics, paths[winner])
    return comp


def retrain(reg: Registry, flat: DataFrame, force: bool = False, cv: bool = True) -> DataFrame:
    """Train the three models, gate the winner against the active one, save when
    deployed, and log the attempt either way. Returns the decision row."""
    from rollcall.plans.training import comparison_frame, train_all_models

    versions = reg.versions()
    current = active_model(versions) if versions is not None else None
    if current is not None and current.isEmpty():
        current = None
    results, prep = train_all_models(flat, cv=cv)
    comp = comparison_frame(reg.spark, results)
    new = comp.filter("is_winner").select("model_name", "f1_score", "auc_roc")
    decision = retrain_decision(current, new, force=force).cache()
    d = decision.first()
    if d["deploy"]:
        publish(reg, results, prep, deploy=True)
    n = new.first()
    reg.log_retrain(n["model_name"], n["f1_score"], n["auc_roc"], d["deploy"], prep.n_rows)
    return decision


def model_details(comparison: DataFrame | None, meta: DataFrame, log: DataFrame | None) -> DataFrame:
    """Winner, display name, metrics, threshold, feature count, the FIRST 15 feature
    names (as shown by the dashboard), the comparison of all models and the last 10
    retrain attempts."""
    win = resolve_winner(comparison, meta)
    newest = F.row_number().over(Window.partitionBy("model_name").orderBy(F.col("timestamp").desc()))
    latest = meta.withColumn("_r", newest).filter("_r = 1")
    d = win.join(latest, "model_name", "left").select(
        F.col("model_name").alias("winner"),
        model_display_name(F.col("model_name")).alias("winner_display"),
        "metrics",
        F.coalesce(F.col("threshold"), F.col("metrics.threshold"), F.lit(K.DEFAULT_THRESHOLD)).alias("threshold"),
        F.size("feature_columns").alias("feature_count"),
        F.slice("feature_columns", 1, K.FIRST_FEATURES_SHOWN).alias("first_features"),
    )
    if comparison is not None:
        rows = comparison.agg(F.sort_array(F.collect_list(F.struct("train_order", "model_name", "f1_score", "is_winner"))).alias("c"))
        d = d.withColumn("comparison", rows.scalar())
    if log is not None:
        from rollcall.sources.tables import retrain_log_tail

        tail = retrain_log_tail(log, K.LOG_TAIL).agg(F.sort_array(F.collect_list(F.struct("ts", "model", "f1", "auc", "deployed", "rows"))).alias("h"))
        d = d.withColumn("retrain_history", tail.scalar())
    return d
