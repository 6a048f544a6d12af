"""Training-set preparation, the three classifiers and their evaluation.

The driver only orchestrates: every data step is a Spark job and what comes back
to the driver is bounded (metric rows, the 25-row sweep, importances per
feature). Lineage is cut with tables in the shared ``spark.checkpoint.dir``; the whole
matrix is stored only before the iterative fits.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from functools import partial

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall import constants as K
from rollcall.functions.scalar import one_hot_names
from rollcall.operators import metrics as MT
from rollcall.operators.quantile import fill_median
from rollcall.operators.sampling import stratified_split
from rollcall.operators.smote import smote_oversample, smote_plan
from rollcall.plans.features import FeatureState, align_features, fit_feature_state, one_hot, transform_features
from rollcall.session import cut_lineage

KEYS = ("student_id", "event_id")


@dataclass
class Prepared:
    train: DataFrame  # keys, label, x (array<double>), fold, is_synthetic
    test: DataFrame  # keys, label, x, department
    feature_cols: list[str]
    state: FeatureState
    plan: dict
    n_rows: int = 0

    @property
    def train_rows(self) -> int:
        """Rows of the training part with the synthetic ones."""
        return self.plan["n"] + (self.plan["n_synthetic"] or 0)


@dataclass
class TrainedModel:
    name: str
    model: PipelineModel
    metrics: dict
    cv_scores: list[float] = field(default_factory=list)
    importances: list[tuple[str, float]] | None = None


def feature_matrix(featured: DataFrame, feature_cols: list[str], label: str = "attended", extra: tuple[str, ...] = ()) -> DataFrame:
    """Keys, label and the feature array (doubles, in trained order)."""
    aligned = align_features(featured, feature_cols, keep=[*KEYS, label, *extra])
    return aligned.select(
        *KEYS,
        F.col(label).cast("int").alias("label"),
        *extra,
        F.array(*[F.col(f"`{c}`").cast("double") for c in feature_cols]).alias("x"),
    )


def prepare_data(flat: DataFrame, oversample: bool = True, seed: int = K.SEED, stored: bool = False) -> Prepared:
    """M2: features (M1) -> median fill over the whole matrix (P14) -> stratified split
    (T6) with folds (T7) -> over-sampling of the training part only (M3/M4). ``flat`` is
    read several times: it is stored, or, where it is ``stored`` already, read from there."""
    flat = flat if stored else cut_lineage(flat)
    # the narrow rows are split before they get their features; rows without an outcome are
    # in neither part, but a student's history has them
    labelled = flat.withColumn("_label", F.col("attended").cast("int"))
    marked = stratified_split(labelled.filter("_label is not null"), KEYS, "_label", K.TEST_FRACTION, seed, stored=True)
    marked = marked.unionByName(labelled.filter("_label is null"), allowMissingColumns=True).drop("_label")
    state = fit_feature_state(flat)
    cols = state.feature_columns()
    coded = {n for c in K.NOMINAL_COLUMNS for n in one_hot_names(c, state.categories.get(c, []))}
    kept = [*KEYS, "attended", "department", "is_test", "fold", *K.NOMINAL_COLUMNS, *[c for c in cols if c not in coded]]
    # medians, split and matrix all read it; one-hot columns are told again from the nominal ones
    featured = one_hot(cut_lineage(transform_features(marked, state).select(*dict.fromkeys(kept))), state)
    filled, medians = fill_median(featured, cols)
    state.medians = {k: v for k, v in medians.items() if v is not None}
    data = feature_matrix(filled, cols, extra=("department", "is_test", "fold"))
    train = data.filter(~F.col("is_test")).drop("is_test")
    test = data.filter(F.col("is_test")).drop("is_test", "fold")
    plan = smote_plan(train).first().asDict()
    train = train.drop("department")
    if oversample and plan["active"] and plan["n_synthetic"] > 0:
        train = smote_oversample(train, plan["n_synthetic"], seed=seed, stored=True)
    else:
        train = train.withColumn("is_synthetic", F.lit(False))
    return Prepared(train, test, cols, state, plan, n_rows=plan["n"] + test.count())


def _vec(df: DataFrame) -> DataFrame:
    return df.withColumn("features", array_to_vector("x"))


def _fit_input(df: DataFrame) -> DataFrame:
    """What an estimator reads, and no more. It is not cached: estimators cache their own
    form of it, and a second copy would take as much memory, or disk."""
    return _vec(df).select("label", "weight", "features")


ROW_BYTES_PER_FEATURE = 8
TARGET_PARTITION_BYTES = 128 * 1024 * 1024


#: Training input that is worth a partition of its own, and fits that run side by side.
LEAST_PARTITION_BYTES = 8 * 1024 * 1024
PARALLEL_FITS = 6
#: What the fits that run side by side may keep in memory for each core.
CACHE_BYTES_PER_CORE = 512 * 1024 * 1024
#: Bytes that an estimator itself caches of a row: binned features, with a count for each
#: tree of a forest, or blocks of doubles.
CACHED_ROW_BYTES = {"xgboost": lambda width: 4 * width + 100, "random_forest": lambda width: 4 * (width + 300) + 100,
                    "logistic_regression": lambda width: 8 * width + 20}


def fit_partitions(df: DataFrame, rows: int, n_features: int) -> DataFrame:
    """Repartition the training input once before an iterative fit: a partition of 8 MB at
    least, as every one of some thousand passes pays for each; one per core at most, or
    more when that would exceed ~128 MB per partition (large data). Then they are whole
    waves, so that no pass waits for a last few tasks. Estimators read their input some
    times before they cache it in their own form, so input that is larger than two such
    waves is read as it is stored: dealing it would shuffle it each time."""
    dp = df.sparkSession.sparkContext.defaultParallelism
    size = rows * n_features * ROW_BYTES_PER_FEATURE
    target = max(min(dp, max(1, -(-size // LEAST_PARTITION_BYTES))), -(-size // TARGET_PARTITION_BYTES))
    there = df.rdd.getNumPartitions()
    if target > dp:
        waves = -(-target // dp)
        if waves <= 2:
            return df.repartition(waves * dp)
        return df.coalesce(waves * dp) if there > waves * dp else df
    return df if there == target else df.coalesce(target) if there > target else df.repartition(target)


def fits_at_once(spark, name: str, rows: int, n_features: int, parallel: int = PARALLEL_FITS) -> int:
    """How many fits of a model run side by side: as many as can keep what they cache in
    memory; what does not fit goes to disk, and is read from there in every pass."""
    room = spark.sparkContext.defaultParallelism * CACHE_BYTES_PER_CORE
    return max(1, min(parallel, room // max(1, rows * CACHED_ROW_BYTES[name](n_features))))


def side_by_side(spark, tasks: list, parallel: int = PARALLEL_FITS) -> list:
    """Results of tasks (functions without arguments) in their order. Boosting is a long
    chain of short jobs that leaves most cores idle; several chains fill them."""
    with ThreadPoolExecutor(max(1, min(parallel, len(tasks)))) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(task)) for task in tasks]]


def weight_table(train: DataFrame, label: str = "label") -> DataFrame:
    """M5 as one row: class counts and weights; null where a class has no rows."""
    c = train.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(label), F.lit(0)).cast("long").alias("n_pos"))
    c = c.withColumn("n_neg", F.col("n") - F.col("n_pos"))
    half = F.col("n") / F.lit(2.0)
    return c.select(
        "n", "n_pos", "n_neg",
        F.try_divide(half, F.col("n_pos").cast("double")).alias("balanced_pos"),
        F.try_divide(half, F.col("n_neg").cast("double")).alias("balanced_neg"),
        F.try_divide(F.col("n_neg").cast("double"), F.col("n_pos").cast("double")).alias("scale_pos_weight"),
    )


def class_weights(train: DataFrame, mode: str) -> DataFrame:
    """M5: ``balanced`` -> n / (2 n_c); ``pos_ratio`` -> 1 for negatives, neg/pos for positives.
    A class without rows has no weight to give, so the other one has 1."""
    stats = weight_table(train).first()
    if mode == "balanced":
        w_pos, w_neg = stats["balanced_pos"] or 1.0, stats["balanced_neg"] or 1.0
    else:
        w_pos, w_neg = stats["scale_pos_weight"] or 1.0, 1.0
    return train.withColumn("weight", F.when(F.col("label") == 1, F.lit(w_pos)).otherwise(F.lit(w_neg)))


def gbt_estimator(seed: int = K.SEED) -> Pipeline:
    """M6: boosted trees with the reference's capacity settings (300 x depth 6, lr 0.05,
    row subsample 0.85, 70 % features per tree, >= 3 rows per leaf)."""
    gbt = GBTClassifier(
        featuresCol="features",
        labelCol="label",
        weightCol="weight",
        maxIter=300,
        maxDepth=6,
        stepSize=0.05,
        subsamplingRate=0.85,
        featureSubsetStrategy="0.7",
        minInstancesPerNode=3,
        seed=seed,
        maxMemoryInMB=1024,
        cacheNodeIds=False,  # one tree of six levels: finding a row's node again is less than storing it
        checkpointInterval=10,
    )
    return Pipeline(stages=[gbt])


def rf_estimator(seed: int = K.SEED) -> Pipeline:
    """M7: 300 trees, depth 8, >= 4 rows per leaf, sqrt features, balanced weights."""
    rf = RandomForestClassifier(
        featuresCol="features",
        labelCol="label",
        weightCol="weight",
        numTrees=300,
        maxDepth=8,
        minInstancesPerNode=4,
        featureSubsetStrategy="sqrt",
        seed=seed,
        maxMemoryInMB=1024,  # more tree nodes per pass over the data (fewer passes)
        cacheNodeIds=False,  # 300 node ids a row and level would be cached, and spill
    )
    return Pipeline(stages=[rf])


def lr_estimator(total_weight: float, c: float = 1.0) -> Pipeline:
    """M8: standardise, then L2 logistic regression; sklearn's C maps to
    regParam = 1 / (C * sum of weights) because Spark averages the loss."""
    scaler = StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True)
    lr = LogisticRegression(
        featuresCol="scaled",
        labelCol="label",
        weightCol="weight",
        regParam=1.0 / (c * total_weight),
        elasticNetParam=0.0,
        maxIter=1000,
        standardization=False,
        family="binomial",
    )
    return Pipeline(stages=[scaler, lr])


WEIGHT_MODE = {"xgboost": "pos_ratio", "random_forest": "balanced", "logistic_regression": "balanced"}


def estimator_for(name: str, weighted: DataFrame) -> Pipeline:
    if name == "xgboost":
        return gbt_estimator()
    if name == "random_forest":
        return rf_estimator()
    total = weighted.agg(F.sum("weight")).first()[0]
    return lr_estimator(total)


def score(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Probability of class 1 as ``p`` (keeps the other columns)."""
    out = model.transform(_vec(df))
    return out.withColumn("p", vector_to_array("probability")[1]).drop("features", "scaled", "rawPrediction", "probability", "prediction")


def evaluate(scored: DataFrame) -> dict:
    """Threshold tuned on the scored rows (M9/M10), then accuracy, F1 (M12) and AUC."""
    scored = scored.select("label", "p").persist()  # read by the sweep, the counts and the AUC
    sweep = MT.threshold_sweep(scored).cache()
    best = MT.best_threshold(sweep).first()
    t = best["threshold"]
    cm = MT.accuracy_f1(MT.confusion_matrix(scored, t)).first()
    auc = MT.auc_roc(scored).first()["auc_roc"]
    sweep.unpersist()
    scored.unpersist()
    return {"accuracy": cm["accuracy"], "f1_score": cm["f1"], "auc_roc": auc, "threshold": t}


def fold_f1(name: str, train: DataFrame, fold: int) -> float:
    """F1 at the model's own 0.5 on one held-out fold."""
    part = class_weights(train.filter(F.col("fold") != fold), WEIGHT_MODE[name])
    rows, width = _size(part)
    part = fit_partitions(_fit_input(part), rows, width)
    model = estimator_for(name, part).fit(part)
    held = score(model, train.filter(F.col("fold") == fold))
    return MT.accuracy_f1(MT.confusion_matrix(held, K.DEFAULT_THRESHOLD)).first()["f1"]


def _size(train: DataFrame) -> tuple[int, int]:
    """Rows and features of a training table."""
    size = train.agg(F.count(F.lit(1)).alias("n"), F.first(F.size("x")).alias("width")).first()
    return size["n"], size["width"] or 1


def cv_f1(name: str, train: DataFrame, folds: int = K.N_FOLDS, parallel: int = PARALLEL_FITS) -> list[float]:
    """F1 at the model's own 0.5 on each held-out fold of the (over-sampled) train set;
    the folds are fitted side by side from the one stored matrix, as far as memory goes."""
    spark, train = train.sparkSession, cut_lineage(train)
    return side_by_side(spark, [partial(fold_f1, name, train, f) for f in range(folds)], fits_at_once(spark, name, *_size(train), parallel))


def feature_importance(model: PipelineModel, feature_cols: list[str]) -> list[tuple[str, float]] | None:
    """Tree importances; for logistic regression |standardised coefficient| (addition)."""
    last = model.stages[-1]
    if hasattr(last, "featureImportances"):
        imp = last.featureImportances.toArray().tolist()
    elif hasattr(last, "coefficients"):
        imp = [abs(v) for v in last.coefficients.toArray().tolist()]
    else:
        return None
    return sorted(zip(feature_cols, imp), key=lambda t: -t[1])


def fit_one(name: str, prep: Prepared) -> tuple[PipelineModel, dict]:
    """A model fitted on the training part and its metrics on the test part."""
    weighted = fit_partitions(_fit_input(class_weights(prep.train, WEIGHT_MODE[name])), prep.train_rows, len(prep.feature_cols))
    model = estimator_for(name, weighted).fit(weighted)
    return model, evaluate(score(model, prep.test))


def train_many(names: list[str], prep: Prepared, cv: bool = True) -> list[TrainedModel]:
    """One model after the other, each with the folds of its cross-validation side
    by side, as far as memory goes."""
    spark, out = prep.train.sparkSession, []
    prep = replace(prep, train=cut_lineage(prep.train))  # every fit reads the whole matrix some times
    for name in names:
        tasks = [partial(fit_one, name, prep)] + [partial(fold_f1, name, prep.train, f) for f in (range(K.N_FOLDS) if cv else ())]
        (model, metrics), *scores = side_by_side(spark, tasks, fits_at_once(spark, name, prep.train_rows, len(prep.feature_cols)))
        out.append(TrainedModel(name, model, metrics, scores, feature_importance(model, prep.feature_cols)))
    return out


def train_one(name: str, prep: Prepared, cv: bool = True) -> TrainedModel:
    return train_many([name], prep, cv)[0]


def train_all_models(flat: DataFrame, cv: bool = True, models: list[str] | None = None, stored: bool = False) -> tuple[list[TrainedModel], Prepared]:
    """Prepare once, fit the three models, evaluate each."""
    prep = prepare_data(flat, stored=stored)
    return train_many(models or K.MODEL_ORDER, prep, cv), prep


def comparison_frame(spark, results: list[TrainedModel]) -> DataFrame:
    """One row per model with its metrics; winner = best F1, first in train order on ties."""
    from pyspark.sql import Window

    rows = [
        (r.name, i, float(r.metrics["accuracy"]), float(r.metrics["f1_score"]), float(r.metrics["auc_roc"] or 0.0),
         float(r.metrics["threshold"]), float(sum(r.cv_scores) / len(r.cv_scores)) if r.cv_scores else None,
         float(_pop_std(r.cv_scores)) if r.cv_scores else None)
        for i, r in enumerate(results)
    ]
    df = spark.createDataFrame(
        rows,
        "model_name string, train_order int, accuracy double, f1_score double, auc_roc double, threshold double, "
        "cv_f1_mean double, cv_f1_std double",
    )
    w = Window.orderBy(F.col("f1_score").desc(), F.col("train_order").asc())
    return df.withColumn("is_winner", F.row_number().over(w) == 1)


def _pop_std(xs: list[float]) -> float:
    if not xs:
        return 0.0
    m = sum(xs) / len(xs)
    return (sum((x - m) ** 2 for x in xs) / len(xs)) ** 0.5
