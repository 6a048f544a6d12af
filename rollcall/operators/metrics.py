"""Exact classification metrics as aggregates.

Input: a scored table with an integer label (0/1) and a probability column.
Every metric is one partial/final aggregate over the scored rows; the only
follow-up work runs on tables whose size is fixed by the threshold grid (26
buckets) or by a bucket count, never by the data.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall import constants as K


def threshold_grid() -> list[float]:
    """The 25 thresholds 0.10, 0.12, ... 0.58 with the exact doubles of ``numpy.arange``."""
    return [float(t) for t in np.arange(K.THRESHOLD_START, K.THRESHOLD_STOP, K.THRESHOLD_STEP)]


def _safe_div(num: Column, den: Column) -> Column:
    return F.when(den != 0, num / den).otherwise(F.lit(0.0))


def _f1(tp: Column, fp: Column, fn: Column) -> Column:
    return _safe_div(2 * tp.cast("double"), (2 * tp + fp + fn).cast("double"))


def threshold_sweep(scored: DataFrame, label: str = "label", score: str = "p", grid: list[float] | None = None) -> DataFrame:
    """M9: confusion counts and F1 for predict ``p >= t`` at every grid threshold.

    Each row goes to the bucket of the highest threshold <= p (-1 below the grid);
    counts per (bucket, label) are a 26-row aggregate; a second aggregate over that
    tiny table turns them into reverse running sums. One shuffle for any data size."""
    grid = grid or threshold_grid()
    # highest grid index with t <= p, as a CASE chain (codegen, no lambda per row)
    p = F.col(score)
    bucket = None
    for i in range(len(grid) - 1, -1, -1):
        bucket = F.when(p >= F.lit(grid[i]), F.lit(i)) if bucket is None else bucket.when(p >= F.lit(grid[i]), F.lit(i))
    bucket = bucket.otherwise(F.lit(-1))
    y = F.col(label)
    counts = scored.groupBy(bucket.alias("b")).agg(
        F.sum(F.when(y == 1, 1).otherwise(0)).cast("long").alias("pos"),
        F.sum(F.when(y == 1, 0).otherwise(1)).cast("long").alias("neg"),
    )
    sums = []
    for i in range(len(grid)):
        sums += [
            F.coalesce(F.sum(F.when(F.col("b") >= i, F.col("pos"))), F.lit(0)).cast("long").alias(f"tp{i}"),
            F.coalesce(F.sum(F.when(F.col("b") >= i, F.col("neg"))), F.lit(0)).cast("long").alias(f"fp{i}"),
        ]
    wide = counts.agg(
        F.coalesce(F.sum("pos"), F.lit(0)).cast("long").alias("P"),
        F.coalesce(F.sum("neg"), F.lit(0)).cast("long").alias("N"),
        *sums,
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(i).alias("idx"), F.lit(t).alias("threshold"), F.col(f"tp{i}").alias("tp"), F.col(f"fp{i}").alias("fp")
            )
            for i, t in enumerate(grid)
        ]
    )
    long = wide.select("P", "N", F.inline(rows))
    tp, fp = F.col("tp"), F.col("fp")
    fn, tn = F.col("P") - tp, F.col("N") - fp
    return long.select(
        F.col("idx").cast("int").alias("idx"),
        "threshold",
        tp.alias("tp"),
        fp.alias("fp"),
        fn.alias("fn"),
        tn.alias("tn"),
        _safe_div(tp.cast("double"), (tp + fp).cast("double")).alias("precision"),
        _safe_div(tp.cast("double"), F.col("P").cast("double")).alias("recall"),
        _f1(tp, fp, fn).alias("f1"),
    )


def best_threshold(sweep: DataFrame) -> DataFrame:
    """First threshold with the strictly best F1; 0.5 when every F1 is 0."""
    top = sweep.orderBy(F.col("f1").desc(), F.col("idx").asc()).limit(1)
    return top.select(
        F.when(F.col("f1") > 0, F.col("threshold")).otherwise(F.lit(K.DEFAULT_THRESHOLD)).alias("threshold"),
        F.col("f1").alias("f1"),
    )


def confusion_matrix(scored: DataFrame, threshold: Column | float, label: str = "label", score: str = "p", by: list[str] | None = None) -> DataFrame:
    """TN/FP/FN/TP at ``p >= threshold`` (optionally per group)."""
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    pred = F.col(score) >= t
    y = F.col(label) == 1
    aggs = [
        F.sum(F.when(~y & ~pred, 1).otherwise(0)).cast("long").alias("tn"),
        F.sum(F.when(~y & pred, 1).otherwise(0)).cast("long").alias("fp"),
        F.sum(F.when(y & ~pred, 1).otherwise(0)).cast("long").alias("fn"),
        F.sum(F.when(y & pred, 1).otherwise(0)).cast("long").alias("tp"),
    ]
    return scored.groupBy(*(by or [])).agg(*aggs)


def accuracy_f1(confusion: DataFrame) -> DataFrame:
    """M12 from M11 counts."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return confusion.select(
        "*",
        _safe_div((tp + tn).cast("double"), (tp + tn + fp + fn).cast("double")).alias("accuracy"),
        _f1(tp, fp, fn).alias("f1"),
    )


def auc_roc(scored: DataFrame, label: str = "label", score: str = "p", buckets: int = 1024) -> DataFrame:
    """Area under the ROC curve with ties counted one half (Mann-Whitney).

    Distinct scores are grouped (partial aggregation), range-bucketed by approximate
    quantiles (a bounded list of split points), and the negatives below each score are
    a per-bucket running sum plus the bucket's offset from a table of ``buckets`` rows."""
    y = F.col(label)
    g = scored.groupBy(F.col(score).cast("double").alias("s")).agg(
        F.sum(F.when(y == 1, 1).otherwise(0)).cast("double").alias("pos"),
        F.sum(F.when(y == 1, 0).otherwise(1)).cast("double").alias("neg"),
    )
    g = g.persist()  # one row per distinct score; read by the quantile pass and the scan
    probs = [i / buckets for i in range(1, buckets)]
    q = g.agg(F.percentile_approx("s", probs, 10000).alias("q")).first()["q"] or []
    splits = [-float("inf")] + sorted(set(float(v) for v in q)) + [float("inf")]
    if len(splits) < 3:
        splits = [-float("inf"), 0.0, float("inf")]
    bucketed = Bucketizer(splits=splits, inputCol="s", outputCol="bk", handleInvalid="keep").transform(g)
    from pyspark.sql import Window

    per_bucket = bucketed.groupBy("bk").agg(F.sum("neg").alias("bneg"))
    # prefix over at most `buckets` rows
    offsets = per_bucket.select(
        "bk", F.coalesce(F.sum("bneg").over(Window.orderBy("bk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("off")
    )
    within = Window.partitionBy("bk").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    contrib = (
        bucketed.withColumn("below", F.coalesce(F.sum("neg").over(within), F.lit(0.0)))
        .join(F.broadcast(offsets), "bk")
        .select((F.col("pos") * (F.col("off") + F.col("below") + F.lit(0.5) * F.col("neg"))).alias("c"), "pos", "neg")
    )
    tot = contrib.agg(F.sum("c").alias("c"), F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    return tot.select(
        F.when((F.col("P") > 0) & (F.col("N") > 0), F.col("c") / (F.col("P") * F.col("N"))).alias("auc_roc")
    )


def classification_report(confusion: DataFrame) -> DataFrame:
    """Per-class precision/recall/F1/support, accuracy, macro and weighted averages."""
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    p1, r1 = _safe_div(tp, tp + fp), _safe_div(tp, tp + fn)
    p0, r0 = _safe_div(tn, tn + fn), _safe_div(tn, tn + fp)
    f1_1, f1_0 = _safe_div(2 * p1 * r1, p1 + r1), _safe_div(2 * p0 * r0, p0 + r0)
    s1, s0 = tp + fn, tn + fp

    def row(name, p, r, f, s):
        return F.struct(F.lit(name).alias("class_label"), p.alias("precision"), r.alias("recall"), f.alias("f1_score"), s.cast("long").alias("support"))

    rows = F.array(
        row("Not Attended", p0, r0, f1_0, s0),
        row("Attended", p1, r1, f1_1, s1),
        row("accuracy", F.lit(None).cast("double"), F.lit(None).cast("double"), _safe_div(tp + tn, n), n),
        row("macro avg", (p0 + p1) / 2, (r0 + r1) / 2, (f1_0 + f1_1) / 2, n),
        row("weighted avg", _safe_div(p0 * s0 + p1 * s1, n), _safe_div(r0 * s0 + r1 * s1, n), _safe_div(f1_0 * s0 + f1_1 * s1, n), n),
    )
    return confusion.select(F.inline(rows))


def metrics_by_group(scored: DataFrame, threshold: Column | float, by: list[str], label: str = "label", score: str = "p") -> DataFrame:
    """Recall, precision and F1 per group (e.g. department) at a threshold."""
    cm = confusion_matrix(scored, threshold, label, score, by=by)
    tp, fp, fn = (F.col(c).cast("double") for c in ("tp", "fp", "fn"))
    return cm.select(
        *by,
        "tp",
        "fp",
        "fn",
        "tn",
        _safe_div(tp, tp + fp).alias("precision"),
        _safe_div(tp, tp + fn).alias("recall"),
        _f1(F.col("tp"), F.col("fp"), F.col("fn")).alias("f1"),
        (F.col("tp") + F.col("fn")).alias("support"),
    )
