import random

import numpy as np

from rollcall.operators import metrics as MT


def _scored(spark, pairs):
    return spark.createDataFrame(pairs, "label int, p double")


def test_sweep_equals_brute_force(spark):
    rnd = random.Random(7)
    grid = MT.threshold_grid()
    pairs = [(rnd.randint(0, 1), rnd.choice(grid + [rnd.random() for _ in range(3)])) for _ in range(400)]
    sweep = {r["idx"]: r for r in MT.threshold_sweep(_scored(spark, pairs)).collect()}
    for i, t in enumerate(grid):
        tp = sum(1 for y, p in pairs if y == 1 and p >= t)
        fp = sum(1 for y, p in pairs if y == 0 and p >= t)
        fn = sum(1 for y, p in pairs if y == 1 and p < t)
        assert (sweep[i]["tp"], sweep[i]["fp"], sweep[i]["fn"]) == (tp, fp, fn)
        f1 = 2 * tp / (2 * tp + fp + fn) if (2 * tp + fp + fn) else 0.0
        assert abs(sweep[i]["f1"] - f1) < 1e-12


def test_grid_is_numpy_arange():
    g = MT.threshold_grid()
    assert len(g) == 25 and g == [float(x) for x in np.arange(0.10, 0.60, 0.02)]


def test_all_negative_gives_default_threshold(spark):
    best = MT.best_threshold(MT.threshold_sweep(_scored(spark, [(0, 0.3), (0, 0.9)]))).first()
    assert best["threshold"] == 0.5 and best["f1"] == 0.0


def test_auc_ties_and_brute_force(spark):
    rnd = random.Random(3)
    pairs = [(rnd.randint(0, 1), round(rnd.random(), 1)) for _ in range(300)]
    got = MT.auc_roc(_scored(spark, pairs), buckets=4).first()["auc_roc"]
    pos = [p for y, p in pairs if y == 1]
    neg = [p for y, p in pairs if y == 0]
    want = sum((1.0 if a > b else 0.5 if a == b else 0.0) for a in pos for b in neg) / (len(pos) * len(neg))
    assert abs(got - want) < 1e-12


def test_confusion_and_report(spark):
    s = _scored(spark, [(1, 0.9), (1, 0.2), (0, 0.8), (0, 0.1)])
    cm = MT.confusion_matrix(s, 0.5).first()
    assert (cm["tn"], cm["fp"], cm["fn"], cm["tp"]) == (1, 1, 1, 1)
    rep = {r["class_label"]: r for r in MT.classification_report(MT.confusion_matrix(s, 0.5)).collect()}
    assert rep["accuracy"]["f1_score"] == 0.5 and rep["Attended"]["support"] == 2
