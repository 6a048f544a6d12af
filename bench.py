"""Headline timings: prints ONE JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8). Each query runs
from the parquet tables; results are materialised (collect for small outputs, the
no-op sink for row-level outputs) so the timing covers the whole job.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = set(filter(None, os.environ.get("BENCH_ONLY", "").split(",")))
    from rollcall.session import local_session

    spark = local_session(cores=cpus, shuffle_partitions=int(cpus) * 2, app="rollcall-bench")
    import rollcall.catalog as C
    from rollcall.plans import predict as PR
    from rollcall.plans import training as T

    def sink(df):
        df.write.format("noop").mode("overwrite").save()

    times: dict[str, float] = {}

    def run(name, fn):
        if only and name not in only:
            return None
        t0 = time.time()
        out = fn()
        times[name] = round(time.time() - t0, 3)
        print(f"[bench] {name}: {times[name]}s", file=sys.stderr, flush=True)
        return out

    # one query straight from the driver's tables, plan and joins included
    run("rate_by_topic_unstored", lambda: C.CATALOG["rate_by_topic"][0](spark, sf_dir).collect())
    # ETL: derive the registration table from the driver tables once and store it;
    # every timed operator below reads the stored table (as a deployed job would)
    run("registrations_flat", lambda: C.materialize(spark, sf_dir))
    run("feature_pipeline", lambda: sink(C.q_feature_pipeline(spark, sf_dir)))
    run("history_features", lambda: sink(C.q_history_all(spark, sf_dir)))
    run("all_breakdowns", lambda: C.q_all_breakdowns(spark, sf_dir).collect())
    run("threshold_sweep", lambda: C.q_threshold_sweep(spark, sf_dir).collect())
    run("auc_roc", lambda: C.q_auc(spark, sf_dir).collect())
    run("stratified_split", lambda: sink(C.q_split(spark, sf_dir)))
    prep = run("prepare_data", lambda: T.prepare_data(C.flat(spark, sf_dir), stored=True))
    models = {}
    if prep is not None:
        # the logistic fit with its 5-fold cross-validation, as training does it; the folds
        # of the two tree models would take five times their own time each
        for name, q in [("train_logistic_cv", "logistic_regression"), ("train_random_forest", "random_forest"), ("train_gbt", "xgboost")]:
            r = run(name, lambda q=q: T.train_one(q, prep, cv=q == "logistic_regression"))
            if r is not None:
                models[q] = r
        if models:
            best = max(models.values(), key=lambda r: r.metrics["f1_score"])

            def predict():
                hist = C.flat(spark, sf_dir)
                planned = C.planned(spark, sf_dir)
                sink(PR.predict_planned_events(best.model, prep.state, best.metrics["threshold"], hist, planned))

            run("predict_planned_events", predict)
    spark.stop()
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_wall_time", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
