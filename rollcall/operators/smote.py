"""Minority over-sampling (M3 plan, M4 synthetic rows).

M3 is one aggregate. M4 follows the SMOTE recipe -- a synthetic row is
``a + lambda * (b - a)`` with ``a`` a minority row and ``b`` one of its k nearest
minority neighbours -- with exact neighbours:

* minority rows get a dense 0-based id (seeded hash rank) and a block number;
* neighbours come from the pivot join of ``knn.py``: a row is compared only with the
  rows of cells that can hold a nearer one;
* the i-th synthetic row draws its base, neighbour slot and lambda from seeded
  hashes of i, and meets its two parents through equi-joins on the ids; the
  interpolation is a native ``zip_with`` over the feature arrays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall import constants as K
from rollcall.operators.knn import nearest_neighbours
from rollcall.operators.sampling import hash_rank
from rollcall.session import cut_lineage


def smote_plan(train: DataFrame, label: str = "label") -> DataFrame:
    """M3: one row -- class counts, minority share r, target min(0.45, 2r), the number
    of synthetic rows int(target * majority - minority); ``active`` when r < 0.35,
    ``reachable`` false when the target is below the current ratio (then 0 rows)."""
    y = F.col(label)
    g = train.agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(y == 1, 1)).alias("minority"),
        F.count(F.when(F.coalesce(y != 1, F.lit(True)), 1)).alias("majority"),
    )
    # without rows there is no share, and nothing to add
    r = F.coalesce(F.try_divide(F.col("minority").cast("double"), F.col("n").cast("double")), F.lit(0.0))
    target = F.least(F.lit(K.SMOTE_TARGET_CAP), r * F.lit(2.0))
    raw = (target * F.col("majority") - F.col("minority")).cast("long")
    active = r < F.lit(K.SMOTE_TRIGGER)
    return g.select(
        "n",
        "minority",
        "majority",
        r.alias("ratio"),
        target.alias("target_ratio"),
        active.alias("active"),
        (raw > 0).alias("reachable"),
        F.when(active & (raw > 0), raw).otherwise(F.lit(0)).cast("long").alias("n_synthetic"),
    )


def knn_minority(minority: DataFrame, k: int = K.SMOTE_K, block_rows: int = 8192, query_ids: DataFrame | None = None) -> DataFrame:
    """Exact k nearest neighbours (euclidean) among ``minority`` rows (columns id, x),
    for every row or only for the ids in ``query_ids`` (column id).
    Returns (qid, rid, dist, nn) with nn = 0..k-1 in distance order (ties by rid)."""
    return nearest_neighbours(minority, k, block_rows, query_ids).table


def _unit(seed: int, j: F.Column, tag: str) -> F.Column:
    """Uniform double in [0, 1) from a seeded 64-bit hash."""
    h = F.xxhash64(F.lit(seed), F.lit(tag), j)
    return F.pmod(h, F.lit(1 << 53)).cast("double") / F.lit(float(1 << 53))


def smote_oversample(
    train: DataFrame,
    n_synthetic: int,
    key_cols: tuple[str, ...] = ("student_id", "event_id"),
    label: str = "label",
    x: str = "x",
    k: int = K.SMOTE_K,
    seed: int = K.SEED,
    folds: int = K.N_FOLDS,
    block_rows: int = 8192,
    stored: bool = False,
) -> DataFrame:
    """M4: ``train`` plus ``n_synthetic`` interpolated minority rows (is_synthetic=true).
    ``stored`` as for ``hash_rank``: ``train`` is read from a stored table."""
    out = train.withColumn("is_synthetic", F.lit(False))
    if n_synthetic <= 0:
        return out
    spark = train.sparkSession
    minority = hash_rank(train.filter(F.col(label) == 1).select(*key_cols, x), list(key_cols), [], seed, out="id", stored=stored).select("id", x)
    # ranked once: the kNN pass and both parent joins read the stored ids
    minority = cut_lineage(minority.withColumnRenamed(x, "x"))
    m = minority.count()
    if m < 2:
        return out
    kk = min(k, m - 1)
    j = F.col("j")
    draws = spark.range(n_synthetic).withColumnRenamed("id", "j").select(
        "j",
        F.pmod(F.xxhash64(F.lit(seed), F.lit("base"), j), F.lit(m)).alias("base"),
        F.pmod(F.xxhash64(F.lit(seed), F.lit("nn"), j), F.lit(kk)).cast("int").alias("slot"),
        _unit(seed, j, "lambda").alias("lam"),
    )
    # neighbours are needed only for the rows drawn as a base
    knn = knn_minority(minority, k, block_rows, query_ids=draws.select(F.col("base").alias("id")))
    a = minority.select(F.col("id").alias("base"), F.col("x").alias("xa"))
    nb = knn.select(F.col("qid").alias("base"), F.col("nn").cast("int").alias("slot"), F.col("rid"))
    b = minority.select(F.col("id").alias("rid"), F.col("x").alias("xb"))
    syn = draws.join(a, "base").join(nb, ["base", "slot"]).join(b, "rid")
    new_x = F.zip_with("xa", "xb", lambda u, v: u + F.col("lam") * (v - u))
    syn_rows = syn.select(
        F.concat(F.lit("SYN_"), F.col("j").cast("string")).alias(key_cols[0]),
        *[F.lit(None).cast("string").alias(c) for c in key_cols[1:]],
        F.lit(1).cast(train.schema[label].dataType).alias(label),
        new_x.alias(x),
        (F.col("j") % folds).cast("int").alias("fold"),
        F.lit(True).alias("is_synthetic"),
    )
    syn_rows = cut_lineage(syn_rows)  # the join of parents and neighbours runs once
    cols = out.columns
    return out.unionByName(syn_rows.select(*[c for c in cols if c in syn_rows.columns]), allowMissingColumns=True)
