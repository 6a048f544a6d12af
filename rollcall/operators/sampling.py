"""Reproducible sampling, stratified split and folds.

All three rest on ``hash_rank``: an exact 0-based rank of rows inside a group by a
seeded md5 order, computed without sending a group to one task. Rows are put in ordered
buckets by the first hex digits of the hash (buckets are ranges of the order); buckets
with too many rows are split again by the next digits, and so on. The counts form a tree:
a node's offset is the sum of its smaller siblings, of which there are at most 4096, and
a row's rank is the sum of the offsets on its way down and its place among the rows of
its last, bounded bucket. md5 over text is computed the same way by Spark and by SQL
engines, so the ranks are reproducible anywhere.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollcall import constants as K
from rollcall.session import cut_lineage

#: Hex digits that a level of buckets looks at (4096 children), of 32 in all, and the rows
#: from which a bucket is split again.
BUCKET_HEX_DIGITS, HEX_DIGITS = 3, 32
BUCKET_ROWS = 1 << 18


def seeded_hash(cols: Sequence[str], seed: int = K.SEED) -> Column:
    parts = [F.lit(str(seed))] + [F.col(c).cast("string") for c in cols]
    return F.md5(F.concat_ws("|", *parts))


def hash_rank(df: DataFrame, key_cols: Sequence[str], group_cols: Sequence[str] = (), seed: int = K.SEED, out: str = "_rank", most: int = BUCKET_ROWS, stored: bool = False) -> DataFrame:
    """Add ``out``: exact 0-based rank of each row within ``group_cols`` ordered by
    md5(seed|keys) (keys must be unique within a group; null groups are one group). The
    rows are stored once, as they are counted level by level, or read again where they are
    a part of a table that is ``stored`` already; no window holds more than
    ``most`` rows or 4096 offsets. The hash is neither stored nor shuffled: it is found
    again from the keys."""
    groups = list(group_cols)
    hashed = seeded_hash(key_cols, seed)
    rows = (df if stored else cut_lineage(df)).withColumn("_h", hashed).withColumn("_off", F.lit(0).cast("long")).withColumn("_open", F.lit(True))
    path: list[str] = []
    for at in range(1, HEX_DIGITS, BUCKET_HEX_DIGITS):
        child = f"_b{at}"
        rows = rows.withColumn(child, F.when(F.col("_open"), F.substring("_h", at, BUCKET_HEX_DIGITS)))
        counts = rows.filter("_open").groupBy(*groups, *path, child).agg(F.count(F.lit(1)).alias("_n"))
        smaller = Window.partitionBy(*[F.col(c) for c in groups + path] or [F.lit(0)]).orderBy(child).rowsBetween(Window.unboundedPreceding, -1)
        offsets = counts.select(*[F.col(c).alias(f"_k_{c}") for c in (*groups, *path, child)], F.coalesce(F.sum("_n").over(smaller), F.lit(0)).alias("_add"), (F.col("_n") > most).alias("_more"))
        offsets = cut_lineage(offsets)  # as many rows as buckets; Spark broadcasts them if they are few
        # a closed row has no child and meets no offset
        same = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in groups] + [F.col(c) == F.col(f"_k_{c}") for c in (*path, child)]
        on = same[0]
        for one in same[1:]:
            on = on & one
        rows = rows.join(offsets, on, "left").withColumn("_off", F.col("_off") + F.coalesce("_add", F.lit(0))).withColumn("_open", F.coalesce("_more", F.lit(False)))
        path.append(child)
        rows = rows.drop(*[f"_k_{c}" for c in (*groups, *path)], "_add", "_more")
        if offsets.filter("_more").isEmpty():
            break
    within = Window.partitionBy(*groups, *path).orderBy("_h")
    dealt = rows.drop("_h", "_open").repartition(*groups, *path).withColumn("_h", hashed)
    ranked = dealt.withColumn(out, (F.col("_off") + F.row_number().over(within) - 1).cast("long"))
    return ranked.drop("_h", "_off", *path)


def class_test_sizes(df: DataFrame, label: str = "label", test_fraction: float = K.TEST_FRACTION) -> DataFrame:
    """Per-class test counts: total ceil(n * f) spread proportionally (largest remainder)."""
    num, den = _as_ratio(test_fraction)
    c = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_c"))
    n = F.sum("n_c").over(Window.partitionBy(F.lit(1)))
    c = c.withColumn("n", n).withColumn("_t", F.col("n") * num + den - 1)
    c = c.withColumn("n_test", ((F.col("_t") - F.col("_t") % den) / den).cast("long"))
    prod = F.col("n_test") * F.col("n_c")
    c = c.withColumn("_r", prod % F.col("n")).withColumn("_q", ((prod - F.col("_r")) / F.col("n")).cast("long"))
    short = F.col("n_test") - F.sum("_q").over(Window.partitionBy(F.lit(1)))
    pos = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.col("_r").desc(), F.col(label)))
    c = c.withColumn("_short", short).withColumn("_pos", pos)
    return c.select(label, (F.col("_q") + F.when(F.col("_pos") <= F.col("_short"), 1).otherwise(0)).cast("long").alias("test_n"))


def _as_ratio(f: float) -> tuple[int, int]:
    from fractions import Fraction

    fr = Fraction(str(f)).limit_denominator(1000)
    return fr.numerator, fr.denominator


def stratified_split(
    df: DataFrame,
    key_cols: Sequence[str] = ("student_id", "event_id"),
    label: str = "label",
    test_fraction: float = K.TEST_FRACTION,
    seed: int = K.SEED,
    folds: int = K.N_FOLDS,
    stored: bool = False,
) -> DataFrame:
    """T6 + T7: adds ``is_test`` (class shares kept, total ceil(n*f)) and, for training
    rows, ``fold`` in 0..folds-1 (stratified, shuffled by the seeded order). ``stored`` as
    for ``hash_rank``."""
    ranked = hash_rank(df, key_cols, [label], seed, stored=stored)
    sizes = class_test_sizes(df, label, test_fraction)  # one row per class
    j = ranked.join(F.broadcast(sizes), label)
    is_test = F.col("_rank") < F.col("test_n")
    fold = F.when(~is_test, ((F.col("_rank") - F.col("test_n")) % folds).cast("int"))
    return j.withColumn("is_test", is_test).withColumn("fold", fold).drop("_rank", "test_n")


def bernoulli_sample(df: DataFrame, key_cols: Sequence[str], fractions: dict, label: str = "label", seed: int = K.SEED) -> DataFrame:
    """T6, approximate: each row is in with its class's chance, by its own seeded hash: one
    pass, no shuffle, and the same rows on every run. A class has its share of rows but for
    a standard deviation of sqrt(n f (1 - f)); classes without a fraction are left out."""
    most = F.lit(None).cast("string")
    for value, f in fractions.items():
        bound = "g" if f >= 1 else format(int(f * 2**32), "08x")  # above every hex digit
        most = F.when(F.col(label).eqNullSafe(F.lit(value)), F.lit(bound)).otherwise(most)
    return df.filter(F.substring(seeded_hash(key_cols, seed), 1, 8) < most)


def first_n_per_group(df: DataFrame, n_col: Column | int, key_cols: Sequence[str], group_cols: Sequence[str], seed: int = K.SEED) -> DataFrame:
    """Rows whose seeded rank within the group is below n."""
    n = F.lit(n_col) if isinstance(n_col, int) else n_col
    return hash_rank(df, key_cols, group_cols, seed).filter(F.col("_rank") < n).drop("_rank")


SALTS = 16


def sample_students_per_event(planned: DataFrame, students: DataFrame, n_col: str = "num_registrations", seed: int = K.SEED, block: int = 4096, salts: int = SALTS) -> DataFrame:
    """T5 + J7: for each planned event, the first ``n`` students of ONE seeded
    permutation of all students (all of them when n >= #students).

    No cross product: each event is expanded to the positions 0..n-1 it needs
    (in blocks, so a very large n is spread over tasks) and positions meet the
    ranked students in an equi-join on rank. Every event wants the first ranks, so
    the join is salted by event; only the students that some event asks for are
    repeated for the salts."""
    ranked = hash_rank(students, ["student_id"], [], seed, out="rank")
    most = planned.agg(F.max(n_col)).scalar()
    ranked = ranked.filter(F.col("rank") < most).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    pos = planned.withColumn("_nb", F.ceil(F.col(n_col) / F.lit(block)).cast("int"))
    blocks = pos.select("*", F.explode(F.sequence(F.lit(0), F.greatest(F.col("_nb") - 1, F.lit(0)))).alias("_blk"))
    blocks = blocks.filter(F.col(n_col) > 0).withColumn("_salt", F.pmod(F.xxhash64("event_id"), F.lit(salts)).cast("int"))
    lo = F.col("_blk") * F.lit(block)
    hi = F.least(lo + F.lit(block), F.col(n_col).cast("long")) - 1
    positions = blocks.select("*", F.explode(F.sequence(lo.cast("long"), hi.cast("long"))).alias("rank")).drop("_nb", "_blk")
    return positions.join(ranked, ["rank", "_salt"]).drop("_salt")
