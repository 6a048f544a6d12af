from pyspark.sql import functions as F

from rollcall.operators import sampling
from rollcall.operators.sampling import hash_rank, sample_students_per_event, stratified_split


def test_split_disjoint_complete_and_stratified(spark):
    df = spark.range(1000).select(F.col("id").cast("string").alias("k"), (F.col("id") % 4 == 0).cast("int").alias("label"))
    s = stratified_split(df, ["k"], "label").cache()
    assert s.count() == 1000 and s.select("k").distinct().count() == 1000
    test = s.filter("is_test")
    assert test.count() == 200
    assert abs(test.filter("label = 1").count() - 50) <= 1
    folds = s.filter("NOT is_test").groupBy("label", "fold").count().collect()
    per = {}
    for r in folds:
        per.setdefault(r["label"], []).append(r["count"])
    assert all(max(v) - min(v) <= 1 for v in per.values())


def test_hash_rank_is_exact_permutation(spark):
    df = spark.range(5000).select(F.col("id").cast("string").alias("k"))
    r = hash_rank(df, ["k"], [], 42, out="rank")
    got = sorted(x[0] for x in r.select("rank").collect())
    assert got == list(range(5000))
    want = sorted(str(i) for i in range(5000))
    import hashlib

    order = sorted(want, key=lambda k: hashlib.md5(f"42|{k}".encode()).hexdigest())
    ranks = {x["k"]: x["rank"] for x in r.collect()}
    assert [ranks[k] for k in order] == list(range(5000))


def test_more_registered_than_students(spark):
    students = spark.createDataFrame([(f"S{i}",) for i in range(5)], "student_id string")
    planned = spark.createDataFrame([("P1", 3), ("P2", 50)], "event_id string, num_registrations long")
    s = sample_students_per_event(planned, students)
    c = {r["event_id"]: r["count"] for r in s.groupBy("event_id").count().collect()}
    assert c == {"P1": 3, "P2": 5}


def test_buckets_split_until_they_are_small(spark):
    """Ranks of the plain md5 order, at any bucket size; null groups are a group."""
    import hashlib

    rows = [(i, ("a", "b", None)[i % 3 if i % 5 else 0]) for i in range(700)]
    df = spark.createDataFrame(rows, "k long, g string")
    want = {}
    for g in ("a", "b", None):
        for rank, k in enumerate(sorted((k for k, x in rows if x == g), key=lambda k: hashlib.md5(f"42|{k}".encode()).hexdigest())):
            want[k] = rank
    for digits, most in ((1, 1), (1, 20), (2, 3), (3, 1000)):
        old = sampling.BUCKET_HEX_DIGITS
        sampling.BUCKET_HEX_DIGITS = digits
        try:
            got = {r["k"]: r["r"] for r in sampling.hash_rank(df, ["k"], ["g"], 42, out="r", most=most).collect()}
        finally:
            sampling.BUCKET_HEX_DIGITS = old
        assert got == want
    whole = {r["k"]: r["r"] for r in sampling.hash_rank(df, ["k"], [], 42, out="r", most=10).collect()}
    assert sorted(whole.values()) == list(range(700))
