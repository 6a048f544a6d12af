from pyspark.sql import functions as F

from rollcall.llm.warc import with_revisits


def test_payloads_are_not_sorted(spark):
    pages = spark.range(50).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.repeat((F.col("id") % 7).cast("string"), 200).alias("html"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        p = with_revisits(pages)
        plan = p._jdf.queryExecution().executedPlan().toString()
        assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
        assert {r["page_id"]: r["refers_to"] for r in p.collect()} == {i: None if i < 7 else i % 7 for i in range(50)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
