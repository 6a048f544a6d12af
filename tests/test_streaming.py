import os
import tempfile

from pyspark.sql import functions as F

from rollcall.streaming.ingest import start_ingest


def test_stream_ingest_is_incremental_and_idempotent(spark):
    from tests.conftest import SF0001
    from rollcall.sources.fixtures import registrations_flat

    root = tempfile.mkdtemp(prefix="rollcall-stream-")
    src, tables, ckpt = (os.path.join(root, d) for d in ("in", "star", "ckpt"))
    flat = registrations_flat(spark, SF0001).withColumn("event_date", F.date_format("event_date", "yyyy-MM-dd")).cache()
    early = flat.filter("event_date < '2024-12-01'")
    flat.limit(0).write.option("header", True).csv(src)  # empty folder with the layout
    early.coalesce(1).write.mode("append").option("header", True).csv(src)
    q = start_ingest(spark, src, tables, ckpt, once=True)
    q.awaitTermination(300)
    n1 = spark.read.parquet(f"{tables}/registrations").count()
    assert n1 == early.count()
    # new file with everything (overlaps the first): only unseen registrations are appended
    flat.coalesce(1).write.mode("append").option("header", True).csv(src)
    q = start_ingest(spark, src, tables, ckpt, once=True)
    q.awaitTermination(300)
    regs = spark.read.parquet(f"{tables}/registrations")
    assert regs.count() == flat.count() == regs.select("student_id", "event_id").distinct().count()
    students = spark.read.parquet(f"{tables}/students")
    assert students.count() == students.select("student_id").distinct().count() == flat.select("student_id").distinct().count()
    assert spark.read.parquet(f"{tables}/events").count() == flat.select("event_id").distinct().count()
