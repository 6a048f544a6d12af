"""Incremental registration ingest with Structured Streaming.

The original tool loads a flat registration file into the star tables, inserting
only dimension keys it has not seen and skipping registrations already loaded.
Here new flat files dropped into a folder are picked up by a file stream and each
micro-batch is merged into the star tables (students, events, registrations):

* dimension rows: ``merge_new_dimension_rows`` (left-anti on the key) and append;
* registrations: left-anti on (student_id, event_id), so a replayed micro-batch
  after a failure appends nothing twice (idempotent sink);
* the stream's checkpoint lives in the shared checkpoint folder.

Nothing here is stateful across batches except the target tables themselves.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.sources.tables import (
    REGISTRATION_FLAT,
    merge_new_dimension_rows,
    normalise_events,
    normalise_students,
    parse_event_date,
    project_registrations,
)


def _existing(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def merge_batch(batch: DataFrame, table_dir: str) -> dict[str, int]:
    """Merge one batch of flat rows into the star tables; returns rows appended."""
    spark = batch.sparkSession
    flat = batch.withColumn("event_date", parse_event_date(F.col("event_date"), lenient=True)).persist()
    out = {}
    for name, rows, key in (
        ("students", normalise_students(flat), ["student_id"]),
        ("events", normalise_events(flat), ["event_id"]),
        ("registrations", project_registrations(flat).dropDuplicates(["student_id", "event_id"]), ["student_id", "event_id"]),
    ):
        path = f"{table_dir}/{name}"
        current = _existing(spark, path)
        new = rows if current is None else (
            merge_new_dimension_rows(rows, current, key[0]) if len(key) == 1 else rows.join(current.select(*key), key, "left_anti")
        )
        new = new.persist()
        out[name] = new.count()
        if out[name]:
            new.write.mode("append").parquet(path)
        new.unpersist()
    flat.unpersist()
    return out


def start_ingest(spark: SparkSession, source_dir: str, table_dir: str, checkpoint: str | None = None, once: bool = False):
    """Start the file stream (CSV with header, declared schema). ``once`` processes
    what is there and stops (``availableNow``)."""
    from rollcall.session import ensure_checkpoint_dir

    checkpoint = checkpoint or f"{ensure_checkpoint_dir(spark).rstrip('/')}/rollcall_ingest"
    stream = spark.readStream.schema(REGISTRATION_FLAT).option("header", True).csv(source_dir)
    writer = stream.writeStream.foreachBatch(lambda df, _bid: merge_batch(df, table_dir)).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 minute")
    return writer.start()
