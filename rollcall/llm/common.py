"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space between words, as a Java regular expression: ASCII only.
SPACE = r"[\x20\x09-\x0D]+"

#: Rows in one Arrow batch. Texts are long, so the default of 10,000 rows would
#: let a batch reach hundreds of megabytes.
ARROW_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``). Only where the
    setting is absent, as in tests, a fresh local folder is made and set."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        configured = spark.sparkContext.getCheckpointDir()
    if not configured:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="rollcall-llm-")
        spark.sparkContext.setCheckpointDir(configured)
    return configured


#: Spark's own setting to remove the shuffle files of a query when it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Rows that a task of a narrow intermediate table takes at least.
NARROW_ROWS = 250_000


#: Folders that open ``scratch`` blocks have to delete, innermost last.
_scopes: contextvars.ContextVar[tuple[list[str], ...]] = contextvars.ContextVar("scopes", default=())


def stored(df: DataFrame, name: str, rows: int | None = None, keep: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a reliable cut of the
    lineage that any executor can reread after a loss. What was shuffled for it is not
    needed any more, and its files go at once. ``rows``, a bound on the rows of a narrow
    table where it is known, keeps a small table from being dealt over many tasks.
    Inside a ``scratch`` block the table goes at the block's end, with ``keep`` at the end
    of the block around it."""
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(12, -(-rows // NARROW_ROWS)))
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    scopes = _scopes.get()[: -1 if keep else None]
    if scopes:
        scopes[-1].append(path)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[..., DataFrame]]:
    """Tables that ``stored`` writes inside the block, and operators called in it, are
    deleted at its end. What is returned must be read from tables that are kept."""
    paths: list[str] = []
    token = _scopes.set((*_scopes.get(), paths))
    try:
        yield stored
    finally:
        _scopes.reset(token)
        conf = spark._jsparkSession.sessionState().newHadoopConf()
        for place in paths:
            path = spark._jvm.org.apache.hadoop.fs.Path(place)
            path.getFileSystem(conf).delete(path, True)


def in_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches handed to Python by rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def words(text: Column) -> Column:
    """Words of a text: maximal runs of other than ASCII white space; a null text
    has none. ``split`` leaves empty strings at the ends, which are removed."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE, -1), lambda w: w != "")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_hashes(word_hashes: Column, n: int) -> Column:
    """64-bit hashes of the runs of ``n`` words, in order and with repeats; with
    fewer words the whole run is the only one; without words there is none."""
    k = F.size(word_hashes)
    runs = F.transform(
        F.sequence(F.lit(1), k - n + 1),
        lambda i: F.xxhash64(*[F.get(word_hashes, i + (j - 1)) for j in range(n)]),
    )
    whole = F.array(F.xxhash64(word_hashes))
    return F.when(k >= n, runs).when(k > 0, whole).otherwise(F.array().cast("array<bigint>"))


def numbered(docs: DataFrame, *more: str) -> DataFrame:
    """Documents with ``row_id``: the id itself, where it is unique and not null; other
    rows are numbered behind each other in the order of (id, words). Row ids order
    documents as their ids do. Without ``more`` columns the result has doc_id and text,
    a null text as an empty one; with them it has those, as they are."""
    keep = more or ("doc_id", "text")
    base = docs.select(*more) if more else docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    odd = base.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 or doc_id is null").limit(1).count()
    if not odd:
        return base.withColumn("row_id", F.col("doc_id").cast("long"))
    # rare: ids that occur more than once. Ranks are found within buckets of the id
    # and added up over the buckets, never in one task
    digest = F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256)
    # equal rows are told apart by a number that is stored with them
    keyed = base.withColumn("_d", digest).withColumn("_m", F.monotonically_increasing_id())
    order = [F.col("doc_id").asc_nulls_first(), F.col("_d"), F.col("_m")]
    parts = stored(keyed.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), "numbered")
    sizes = {r["_p"]: r["n"] for r in parts.groupBy("_p").agg(F.count("*").alias("n")).collect()}
    before, total = {}, 0
    for p in sorted(sizes):
        before[p], total = total, total + sizes[p]
    starts = F.create_map(*[F.lit(x) for p in before.items() for x in p]) if before else F.lit(0)
    rank = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return parts.withColumn("row_id", (starts[F.col("_p")] + rank).cast("long")).select(*keep, "row_id")
