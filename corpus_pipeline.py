"""Corpus pipeline: good documents, one of each group of near copies, without benchmark
items and personal data, packed into sequences.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return
the columns of ``documents``. Stages keep extra columns, whatever their names, work on all
rows that they are given, and give an empty result for an empty table. Of documents with
equal ids (or none) each row is judged on its own, but a contaminated id goes with all its
rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.llm import decontaminate, ngram_join, packing, pii, quality
from rollcall.llm.common import numbered, scratch, stored, table

#: Near copies: word shingles and the likeness from which two documents are linked.
NEAR_WORDS, NEAR_NUM, NEAR_DEN = 5, 80, 100


def _inside(docs: DataFrame) -> DataFrame:
    """doc_id, text and all other columns under names that no operator uses."""
    return docs.select(*[F.col(f"`{c}`").alias(c if c in ("doc_id", "text") else f"_given_{i}") for i, c in enumerate(docs.columns)])


def _outside(rows: DataFrame, docs: DataFrame, **new: Column) -> DataFrame:
    """The columns of ``docs`` again, some of them with new values."""
    given = {c: F.col(c if c in ("doc_id", "text") else f"_given_{i}") for i, c in enumerate(docs.columns)}
    return rows.select(*[new.get(c, v).alias(c) for c, v in given.items()])


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier gives the top grade."""
    weights, cuts = quality.model(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    out = quality.scored(_inside(docs), weights, cuts)
    return _outside(out.filter(F.col("p_top") >= quality.LEAST), docs)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of exact or near copies."""
    inside = _inside(docs)
    rows = numbered(inside, *inside.columns)
    groups = ngram_join.classes(rows.select(F.col("row_id").alias("doc_id"), "text"), NEAR_WORDS, NEAR_NUM, NEAR_DEN)
    first = groups.filter("row_id = component").select("row_id")
    return _outside(rows.join(first, "row_id", "left_semi"), docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    inside = _inside(docs)
    found = decontaminate.contained(inside, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("bad_id")).distinct()
    return _outside(inside.join(found, inside.doc_id.eqNullSafe(found.bad_id), "left_anti"), docs)


def without_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind."""
    full = _inside(docs).withColumn("_null", F.col("text").isNull()).withColumn("text", F.coalesce("text", F.lit("")))
    found = pii.find_pii(full)
    every = F.concat(*[F.col(f"pii_{k}") for k in pii.PATTERNS])
    found = found.withColumn("_new", F.when(F.col("_null"), None).otherwise(pii.redacted(F.col("text"), every)))
    new = {"text": F.col("_new")}
    if "n_chars" in docs.columns:
        given = F.col(f"_given_{docs.columns.index('n_chars')}")
        new["n_chars"] = F.coalesce(F.length("_new").cast("long"), given)
    return _outside(found, docs, **new)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 tokens."""
    return packing.op2_packing(docs)


STAGES = [
    ("quality classifier", good),
    ("n-gram Jaccard join", distinct),
    ("benchmark decontamination", uncontaminated),
    ("PII", without_pii),
    ("packing", sequences),
]

#: A fitted classifier and a tokenizer have no SQL; the stages are tested against
#: brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; what a stage returns is stored for the next one, and
    what it has stored itself goes then."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1], 1):
        with scratch(spark):
            docs = stored(stage(spark, docs, sf_dir), f"stage{k}", keep=True)
    return STAGES[-1][1](spark, docs, sf_dir)
