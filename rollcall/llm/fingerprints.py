"""Document fingerprints: threshold-scaled sketch of word shingles, in DataFrame
functions only.

Every shingle hash below a fixed fraction of the hash range is kept, so the sketch
grows with the text: sketches of parts can be merged, and very unequal texts can be
compared by containment. A text whose sketch would hold fewer than ``LEAST`` hashes
keeps its ``LEAST`` smallest ones instead; such a sketch is complete up to its
largest hash, and two sketches are compared below the smaller of their two bounds.

Defined results: a null text counts as empty; a text without words has an empty
sketch, equal to that of any other such text (likeness 1) and unlike every other
(likeness 0); with fewer words than a shingle the whole text is its only shingle;
repeated rows are documents of their own, ordered by id and then text. Extra columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollcall.llm.common import ascii_lower, shingle_hashes, words

#: Words of a shingle, the fraction of the hash range that is kept (1 / SCALE), and
#: the hashes that even a short text keeps.
WORDS, SCALE, LEAST = 5, 8, 64
_LOW = -(2**63)


def bound(scale: int) -> int:
    """Largest hash that a sketch of this scale keeps."""
    return _LOW + 2**64 // scale - 1


def shingles(text: Column, n: int = WORDS) -> Column:
    """Distinct shingle hashes of a text; words in lower case (A-Z)."""
    return F.transform(words(ascii_lower(text)), lambda w: F.xxhash64(w))


def with_sketch(df: DataFrame, text: str, out: str, n: int = WORDS, scale: int = SCALE, least: int = LEAST) -> DataFrame:
    """Add the sketch of a text column as a sorted array of distinct hashes."""
    h, g, low = f"{out}_h", f"{out}_g", f"{out}_low"
    df = df.withColumn(h, shingles(F.col(text), n))
    df = df.withColumn(g, shingle_hashes(F.col(h), n)).drop(h)
    df = df.withColumn(low, F.sort_array(F.array_distinct(F.filter(g, lambda x: x <= bound(scale)))))
    all_of = F.slice(F.sort_array(F.array_distinct(F.col(g))), 1, least)
    return df.withColumn(out, F.when(F.size(low) >= least, F.col(low)).otherwise(all_of)).drop(g, low)


def merged(a: Column, b: Column, scale: int = SCALE, least: int = LEAST) -> Column:
    """Sketch of two texts' shingles together, from their sketches alone."""
    both = F.sort_array(F.array_union(a, b))
    low = F.filter(both, lambda x: x <= bound(scale))
    return F.when(F.size(low) >= least, low).otherwise(F.slice(both, 1, least))


def _limit(a: Column, scale: int, least: int) -> Column:
    """The sketch holds every hash of its text up to this one."""
    whole = F.size(a) < least  # it has all hashes of its text
    return F.when(whole, F.lit(2**63 - 1)).otherwise(F.greatest(F.lit(bound(scale)), F.get(a, F.size(a) - 1)))


def _compared(a: Column, b: Column, scale: int, least: int) -> tuple[Column, Column, Column]:
    """Numbers of common hashes and of each side's hashes below the common limit."""
    limit = F.least(_limit(a, scale, least), _limit(b, scale, least))
    count = lambda x: F.size(F.filter(x, lambda v: v <= limit))
    return count(F.array_intersect(a, b)), count(a), count(b)


def likeness(a: Column, b: Column, scale: int = SCALE, least: int = LEAST) -> Column:
    """Estimated Jaccard likeness of two texts from their sketches, 0 to 1."""
    common, x, y = _compared(a, b, scale, least)
    return F.when(a == b, F.lit(1.0)).otherwise(F.coalesce(F.try_divide(common.cast("double"), (x + y - common).cast("double")), F.lit(0.0)))


def containment(a: Column, b: Column, scale: int = SCALE, least: int = LEAST) -> Column:
    """Estimated share of the first text's shingles that the second holds."""
    common, x, _ = _compared(a, b, scale, least)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.coalesce(F.try_divide(common.cast("double"), x.cast("double")), F.lit(0.0)))


def as_text(sketch: Column) -> Column:
    """Sketch as a string: 16 hexadecimal digits for each hash, comma-joined."""
    return F.array_join(F.transform(sketch, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), ",")


def range_bounds(df: DataFrame, key: str, buckets: int) -> list:
    """Keys that cut the rows into about equal buckets, each the smallest of its
    bucket: from a quantile sketch, at most ``buckets`` values."""
    share = [i / buckets for i in range(1, buckets)] or [0.5]
    cuts = df.agg(F.percentile_approx(key, share, max(10_000, 20 * buckets)).alias("cuts")).first()["cuts"]
    if not cuts:
        return []
    # the sketch rounds large keys, so the bounds are set to keys that exist
    found = df.select(F.col(key).alias("k"), _bucket(F.col(key), sorted(set(cuts))).alias("b")).groupBy("b").agg(F.min("k").alias("k"))
    return sorted(r["k"] for r in found.collect())


def _bucket(key: Column, bounds: list) -> Column:
    """Number of the bucket that a key falls in; looked up in two steps, so a row is
    compared with about twice the square root of the number of bounds."""
    step = max(1, int(len(bounds) ** 0.5))
    tops = F.array(*[F.lit(b) for b in bounds[::step]])
    blocks = F.array(*[F.array(*[F.lit(b) for b in bounds[i: i + step]]) for i in range(0, len(bounds), step)])
    top = F.greatest(F.size(F.filter(tops, lambda b: b <= key)) - 1, F.lit(0))
    return F.greatest(top * step + F.size(F.filter(F.get(blocks, top), lambda b: b <= key)) - 1, F.lit(0))


def with_next(df: DataFrame, key: str, carry: list[str], buckets: int | None = None) -> DataFrame:
    """Add ``next_<c>`` of the next row by (key, carry[0]); the first row follows the
    last. One shuffle, no global sort: rows go to buckets of the key, and each
    bucket's first row is sent to the bucket before as well, where it closes it.
    ``key`` must not be null."""
    spark = df.sparkSession
    n = buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = range_bounds(df, key, n)
    if not bounds:
        return df.select("*", *[F.col(c).alias(f"next_{c}") for c in carry])
    last = len(bounds) - 1
    own = _bucket(F.col(key), bounds)
    df = df.withColumn("_b", own)
    # copies of a bucket's first key go to the bucket before, where only the first
    # of them is looked at; the smallest key follows the largest bucket
    is_first = F.array_contains(F.array(*[F.lit(b) for b in bounds]), F.col(key))
    before = F.when(F.col("_b") == 0, F.lit(last)).otherwise(F.col("_b") - 1)
    place = F.when(is_first, F.array(F.struct(F.col("_b").alias("b"), F.lit(0).alias("ghost")), F.struct(before.alias("b"), F.lit(1).alias("ghost")))).otherwise(F.array(F.struct(F.col("_b").alias("b"), F.lit(0).alias("ghost"))))
    rows = df.withColumn("_p", F.explode(place))
    w = Window.partitionBy("_p.b").orderBy("_p.ghost", key, carry[0])
    return rows.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in carry]).filter("_p.ghost = 0").drop("_b", "_p")


def fingerprints(docs: DataFrame, n: int = WORDS, scale: int = SCALE, least: int = LEAST) -> DataFrame:
    """One row per document: its sketch, the next document's and the edited text's,
    and how alike they are."""
    missing = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # a null id is kept as the smallest one and turned back at the end
    keyed = missing.withColumn("k", F.coalesce("doc_id", F.lit(_LOW)))
    chained = with_next(with_sketch(keyed, "text", "sketch", n, scale, least), "k", ["text", "sketch"])
    chars = F.length("text")
    cut = F.floor(chars / 2)
    edited = F.concat(F.substring("text", F.lit(1), (chars - cut).cast("int")), F.substring("next_text", F.lit(1), cut.cast("int")))
    chained = chained.withColumn("n_chars", chars.cast("long")).withColumn("edited", edited).drop("text", "next_text")
    return with_sketch(chained, "edited", "edited_sketch", n, scale, least)


def op9_document_fingerprints(docs: DataFrame) -> DataFrame:
    f = fingerprints(docs)
    return f.select(
        "doc_id",
        "n_chars",
        F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        as_text(F.col("sketch")).alias("fingerprint"),
        as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
        containment(F.col("edited_sketch"), F.col("sketch")).alias("edited_in_document"),
    )
