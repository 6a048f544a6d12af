"""Benchmark decontamination: short test items inside long documents, in DataFrame
functions only.

An item with m distinct shingles is contained when at least ``SHARE`` of them are in the
document, so at most ``m - ceil(SHARE m)`` are missing, and any
``m - ceil(SHARE m) + 1`` of its shingles include one that is there. The MinHash sketch
of an item is its smallest shingle hashes, of just that length: items are partitioned by
size, and the size sets the length. A document that holds no sketch hash contains no
item; one that does is a candidate for the items of those hashes, and the candidate is
verified by the exact share of the item's shingles in the document. Nothing is lost and
no document is compared with items that it shares nothing with.

The sketches are broadcast only while their number is at most ``MOST`` hashes, which is
counted first; a larger benchmark is joined by hash, with a shuffle of the documents'
shingle hashes.

Defined results: null or blank documents contain nothing; null or blank items are
contained in nothing; a document or item with fewer words than a shingle has one shingle,
the whole; equal items are reported each; rows of either table are judged each on its
own, also where ids are null or repeated, and a pair of ids is reported once, with the
largest containment among its rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.llm.common import ascii_lower, numbered, shingle_hashes, words

#: Words of a shingle, share of an item's shingles, sketch hashes that are broadcast.
WORDS, SHARE, MOST = 5, 0.8, 500_000


def with_shingles(df: DataFrame, text: str, out: str, n: int) -> DataFrame:
    """Add the shingle hashes of a text, in order, with repeats."""
    df = df.withColumn(f"{out}_w", F.transform(words(ascii_lower(F.col(text))), lambda w: F.xxhash64(w)))
    return df.withColumn(out, shingle_hashes(F.col(f"{out}_w"), n)).drop(f"{out}_w")


def _least(m: Column, share: float) -> Column:
    """Shingles that must be in the document (share as a ratio of thousandths, so that
    no rounding of a product moves it)."""
    return F.ceil((m * round(share * 1000)) / F.lit(1000))


def _by_row(df: DataFrame, key: str, row: str) -> DataFrame:
    """Table of (key, text) with a number of its own for each row, for keys of any type."""
    keyed = df.select(F.xxhash64(key).alias("doc_id"), "text", F.col(key).alias("key"))
    return numbered(keyed, "doc_id", "text", "key").select(F.col("row_id").alias(row), F.col("key").alias(key), "text")


def item_sketches(items: DataFrame, n: int, share: float) -> DataFrame:
    """(item_row, item_id, size, needed, grams, sketch): sketch is the smallest hashes, as many
    as the size asks for."""
    # blank items are left out by their text: a filter on the hashes would be pushed
    # below them and would work them out once for each word. For the same reason arrays
    # are exploded with explode_outer, which asks for no filter on their size
    written = items.filter(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    g = with_shingles(_by_row(written, "item_id", "item_row"), "text", "all_grams", n)
    g = g.withColumn("grams", F.sort_array(F.array_distinct("all_grams")))
    g = g.withColumn("size", F.size("grams")).withColumn("needed", _least(F.col("size"), share).cast("int"))
    return g.withColumn("sketch", F.slice("grams", F.lit(1), F.col("size") - F.col("needed") + 1)).select("item_row", "item_id", "size", "needed", "grams", "sketch")


def contained(docs: DataFrame, items: DataFrame, n: int = WORDS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(doc_id, item_id, n_item, n_shared, containment) of every contained item."""
    sketches = item_sketches(items, n, share)
    keys = sketches.select("item_row", "size", "needed", F.explode_outer("sketch").alias("h"))
    few = keys.count() <= most
    held = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    whole = sketches.select("item_row", "item_id", F.col("grams").alias("item_grams"))
    if few:
        g = with_shingles(held, "text", "grams_of_doc", n).select("doc_id", "grams_of_doc")
        # the hashes of all sketches as one array: a document is looked through once,
        # and only its sketch hashes are joined with items
        every = keys.agg(F.collect_set("h").alias("every"))
        hit = g.crossJoin(F.broadcast(every)).withColumn("hits", F.array_intersect("grams_of_doc", "every")).filter(F.size("hits") > 0)
        hit = hit.select("doc_id", "grams_of_doc", F.explode_outer("hits").alias("h"))
        pairs = hit.join(F.broadcast(keys), "h").join(F.broadcast(whole), "item_row")
    else:
        g = with_shingles(_by_row(held, "doc_id", "doc_row"), "text", "grams_of_doc", n).select("doc_row", "doc_id", "grams_of_doc")
        hashes = g.select("doc_row", F.explode_outer(F.array_distinct("grams_of_doc")).alias("h"))
        found = hashes.join(keys, "h").select("doc_row", "item_row", "size", "needed").distinct()
        pairs = found.join(g, "doc_row").join(whole, "item_row")
    shared = F.size(F.array_intersect("item_grams", "grams_of_doc"))
    pairs = pairs.select("doc_id", "item_id", "size", "needed", shared.alias("shared"))
    pairs = pairs.filter(F.col("shared") >= F.col("needed"))
    most_held = F.max(F.struct((F.col("shared") / F.col("size")).alias("containment"), "size", "shared")).alias("best")
    best = pairs.groupBy("doc_id", "item_id").agg(most_held)
    return best.select("doc_id", "item_id", F.col("best.size").cast("long").alias("n_item"), F.col("best.shared").cast("long").alias("n_shared"), "best.containment")


def op8_benchmark_decontamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    return contained(docs, items)


ORACLE = r"""
with t as (select 'd' as k, doc_id as id, text from documents union all select 'i', item_id, text from benchmark),
     w as (select k, id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x != '') as w from t),
     g as (select distinct k, id, case when len(w) >= 5 then array_to_string(w[i + 1 : i + 5], ' ') else array_to_string(w, ' ') end as gram
           from w, unnest(range(0, case when len(w) >= 5 then len(w) - 4 when len(w) > 0 then 1 else 0 end)) as u(i)),
     m as (select id as item_id, count(*) as n_item from g where k = 'i' group by 1),
     p as (select d.id as doc_id, i.id as item_id, count(*) as n_shared from g d join g i using (gram) where d.k = 'd' and i.k = 'i' group by 1, 2)
select doc_id, item_id, n_item::bigint as n_item, n_shared::bigint as n_shared, n_shared / n_item as containment
from p join m using (item_id) where 10 * n_shared >= 8 * n_item
"""
