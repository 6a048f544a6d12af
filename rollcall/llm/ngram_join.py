"""N-gram Jaccard join: groups of documents whose sets of word n-grams are alike, by a
blocked product of the document by n-gram incidence matrix. The result is exact.

Rows of the matrix are documents, columns n-gram hashes. Documents with equal rows are
one row (a class). Two rows a and b are linked when
``den * |a & b| >= num * |a | b|``; then the sizes alone bound how many columns differ:
at most D = 2r(den - num) / (den + num) for rows of at most r n-grams. So the columns
are cut into blocks, more than D for each size class, and a linked pair must agree
completely in some block that is not empty. A block of a row is one signature, and

1. blocks that several different rows share are found by an aggregate over all
   signatures. A block of a few n-grams is seldom equal by chance, however common a
   single n-gram is: a common line or passage makes no hot column;
2. products are taken only for pairs that share a block. Rows first meet the smallest
   row of their most shared blocks, then the components so found. Pairs inside a
   component decide nothing and are skipped, so a large group of near copies costs
   about as many products as it has rows;
3. what is left, pairs of different components, is multiplied out n-gram by n-gram, for
   the rows only that still share as many blocks and then n-grams with other components
   as a link needs. Columns are the rarest such n-grams of a row, as many as a linked row
   cannot miss all; by its place in a row's order of columns each bounds the overlap that
   is left, and with it the sizes of the rows it may be linked to. Rows meet only in
   columns and size bands that both bounds allow, so a column that very many near copies
   share is multiplied only for those of them that can have a link elsewhere.

A row with more empty blocks than its class allows for adds the n-grams of its prefix
(its smallest hashes) as signatures; two such rows meet there.

Defined results: null, empty and blank texts have an empty set, linked with nothing,
each its own component; fewer than ``n`` words make one n-gram of the whole sequence;
equal texts are linked; repeated or null ids are rows of their own, ordered by (id,
text); extra columns are ignored.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.llm import kernels as K
from rollcall.llm.common import in_batches, numbered, scratch, stored
from rollcall.llm.components import components, joined

#: Words of an n-gram and the threshold as a ratio.
WORDS, NUM, DEN = 4, 85, 100
#: Size classes grow by this; rounds in which rows meet single rows of a component, and
#: how many rows they meet in a round.
GROWTH, ROUNDS, MEET = 1.5, 2, 4
#: One more block for so many that may differ: with too few, blocks of a single n-gram,
#: which are equal by chance, would make up what a link needs.
SPARE = 5
#: Ratio of neighbouring size bands in which rows meet in a column.
BAND = 1.02
#: Pairs of different components, to rows, from which a block, and all such blocks together,
#: are worth rounds.
CROWD = 8


def class_of(size: int) -> tuple[int, int]:
    """Number and largest size of the class of a set size."""
    number, top = 0, 1
    while top < size:
        number, top = number + 1, max(top + 1, int(top * GROWTH))
    return number, top


@functools.lru_cache(256)
def class_top(number: int) -> int:
    """Largest size of a class."""
    top = 1
    for _ in range(number):
        top = max(top + 1, int(top * GROWTH))
    return top


def blocks_of(top: int, num: int, den: int) -> tuple[int, int]:
    """Number of blocks of a class and how many empty ones it allows for; (0, 0) if
    only equal sets can be linked."""
    differ = 2 * top * (den - num) // (den + num)
    if not differ:
        return 0, 0
    spare = 0 if differ < 2 else 1 + differ // SPARE
    return differ + 1 + spare, spare


def class_blocks(size: int, num: int, den: int):
    """Yield (class, blocks) of each size class in which a set meets linked ones as large
    or larger; classes of equal sets only are left out."""
    first, top = class_of(size)
    last, _ = class_of(size * den // num)
    for number in range(first, last + 1):
        k, _ = blocks_of(top, num, den)
        if k:
            yield number, k
        top = max(top + 1, int(top * GROWTH))


def blocks_in(grams: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Blocks of a set that are not empty, and the sums of their mixed hashes."""
    block = ((grams >> K.U64(17)) % K.U64(k)).astype(np.int64)
    order = np.argsort(block, kind="stable")
    block = block[order]
    at = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
    return block[at], np.add.reduceat(K.mix(grams[order] ^ K.U64(0x5851F42D4C957F2D)), at)


def marked_signatures(grams: np.ndarray, num: int, den: int):
    """Signatures of a set in each of its size classes: (hashes, blocks of the class,
    blocks that are not empty)."""
    size = len(grams)
    for number, k in class_blocks(size, num, den):
        place, total = blocks_in(grams, k)
        hashes = K.mix(total + (place.astype(K.U64) << K.U64(20)) + K.U64((number + 1) << 50))
        spare = k - 2 * class_top(number) * (den - num) // (den + num) - 1
        if k - len(place) > spare:
            prefix = np.sort(grams)[: size - -(-size * num // den) + 1]
            hashes = np.r_[hashes, K.mix(prefix ^ K.U64(0xA24BAED4963EE407 + number))]
        yield hashes, k, len(place)


def signatures(grams: np.ndarray, num: int, den: int):
    """Signatures of a set and how many equal ones a linked set has at least: (hashes,
    needed) for each of its size classes."""
    for hashes, k, filled in marked_signatures(grams, num, den):
        number = next(c for c, blocks in class_blocks(len(grams), num, den) if blocks == k)
        yield hashes, max(1, filled - 2 * class_top(number) * (den - num) // (den + num))


def class_rows(docs: DataFrame, n: int) -> DataFrame:
    """(row_id, doc_id, n, key): size and 128-bit hash of each document's set."""

    def rows(batches):
        for batch in batches:
            size, key = [], []
            for _, data, offsets in K.groups(batch.column("text")):
                words, counts = K.word_hashes(data, offsets, lower=True)
                for g in K.sets_of_grams(words, counts, n):
                    size.append(len(g))
                    key.append(xxhash.xxh3_128_digest(g.tobytes()) if len(g) else None)
            yield pa.RecordBatch.from_arrays([batch.column("row_id"), batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(key, pa.binary())], ["row_id", "doc_id", "n", "key"])

    return docs.mapInArrow(rows, "row_id long, doc_id long, n long, key binary")


def signature_rows(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """(sig, row_id, key, k, need) of every document: its signatures with the number of
    blocks of the class and how many equal ones any linked row has."""
    names = ["sig", "row_id", "key", "k", "need"]

    def rows(batches):
        for batch in batches:
            ids = batch.column("row_id").to_numpy()
            for row, data, offsets in K.groups(batch.column("text")):
                words, counts = K.word_hashes(data, offsets, lower=True)
                sig, rep, reps = [], [], []
                for i, g in enumerate(K.sets_of_grams(words, counts, n)):
                    if not len(g):
                        continue
                    key = xxhash.xxh3_64_intdigest(g.tobytes())
                    differ = (len(g) + len(g) * den // num) * (den - num) // (den + num)
                    for hashes, k, filled in marked_signatures(g, num, den):
                        sig.append(hashes)
                        rep.append(len(hashes))
                        reps.append((ids[row + i], key, k, max(1, filled - differ)))
                if not sig:
                    continue
                times = np.array(rep)
                cols = [np.concatenate(sig).view(np.int64)]
                for j, kind in enumerate((np.int64, np.uint64, np.int32, np.int32)):
                    cols.append(np.repeat(np.array([r[j] for r in reps], kind), times))
                cols[2] = cols[2].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names)

    return docs.mapInArrow(rows, "sig long, row_id long, key long, k int, need int")


def gram_sets(docs: DataFrame, n: int) -> DataFrame:
    """(row_id, grams) of documents."""

    def rows(batches):
        for batch in batches:
            ids = batch.column("row_id")
            for row, data, offsets in K.groups(batch.column("text")):
                words, counts = K.word_hashes(data, offsets, lower=True)
                sets = [g.view(np.int64) for g in K.sets_of_grams(words, counts, n)]
                yield pa.RecordBatch.from_arrays([ids.slice(row, len(sets)), pa.array(sets, pa.list_(pa.int64()))], ["row_id", "grams"])

    return docs.mapInArrow(rows, "row_id long, grams array<long>")


def block_rows(sets: DataFrame, num: int, den: int) -> DataFrame:
    """(row_id, n, cls, blocks): a row's blocks in each of its size classes, as 32-bit
    hashes, 0 for an empty block."""

    def rows(batches):
        for batch in batches:
            out = []
            for row, grams in zip(batch.column("row_id").to_pylist(), batch.column("grams")):
                g = np.asarray(grams.values).view(K.U64)
                for number, k in class_blocks(len(g), num, den):
                    place, total = blocks_in(g, k)
                    blocks = np.zeros(k, np.int32)
                    blocks[place] = (K.mix(total) >> K.U64(32)).astype(np.uint32).view(np.int32)
                    out.append((row, len(g), number, blocks))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int32())))], ["row_id", "n", "cls", "blocks"])

    return sets.mapInArrow(rows, "row_id long, n int, cls int, blocks array<int>")


def linked(pairs: DataFrame, blocks: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Of pairs (a, b) those that are linked. First the product over blocks: a pair in
    which more blocks differ than n-grams may by the two sizes is discarded (a hash
    that is equal by chance only lets a pair pass). Then the exact overlap."""
    a, b = (blocks.select(F.col("row_id").alias(x), F.col("n").alias(f"n{x}"), "cls", F.col("blocks").alias(f"k{x}")) for x in "ab")
    both = pairs.join(a, "a").join(b, ["b", "cls"])
    differ = F.size(F.filter(F.zip_with("ka", "kb", lambda x, y: x != y), lambda x: x))
    near = both.filter(differ * (den + num) <= (F.col("na") + F.col("nb")) * (den - num)).select("a", "b").distinct()
    near = stored(near, "join-near")
    a, b = (sets.select(F.col("row_id").alias(x), F.col("grams").alias(f"g{x}")) for x in "ab")
    exact = near.join(a, "a").join(b, "b").withColumn("i", F.size(F.array_intersect("ga", "gb")))
    return exact.filter(F.col("i") * den >= num * (F.size("ga") + F.size("gb") - F.col("i"))).select("a", "b")


def _sizes_fit(x, y, num: int, den: int):
    return (F.least(x, y) * den) >= (F.greatest(x, y) * num)


def _enough(hits: DataFrame) -> DataFrame:
    """Of rows' signatures (row_id, k, need, sig) those of rows that have as many as a
    link needs, as arrays."""
    return hits.groupBy("row_id", "k").agg(F.first("need").alias("need"), F.collect_list("sig").alias("sigs")).filter(F.size("sigs") >= F.col("need"))


def _one_by_one(rows: DataFrame, *more: str) -> DataFrame:
    return rows.select("row_id", "k", "need", *more, F.explode("sigs").alias("sig"))


def _labelled(rows: DataFrame, label: DataFrame) -> DataFrame:
    """``rows`` with the component c of each; a row without links is its own."""
    return rows.join(label.select(F.col("node").alias("row_id"), F.col("component").alias("c")), "row_id", "left").withColumn("c", F.coalesce("c", "row_id"))


def _apart(rows: DataFrame) -> DataFrame:
    """Of labelled rows those that share enough blocks with other components, with these
    blocks in an order that is the same for all rows: rare ones first."""
    by_block = _one_by_one(rows, "c")
    spread = by_block.groupBy("sig").agg(F.count("*").alias("many"), F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo != hi").select("sig", "many")
    rows = by_block.join(spread, "sig").groupBy("row_id", "k").agg(F.first("need").alias("need"), F.first("c").alias("c"), F.sort_array(F.collect_list(F.struct("many", "sig"))).alias("s"))
    return rows.filter(F.size("s") >= F.col("need")).select("row_id", "k", "need", "c", F.col("s.sig").alias("sigs"))


def _rare_blocks(apart: DataFrame, sets: DataFrame) -> DataFrame:
    """(row_id, c, n, sig): of m blocks of a row, at least ``need`` of them shared, linked
    rows share one of the first m - need + 1."""
    cores = apart.withColumn("sigs", F.expr("slice(sigs, 1, size(sigs) - need + 1)"))
    return _one_by_one(cores.join(sets.select("row_id", F.size("grams").alias("n")), "row_id"), "c", "n")


def _mixed(by_block: DataFrame, *more) -> DataFrame:
    """Blocks of several components: how many these are, their rows, the sum of their
    squares and, with the aggregates of ``more``, the largest component."""
    parts = by_block.groupBy("sig", "c").agg(F.count("*").alias("m"), *more)
    main = [F.max_by(F.struct("c", *[x for x in parts.columns if x not in ("sig", "c", "m")]), F.struct("m", "c")).alias("main")]
    return parts.groupBy("sig").agg(F.count("*").alias("parts"), F.sum("m").alias("rows"), F.sum(F.col("m") * F.col("m")).alias("sq"), *main).filter("parts > 1")


def _met(crowd: DataFrame, round_no: int, num: int, den: int) -> DataFrame:
    """Pairs of rows outside a block's largest component and some rows of it, for each row
    those that it shares most blocks with."""
    some = [F.min_by(F.struct("row_id", "n"), F.xxhash64("row_id", F.lit(round_no * MEET + i))) for i in range(MEET)]
    apart = crowd.join(_mixed(crowd, F.array(*some).alias("some")).select("sig", "main"), "sig")
    met_by = apart.filter(F.col("c") != F.col("main.c")).select("row_id", "n", F.explode("main.some").alias("other"))
    met_by = met_by.filter(_sizes_fit(F.col("n"), F.col("other.n"), num, den)).groupBy("row_id", F.col("other.row_id").alias("other")).agg(F.count("*").alias("k"))
    # at most MEET for each of the row's blocks
    best = met_by.groupBy("row_id").agg(F.sort_array(F.collect_list(F.struct("k", "other")), False).alias("o"))
    best = best.select("row_id", F.explode(F.slice("o", 1, MEET)).alias("o")).select("row_id", F.col("o.other").alias("other"))
    return best.select(F.least("row_id", "other").alias("a"), F.greatest("row_id", "other").alias("b")).distinct()


def _column_product(rows: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs of ``rows`` (row_id, c) of different components that their n-grams allow to
    be linked."""
    n_of = F.size("grams")
    entries = sets.join(rows, "row_id").select("row_id", "c", n_of.alias("n"), F.explode("grams").alias("g"))
    least = F.floor((F.col("n") * num + (den - 1)) / den)  # overlap with any linked row
    for _ in range(2):
        # n-grams of several components; without the others a row must have enough left.
        # What goes leaves others with fewer, so it is done again
        shared = entries.groupBy("g").agg(F.count("*").alias("many"), F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo != hi").select("g", "many")
        left = entries.join(shared, "g").groupBy("row_id").agg(F.first("c").alias("c"), F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("many", "g"))).alias("cols"))
        left = stored(left.filter(F.size("cols") >= least), "join-columns")
        entries = left.select("row_id", "c", "n", F.explode("cols.g").alias("g"))
    # two linked rows share one of the first columns of each, in the same order
    first = left.withColumn("least", least.cast("int")).select("row_id", "c", "n", "least", F.size("cols").alias("all"), F.posexplode(F.expr("slice(cols, 1, size(cols) - least + 1)")).alias("at", "col"))
    rest = F.col("all") - F.col("at")  # columns from this one on: the overlap is no larger
    widest = F.floor(rest * (num + den) / num) - F.col("n")
    first = first.select("row_id", "c", "n", F.col("col.g").alias("g"), F.least(F.floor(F.col("n") * den / num), widest).alias("most"), "least")
    first = stored(first.filter("most >= least"), "join-first")
    band = lambda size: F.floor(F.log(size.cast("double")) / float(np.log(BAND))).cast("int")
    # pairs inside the largest component of a column decide nothing
    main = first.groupBy("g", "c").agg(F.count("*").alias("m")).groupBy("g").agg(F.max_by("c", F.struct("m", "c")).alias("main"), F.count("*").alias("parts")).filter("parts > 1")
    mine = first.join(main.select("g", "main"), "g")
    x = mine.filter("c != main").select("g", F.col("row_id").alias("a"), F.col("c").alias("ca"), F.col("n").alias("na"), F.col("least").alias("la"), F.col("most").alias("ma"), F.explode(F.sequence(band(F.col("least")), band(F.col("most")))).alias("band"))
    y = mine.select("g", F.col("row_id").alias("b"), F.col("c").alias("cb"), F.col("n").alias("nb"), F.col("least").alias("lb"), F.col("most").alias("mb"), band(F.col("n")).alias("band"))
    both = x.join(y, ["g", "band"]).filter("ca != cb and nb between la and ma and na between lb and mb")
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def classes(docs: DataFrame, n: int = WORDS, num: int = NUM, den: int = DEN) -> DataFrame:
    """(row_id, doc_id, n_shingles, component): documents with the smallest row of
    their component."""
    spark = docs.sparkSession
    in_batches(spark)
    docs = numbered(docs)
    with scratch(spark):
        info = stored(class_rows(docs.select("row_id", "doc_id", "text"), n), "join-classes")
        reps = info.filter("n > 0").groupBy("key").agg(F.min("row_id").alias("rep"))
        label = _components(docs, reps, n, num, den)
        rows = info.join(reps, "key", "left").join(label.select(F.col("node").alias("rep"), "component"), "rep", "left")
        rows = rows.select("row_id", "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep", "row_id").alias("component"))
        return stored(rows, "join-components", keep=True)


def _components(docs: DataFrame, reps: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """(node, component) of the rows that are linked."""
    spark = docs.sparkSession
    sigs = signature_rows(docs.select("row_id", "text"), n, num, den)
    with scratch(spark):
        # blocks that at least two different sets share; a partial aggregate, so that the
        # copies of a set shrink before the shuffle
        shared = sigs.groupBy("sig").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).filter("lo != hi").select("sig")
        # stored in between, or the join with the rows that stand for a class, which leaves
        # most signatures, would be moved below the one that leaves few
        hits = stored(sigs.drop("key").join(stored(shared, "join-shared"), "sig"), "join-hits")
        own = stored(_enough(hits.join(reps.select(F.col("rep").alias("row_id")), "row_id", "left_semi")), "join-own")
        # blocks that such rows share with each other
        of_block = _one_by_one(own).groupBy("sig").agg(F.min("row_id").alias("anchor"), F.max("row_id").alias("last")).filter("anchor != last").select("sig", "anchor")
        block = _one_by_one(own).join(of_block, "sig").groupBy("row_id", "k").agg(F.first("need").alias("need"), F.collect_list(F.struct("sig", "anchor")).alias("s"))
        block = block.filter(F.size("s") >= F.col("need")).select("row_id", "k", "need", F.col("s.sig").alias("sigs"), F.col("s.anchor").alias("anchors"))
        block = stored(block, "join-blocks", keep=True)
    size = block.count()
    sets = stored(gram_sets(docs.select("row_id", "text").join(block.select("row_id").distinct(), "row_id", "left_semi"), n), "join-sets")
    blocks = stored(block_rows(sets, num, den), "join-block-rows")
    # first round: each row and the smallest row of most of its shared blocks
    first = block.select("row_id", F.explode("anchors").alias("anchor")).filter("row_id != anchor").groupBy("row_id", "anchor").agg(F.count("*").alias("c"))
    first = first.groupBy("row_id").agg(F.max_by("anchor", F.struct("c", -F.col("anchor"))).alias("anchor"))
    pairs = stored(first.select(F.least("row_id", "anchor").alias("a"), F.greatest("row_id", "anchor").alias("b")).distinct(), "join-pairs", size)
    label = components(stored(linked(pairs, blocks, sets, num, den), "join-links"))
    tested = pairs
    with scratch(spark):
        rows = stored(_apart(_labelled(block.drop("anchors"), label)), "join-apart", size)
        by_block = _rare_blocks(rows, sets)
        mixed = stored(_mixed(by_block), "join-mixed", size)
        crowded = (F.col("rows") * F.col("rows") - F.col("sq")) / 2 > CROWD * F.col("rows")
        of_pairs = lambda x: F.sum(F.when(crowded, x))
        left = mixed.agg(F.count("*").alias("blocks"), F.sum("rows").alias("rows"), of_pairs((F.col("rows") * F.col("rows") - F.col("sq")) / 2).alias("pairs")).first()
        if not left["blocks"]:
            return stored(label, "join-labels", size, keep=True)
        if (left["pairs"] or 0) > CROWD * left["rows"]:
            # only blocks of very many pairs are worth more rounds, and only their rows meet
            crowd = stored(by_block.join(mixed.filter(crowded).select("sig"), "sig", "left_semi").select("sig", "row_id", "n"), "join-crowd", size)
            for round_no in range(ROUNDS):
                pairs = _met(_labelled(crowd, label), round_no, num, den).join(tested, ["a", "b"], "left_anti")
                pairs = stored(pairs, "join-pairs", size)
                label = stored(joined(label, stored(linked(pairs, blocks, sets, num, den), "join-links")), "join-labels", size)
                tested = tested.unionByName(pairs)
            # components only grow: a row that had too few blocks in common with others
            # still has, and a block of one component is still one
            by_block = _rare_blocks(stored(_apart(_labelled(rows.drop("c"), label)), "join-apart", size), sets)
            mixed = stored(_mixed(by_block), "join-mixed", size)
        pairs = _column_product(by_block.join(mixed.select("sig"), "sig", "left_semi").select("row_id", "c").distinct(), sets, num, den)
        pairs = stored(pairs.join(tested, ["a", "b"], "left_anti"), "join-pairs")
        return stored(joined(label, stored(linked(pairs, blocks, sets, num, den), "join-links")), "join-labels", size, keep=True)


def op6_ngram_jaccard_join(docs: DataFrame) -> DataFrame:
    rows = classes(docs)
    names = rows.select(F.col("row_id").alias("component"), F.col("doc_id").alias("component_id"))
    return rows.join(names, "component").select("doc_id", "n_shingles", "component_id")


ORACLE = r"""
with recursive w as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x != '') as w from documents),
     g as (select distinct doc_id, case when len(w) >= 4 then array_to_string(w[i + 1 : i + 4], ' ') else array_to_string(w, ' ') end as gram
           from w, unnest(range(0, case when len(w) >= 4 then len(w) - 3 when len(w) > 0 then 1 else 0 end)) as u(i)),
     s as (select doc_id, count(*) as n from g group by 1),
     p as (select a.doc_id as a, b.doc_id as b, count(*) as i from g a join g b on a.gram = b.gram and a.doc_id < b.doc_id group by 1, 2),
     e as (select a, b from p join s x on x.doc_id = a join s y on y.doc_id = b where 100 * i >= 85 * (x.n + y.n - i)),
     both_ways as (select a, b from e union all select b, a from e),
     r(node, seen) as (select doc_id, doc_id from w union select r.node, both_ways.b from r join both_ways on r.seen = both_ways.a)
select w.doc_id, coalesce(n, 0)::bigint as n_shingles, c.component_id
from w left join s using (doc_id) join (select node as doc_id, min(seen) as component_id from r group by 1) c using (doc_id)
"""
