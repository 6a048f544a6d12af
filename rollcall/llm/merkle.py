"""Merkle manifest of a dataset: a hash tree over the rows of each language, a tree over
the languages, and for every row the proof that it belongs to the root.

A leaf is the hash of a row's fields, each with its length. In a language leaves stand in
the order of their ids; every two neighbours become one node, a last single one too, until
one is left, the language's subroot. Subroots in the order of the languages become the
root in the same way.

1. leaves are ranked by a range partition: a row's rank is its place in its partition plus
   the rows of the language in the partitions before, which are one small row each;
2. trees grow by whole blocks of ``2**BITS`` neighbours, whatever tree they belong to; a
   block's top node is a leaf of the next, smaller step;
3. proofs by pointer jumping: a node holds the segment of siblings from itself to its
   parent. A self-join of the nodes on (pointer = node) doubles the distance to the
   ancestor that a node points to and concatenates the two segments; leaves follow with
   the same tables until all point to the root, after log2(height) joins. Before a join of
   distance d only inner nodes at heights that d divides are needed, so the tables shrink
   faster than their segments grow.

Defined results: null fields are hashed as ``-``; rows with a null id come first in their
language; rows with equal ids stand in the order of their leaves; null languages are a
language of their own, the first; a language of one row has its leaf as subroot, without
another hash; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollcall.llm.common import scratch, stored

#: Fields of a leaf; neighbours of a block as a power of two; the tree over languages.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
BITS, TOP = 10, -1
#: Rows whose id's checksum this divides are tampered with.
TAMPER = 7


def leaf_of(fields: dict[str, Column]) -> Column:
    """Binary hash of the fields, in their order."""
    parts = []
    for c in fields.values():
        value = c.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


def leaves(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, leaf, tampered): the second leaf only where the row is tampered
    with: 1 is added to its n_chars."""
    given = {c: F.col(c) for c in FIELDS} | {"doc_id": F.col("doc_id").cast("long"), "n_chars": F.col("n_chars").cast("long")}
    changed = given | {"n_chars": given["n_chars"].cast("decimal(20,0)") + 1}
    hit = F.crc32(given["doc_id"].cast("string").cast("binary")) % TAMPER == 0
    return docs.select(given["doc_id"].alias("doc_id"), F.col("lang").cast("string").alias("lang"), leaf_of(given).alias("leaf"), F.when(hit, leaf_of(changed)).alias("tampered"))


def ranked(rows: DataFrame, group: str | None, order: list[str], name: str) -> DataFrame:
    """``rows`` with ``idx``, the rank from 0 within the group, and ``n``, the group's
    size; stored. No group is sorted by one task."""
    spread = rows.withColumn("_m", F.monotonically_increasing_id())
    by = [*([group] if group else []), *order, "_m"]  # the last only deals out equal rows
    cols = [F.col(c).asc_nulls_first() for c in by]
    placed = stored(spread.repartitionByRange(*cols).sortWithinPartitions(*cols).drop("_m").withColumn("_at", F.monotonically_increasing_id()), name)
    placed = placed.withColumn("_p", F.shiftright("_at", 33))
    key = F.col(group) if group else F.lit(0)
    parts = placed.groupBy("_p", key.alias("_g")).agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    # as many rows in a window as there are partitions
    earlier = Window.partitionBy("_g").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0))).withColumn("n", F.sum("_rows").over(Window.partitionBy("_g")))
    parts = parts.withColumnRenamed("_p", "_pp")
    both = placed.join(parts, (F.col("_p") == F.col("_pp")) & key.eqNullSafe(F.col("_g")))
    return both.withColumn("idx", F.col("_before") + F.col("_at") - F.col("_first")).drop("_p", "_pp", "_at", "_g", "_first", "_before", "_rows")


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


#: Nodes: kind 0 has a segment towards its parent, 1 is the top of a block, 2 a tree's root.
_NODES = "kind int, tree long, level int, idx long, n long, digest binary, segment binary, doc_id long, tampered binary"
_LEFT, _RIGHT, _NONE = b"\2", b"\1", b"\0"


def blocks(nodes: DataFrame, level: int) -> DataFrame:
    """Grow every block of neighbouring nodes (tree, idx at ``level``, n leaves of the
    tree, digest, doc_id, tampered) by ``BITS`` levels, or to the tree's root."""

    def grown(tree: int, n: int, first: int, block: list) -> Iterator[tuple]:
        now = [r[0].hex() for r in block]
        for up in range(BITS + 1):
            at, of_level = first >> up, -(-n // (1 << (level + up)))
            if of_level == 1:
                if tree != TOP and level + up == 0:  # the only leaf is the subroot
                    yield 0, tree, 0, 0, n, block[0][0], b"", block[0][1], block[0][2]
                yield 2, tree, level + up, 0, n, bytes.fromhex(now[0]), None, None, None
                return
            if up == BITS:
                yield 1, tree, level + up, at, n, bytes.fromhex(now[0]), None, None, None
                return
            for j, digest in enumerate(now):
                sibling = now[j ^ 1] if j ^ 1 < len(now) else None
                segment = _NONE if sibling is None else (_LEFT if j & 1 else _RIGHT) + bytes.fromhex(sibling)
                own = (block[j][0], segment, block[j][1], block[j][2]) if level + up == 0 else (None, segment, None, None)
                yield 0, tree, level + up, at + j, n, *own
            now = [_hash("".join(now[j: j + 2])) for j in range(0, len(now), 2)]

    names = [x.split()[0] for x in _NODES.split(", ")]
    types = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.binary()]

    def rows(batches):
        out: list[tuple] = []

        def batch_of(found):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), types)], names)

        key, block = None, []
        for batch in batches:
            tree, idx, n = (batch.column(c).to_pylist() for c in ("tree", "idx", "n"))
            rest = zip(*(batch.column(c).to_pylist() for c in ("digest", "doc_id", "tampered")))
            for t, i, many, node in zip(tree, idx, n, rest):
                if (t, i >> BITS) != key:
                    if block:
                        out.extend(grown(key[0], count, key[1] << BITS, block))
                    key, count, block = (t, i >> BITS), many, []
                    if len(out) > 8192:
                        yield batch_of(out)
                        out = []
                block.append(node)
        if block:
            out.extend(grown(key[0], count, key[1] << BITS, block))
        if out:
            yield batch_of(out)

    by_block = nodes.repartition("tree", F.shiftright("idx", BITS)).sortWithinPartitions("tree", "idx")
    return by_block.select("tree", "idx", "n", "digest", "doc_id", "tampered").mapInArrow(rows, _NODES)


def height(n: int) -> int:
    return max(0, n - 1).bit_length()


def grow(nodes: DataFrame, n: int, store) -> list[DataFrame]:
    """Stored node tables of trees of at most ``n`` leaves, one for each step."""
    tables, level = [], 0
    while True:
        tables.append(store(blocks(nodes, level), "merkle-nodes"))
        level += BITS
        if height(n) <= level:
            return tables
        nodes = tables[-1].filter("kind = 1")


def pointers(nodes: DataFrame) -> DataFrame:
    """Nodes with a segment, pointing to their parents: (to_tree, to_level, to_idx). A
    language's root is the language's leaf in the tree over languages."""
    ends = (F.col("tree") != TOP) & F.expr("shiftleft(1L, level + 1) >= n")
    return nodes.filter("kind = 0").select(
        "tree", "level", "idx", "segment",
        F.when(ends, TOP).otherwise(F.col("tree")).cast("long").alias("to_tree"),
        F.when(ends, 0).otherwise(F.col("level") + 1).cast("int").alias("to_level"),
        F.when(ends, F.col("tree")).otherwise(F.shiftright("idx", 1)).alias("to_idx"),
        "doc_id", "digest", "tampered",
    )


def jumped(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """``rows`` after a join with what they point to: twice the distance, both segments.
    The root has no row, so what points to it stays as it is."""
    to = [f"to_{c}" for c in ("tree", "level", "idx")]
    over = nodes.select(F.col("tree").alias("to_tree"), F.col("level").alias("to_level"), F.col("idx").alias("to_idx"), F.col("segment").alias("_s"), *[F.col(c).alias(f"_{c}") for c in to])
    both = rows.join(over, to, "left")
    return both.select(
        *[F.coalesce(f"_{c}", c).alias(c) if c in to else F.when(F.col("_s").isNull(), F.col(c)).otherwise(F.concat(c, "_s")).alias(c) if c == "segment" else F.col(c) for c in rows.columns]
    )


def siblings(segment: bytes) -> Iterator[tuple[bytes, str]]:
    """(side, hexadecimal digest) of each step of a segment; no digest where a node has
    no sibling."""
    at = 0
    while at < len(segment):
        side = segment[at: at + 1]
        yield side, segment[at + 1: at + 33].hex() if side != _NONE else ""
        at += 1 if side == _NONE else 33


def folded(leaf: bytes, segment: bytes) -> str:
    """Root that a leaf and the siblings of its proof give."""
    now = leaf.hex()
    for side, sibling in siblings(segment):
        now = _hash(sibling + now if side == _LEFT else now + sibling)
    return now


def manifest(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, proof (the digests of its
    siblings, joined), folded_root of the row as it was found after tampering, verified."""
    schema = "doc_id long, leaf string, subroot string, root string, proof string, folded_root string, verified boolean"
    spark = docs.sparkSession
    with scratch(spark) as store:
        rows = ranked(store(leaves(docs), "merkle-leaves"), "lang", ["doc_id", "leaf"], "merkle-order")
        rows = store(rows, "merkle-ranked")
        langs = store(ranked(store(rows.select("lang", "n").distinct(), "merkle-langs").withColumnRenamed("n", "size"), None, ["lang"], "merkle-lang-order"), "merkle-lang-ranked")
        most = langs.agg(F.max("size").alias("size"), F.count("*").alias("n")).first()
        if not most["n"]:
            return spark.createDataFrame([], schema)
        number = langs.select(F.col("lang").alias("_lang"), F.col("idx").alias("tree"))
        named = rows.join(number, F.col("lang").eqNullSafe(F.col("_lang")))
        steps = grow(named.select("tree", "idx", "n", F.col("leaf").alias("digest"), "doc_id", "tampered"), most["size"], store)
        nodes = steps[0]
        for more in steps[1:]:
            nodes = nodes.unionByName(more)
        subroots = stored(nodes.filter("kind = 2").select("tree", "digest"), "merkle-subroots", keep=True)
        over = grow(subroots.select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("idx"), F.lit(most["n"]).alias("n"), "digest", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("binary").alias("tampered")), most["n"], store)
        root = over[-1].filter("kind = 2").first()["digest"].hex()
        for more in over:
            nodes = nodes.unionByName(more)
        paths = pointers(nodes)
        is_leaf = (F.col("tree") != TOP) & (F.col("level") == 0)
        proofs = stored(paths.filter(is_leaf).drop("level", "idx").withColumnRenamed("digest", "leaf"), "merkle-paths", keep=True)
        inner = stored(paths.filter(~is_leaf).drop("doc_id", "digest", "tampered"), "merkle-pointers", keep=True)
        distance, far = 1, height(most["size"]) + height(most["n"])
        while distance < far:
            proofs = jumped(proofs, inner)
            distance *= 2
            if distance < far:
                aligned = (F.col("tree") == TOP) | (F.col("level") % distance == 0)
                inner = stored(jumped(inner.filter(aligned), inner), "merkle-pointers", keep=True)
    proofs = proofs.join(subroots.withColumnRenamed("digest", "subroot"), "tree")

    def checked(batches):
        names = [x.split()[0] for x in schema.split(", ")]
        for batch in batches:
            leaf, tampered, segment = (batch.column(c).to_pylist() for c in ("leaf", "tampered", "segment"))
            again = [folded(t or d, s) for t, d, s in zip(tampered, leaf, segment)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([d.hex() for d in leaf], pa.string()), pa.array([d.hex() for d in batch.column("subroot").to_pylist()], pa.string()), pa.array([root] * len(leaf), pa.string()),
                 pa.array(["".join(d for _, d in siblings(s)) for s in segment], pa.string()), pa.array(again, pa.string()), pa.array([a == root for a in again])],
                names,
            )

    return proofs.select("doc_id", "leaf", "tampered", "segment", "subroot").mapInArrow(checked, schema)


def op11_merkle_manifest(docs: DataFrame) -> DataFrame:
    return manifest(docs).select("doc_id", "leaf", "subroot", "root", F.sha2(F.col("proof").cast("binary"), 256).alias("proof_sha256"), "folded_root", "verified")


#: DuckDB has no crc32: the checksum is folded bit by bit over the decimal id.
ORACLE = r"""
with recursive given as (
       select doc_id, lang, list_reduce(flatten([[ord(c)::bigint, 0, 0, 0, 0, 0, 0, 0] for c in string_split(doc_id::varchar, '')]),
                lambda a, x: xor(xor(a, x) >> 1, 3988292384 * (xor(a, x) & 1)), 4294967295::bigint) as crc,
              coalesce(strlen(doc_id::varchar)::varchar || ':' || doc_id::varchar, '-') || coalesce(strlen(source)::varchar || ':' || source, '-')
              || coalesce(strlen(lang)::varchar || ':' || lang, '-') as head, n_chars, coalesce(strlen(text)::varchar || ':' || text, '-') as tail from documents),
     leaf as (select doc_id, lang, row_number() over (partition by lang order by doc_id) - 1 as pos, count(*) over (partition by lang) as n,
              sha256(head || coalesce(strlen(n_chars::varchar)::varchar || ':' || n_chars::varchar, '-') || tail) as leaf,
              case when xor(crc, 4294967295) % 7 = 0 then sha256(head || coalesce(strlen((n_chars + 1)::varchar)::varchar || ':' || (n_chars + 1)::varchar, '-') || tail) end as bad from given),
     node(lang, level, idx, n, h) as (
       select lang, 0, pos, n, leaf from leaf
       union all
       select lang, max(level) + 1, idx // 2, (max(n) + 1) // 2, sha256(string_agg(h, '' order by idx)) from node where n > 1 group by lang, idx // 2),
     sub as (select lang, h as subroot, row_number() over (order by lang nulls first) - 1 as pos, count(*) over () as langs from node where n = 1),
     top(level, idx, n, h) as (
       select 0, pos, langs, subroot from sub
       union all
       select max(level) + 1, idx // 2, (max(n) + 1) // 2, sha256(string_agg(h, '' order by idx)) from top where n > 1 group by idx // 2),
     fold(doc_id, lang, leaf, idx, n, level, phase, now, proof) as (
       select doc_id, lang, leaf, pos, n, 0, 0, coalesce(bad, leaf), '' from leaf
       union all
       select f.doc_id, f.lang, f.leaf, case when f.n = 1 then s.pos else f.idx // 2 end, case when f.n = 1 then s.langs else (f.n + 1) // 2 end, case when f.n = 1 then 0 else f.level + 1 end,
              case when f.n = 1 then 1 else f.phase end,
              case when f.n = 1 then f.now when f.idx % 2 = 1 then sha256(coalesce(a.h, b.h) || f.now) else sha256(f.now || coalesce(a.h, b.h, '')) end,
              case when f.n = 1 then f.proof else f.proof || coalesce(a.h, b.h, '') end
       from fold f join sub s on s.lang is not distinct from f.lang
       left join node a on f.phase = 0 and f.n > 1 and a.lang is not distinct from f.lang and a.level = f.level and a.idx = xor(f.idx, 1)
       left join top b on f.phase = 1 and f.n > 1 and b.level = f.level and b.idx = xor(f.idx, 1)
       where f.n > 1 or f.phase = 0)
select f.doc_id, f.leaf, s.subroot, r.h as root, sha256(f.proof) as proof_sha256, f.now as folded_root, f.now = r.h as verified
from fold f join sub s on s.lang is not distinct from f.lang, (select h from top where n = 1) r where f.phase = 1 and f.n = 1
"""
