"""Packing: documents into sequences of at most ``LENGTH`` tokens, filled with lexical
neighbours.

A document is its token ids and a closing id. Whole windows of it are sequences of their
own; what is left, its tail, is packed with others:

1. tails go to shards of about ``SHARD`` tails, ordered by a MinHash of their tokens so
   that alike ones meet, ties broken by id, so no shard grows with a group of copies;
2. each shard is a BM25 inverted index over its tails; the document frequencies and the
   mean length are those of all tails (the vocabulary bounds their number);
3. a seed, the longest unused tail, asks for its unused neighbours, which greedily fill
   its window. If none of the next few fits, the best is cut so that the window is full,
   and its rest is the next seed. What is left at a shard's end is cut into sequences
   whose lengths are powers of two, so nothing is padded.

Defined results: a null or empty text is its closing id alone; equal texts and repeated
ids are documents of their own; an empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.llm import kernels as K
from rollcall.llm import tokens
from rollcall.llm.common import in_batches, stored

LENGTH, CLOSING, SHARD = 1024, 0, 4096
#: BM25 parameters; neighbours that are looked at before one is cut.
K1, B, AHEAD = 1.2, 0.75, 8
#: Postings of used tails go when the unused ones are below this share of those indexed.
REBUILD = 0.8

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids array<int>"
TAILS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids array<int>, tail binary, place long"


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())


def cut(docs: DataFrame, vocabulary: str, length: int, with_ids: bool) -> DataFrame:
    """Whole windows, finished, and tails (``tail`` not null) of all documents."""
    names = [x.split()[0] for x in TAILS.split(", ")]
    types = [*[pa.int64()] * 7, pa.list_(pa.int32()), pa.binary(), pa.int64()]

    def rows(batches):
        encoder = tokens.encoder(tokens.vocabulary(vocabulary))
        task, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            docs_of = batch.column("doc_id").to_pylist()
            for row, _, offsets, ids, bounds in encoder.texts(batch.column("text")):
                out: list[list] = [[] for _ in names]
                for j in range(len(offsets) - 1):
                    own = np.append(ids[bounds[j]: bounds[j + 1]], CLOSING)
                    whole = len(own) // length * length
                    for at in range(0, whole, length):
                        part = own[at: at + length]
                        for c, v in zip(out, (docs_of[row + j], at, length, crc(part), len(own), (task << 34 | number) * 2, 0, part if with_ids else None, None, None)):
                            c.append(v)
                        number += 1
                    if whole < len(own):
                        tail = own[whole:]
                        place = int(K.mix(tail.astype(K.U64) + K.U64(1)).min() >> K.U64(1))
                        for c, v in zip(out, (docs_of[row + j], whole, len(tail), None, len(own), None, None, None, tail.astype("<i4" if len(encoder.bytes) > 65536 else "<u2").tobytes(), place)):
                            c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names)

    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return kept.mapInArrow(rows, TAILS)


def _tail_ids(binary, wide: bool) -> np.ndarray:
    return np.frombuffer(binary, "<i4" if wide else "<u2").astype(np.int64)


def frequencies(tails: DataFrame, wide: bool) -> tuple[np.ndarray, int, float]:
    """Document frequency of each id over all tails, their number and mean length."""

    def rows(batches):
        for batch in batches:
            own = [_tail_ids(t, wide) for t in batch.column("tail").to_pylist()]
            # each id of a tail once, all tails of the batch in one sort
            pair = np.unique(np.concatenate([t * len(own) + i for i, t in enumerate(own)])) if own else np.empty(0, np.int64)
            term, n = np.unique(pair // max(1, len(own)), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(n.astype(np.int64))], ["term", "n"])

    got = tails.select("tail").mapInArrow(rows, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    total = tails.agg(F.count("*").alias("n"), F.avg("length").alias("mean")).first()
    term, n = got.column("term").to_numpy(), got.column("n").to_numpy()
    df = np.zeros(int(term.max()) + 1 if len(term) else 1, np.int64)
    df[term] = n
    return df, total["n"], total["mean"] or 1.0


class Index:
    """BM25 inverted index of one shard: postings by term with their weights."""

    def __init__(self, tails: list[np.ndarray], idf: np.ndarray, mean: float):
        size = np.array([len(t) for t in tails])
        doc = np.repeat(np.arange(len(tails)), size)
        pair, tf = np.unique(doc * len(idf) + np.concatenate(tails), return_counts=True)
        doc, term = pair // len(idf), pair % len(idf)
        weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[doc] / mean))
        self.of_doc = np.searchsorted(doc, np.arange(len(tails) + 1))
        self.terms = term
        # numpy sorts 16-bit numbers by radix
        order = np.argsort(term.astype(np.uint16) if len(idf) <= 65536 else term, kind="stable")
        self.doc, self.weight = doc[order], weight[order].astype(np.float64)
        self.first = np.searchsorted(term[order], np.arange(len(idf) + 1))
        self.tails = len(tails)

    def scores(self, seed: int) -> np.ndarray:
        """BM25 score of every tail for all terms of one."""
        terms = self.terms[self.of_doc[seed]: self.of_doc[seed + 1]]
        places = [slice(self.first[t], self.first[t + 1]) for t in terms.tolist()]
        return np.bincount(np.concatenate([self.doc[p] for p in places]), weights=np.concatenate([self.weight[p] for p in places]), minlength=self.tails)

    def keep(self, unused: np.ndarray) -> None:
        """Leave out the postings of used tails; the scores of the others stay as they are."""
        kept = unused[self.doc]
        self.first = np.concatenate([[0], np.cumsum(kept)])[self.first]
        self.doc, self.weight = self.doc[kept], self.weight[kept]


def nearest(score: np.ndarray, least: int) -> np.ndarray:
    """Places by falling score, equal ones by place: all, or a prefix with ``least`` or more."""
    if least >= len(score):
        return np.argsort(-score, kind="stable")
    near = np.flatnonzero(score >= np.partition(score, len(score) - least)[len(score) - least])
    return near[np.argsort(-score[near], kind="stable")]


def fill(tails: list[np.ndarray], index: Index, length: int):
    """Sequences of a shard as lists of (tail, from, to)."""
    left = np.array([len(t) for t in tails])
    begin = np.zeros(len(tails), np.int64)
    order = np.argsort(-left, kind="stable")
    at, rest = 0, -1  # rest: a cut tail that is the next seed
    total = int(left.sum())
    indexed = len(tails)  # tails with postings

    def take(i: int, most: int):
        n = min(int(left[i]), most)
        part = (i, int(begin[i]), int(begin[i]) + n)
        begin[i] += n
        left[i] -= n
        return part, n

    while total >= length:
        if rest >= 0 and left[rest]:
            seed = rest
        else:
            while not left[order[at]]:
                at += 1
            seed = int(order[at])
        part, n = take(seed, length)
        window, room, rest = [part], length - n, -1
        if room:
            live = left > 0
            k, unused = 0, int(live.sum())
            if unused < REBUILD * indexed:
                index.keep(live)
                indexed = unused
            score = np.where(live, index.scores(seed), -1.0)
            near = nearest(score, 8 * AHEAD)
            while room and k < unused:
                if k + AHEAD > len(near) < len(score):
                    near = nearest(score, len(score))
                ahead = near[k: min(k + AHEAD, unused)]
                fits = ahead[(left[ahead] <= room) & (left[ahead] > 0)]
                waiting = ahead[left[ahead] > 0]
                if not len(waiting):
                    k += AHEAD
                    continue
                i = int(fits[0]) if len(fits) else int(waiting[0])
                part, n = take(i, room)
                window.append(part)
                room -= n
                if left[i]:
                    rest = i
        total -= length
        yield window
    # the rest: lengths that are powers of two
    waiting = [rest] * (rest >= 0) + [int(i) for i in order if i != rest]
    waiting = [i for i in waiting if left[i]]
    size = length
    while total:
        while size > total:
            size //= 2
        window, room = [], size
        while room:
            part, n = take(waiting[0], room)
            window.append(part)
            room -= n
            if not left[waiting[0]]:
                waiting.pop(0)
        total -= size
        yield window


def packed(docs: DataFrame, length: int = LENGTH, vocabulary: str = "byte_bpe_50k.json", with_ids: bool = False, shard: int = SHARD) -> DataFrame:
    """One row per piece: its document and place there, its sequence and place there,
    and with ``with_ids`` its ids. ``length`` is a power of two."""
    spark = docs.sparkSession
    in_batches(spark)
    wide = len(tokens.encoder(tokens.vocabulary(vocabulary)).bytes) > 65536
    pieces = stored(cut(docs, vocabulary, length, with_ids), "packing")
    tails = pieces.filter("tail is not null").select("doc_id", "start", "length", "doc_tokens", "tail", "place")
    df, n, mean = frequencies(tails, wide)
    idf = np.log1p((n - df + 0.5) / (df + 0.5)).astype(np.float32)
    names = [x.split()[0] for x in PIECES.split(", ")]
    types = [*[pa.int64()] * 7, pa.list_(pa.int32())]

    def rows(batches):
        task, number = TaskContext.get().partitionId(), 0
        table = pa.Table.from_batches(list(batches))  # one shard: bounded by its tails
        if not table.num_rows:
            return
        doc, start, size = (table.column(c).to_pylist() for c in ("doc_id", "start", "doc_tokens"))
        ids = [_tail_ids(t, wide) for t in table.column("tail").to_pylist()]
        out: list[list] = [[] for _ in names]
        for window in fill(ids, Index(ids, idf, mean), length):
            at = 0
            for i, a, b in window:
                part = ids[i][a:b]
                for c, v in zip(out, (doc[i], start[i] + a, b - a, crc(part), size[i], (task << 34 | number) * 2 + 1, at, part if with_ids else None)):
                    c.append(v)
                at += b - a
            number += 1
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names)

    finished = pieces.filter("tail is null").select(*names)
    if not n:
        return finished
    shards = tails.repartitionByRange(-(-n // shard), "place", "doc_id", "start").sortWithinPartitions("place", "doc_id", "start")
    return finished.unionByName(shards.mapInArrow(rows, PIECES))


def op2_packing(docs: DataFrame) -> DataFrame:
    return packed(docs).drop("ids")
