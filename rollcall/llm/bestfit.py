"""Best-fit packing: documents into as few sequences as possible by vector best fit.

A document is its token ids and a closing id. Only documents over ``length`` are cut,
into pieces of that length; a last, shorter piece and every shorter document is a whole
that has to find room. A piece needs three things of a sequence: its tokens, one place
among the documents, and its attention cost (the square of its tokens, as a document
attends to itself only); a sequence has a capacity of each.

1. whole pieces of ``length`` tokens are sequences of their own;
2. the others are dealt to shards of about ``SHARD`` at random. In a shard the longest
   piece comes first and goes to that open sequence, among those with room in every
   respect, whose weighted residual is best: the smallest norm of what would be left
   (``norm``), or the largest dot product of need and residual (``dot``). A piece that fits
   nowhere opens a sequence;
3. sequences that a shard leaves with more than ``SLACK`` of their tokens free are opened
   again, and their pieces are dealt to new, fewer shards, until one shard takes them
   all or a round gains nothing.

Defined results: a null or empty text is its closing id alone; equal texts and repeated or
null ids are documents of their own; an empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.llm import kernels as K
from rollcall.llm import tokens
from rollcall.llm.common import in_batches, scratch, stored
from rollcall.llm.packing import crc

LENGTH, CLOSING, SHARD = 2048, 0, 8192
#: Share of a sequence that may stay free in a shard's result, and rounds at most.
SLACK, ROUNDS = 1 / 256, 4


@dataclass(frozen=True)
class Rule:
    """Capacities of a sequence and how open ones are chosen. Without a number of its own
    a capacity is what a sequence of ``length`` can need at most, so it never costs a
    sequence more."""

    length: int = LENGTH
    documents: int | None = None
    attention: int | None = None
    weights: tuple[float, float, float] = (1.0, 0.05, 0.05)
    choice: str = "norm"

    @property
    def capacity(self) -> np.ndarray:
        return np.array([self.length, self.documents or self.length, self.attention or self.length**2], np.int64)

    @property
    def longest(self) -> int:
        """Tokens of a piece that fits an empty sequence."""
        return min(self.length, int(self.capacity[2] ** 0.5))


_CAPITAL = np.zeros(256, bool)
_CAPITAL[65:91] = True
#: ASCII letters and digits, and the signs that are cut from a word's end behind them.
_PLAIN, _CLOSERS = np.zeros(256, bool), np.zeros(256, bool)
_PLAIN[48:58] = _PLAIN[65:91] = _PLAIN[97:123] = True
_CLOSERS[[ord(c) for c in ".,;:!?"]] = True


class WordEncoder(tokens.Encoder):
    """Ids of texts by a vocabulary of words in lower case: white space goes and never
    matters to the words around it, so ids are kept per word between ASCII white space. A
    sign that ends a word after an ASCII letter or digit is a word of its own, as in the
    vocabulary's split pattern. A capital is lowered only before an ASCII byte, as it may
    otherwise be one character with the mark behind it; nothing is changed in texts
    that could hold a special token's string."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self._forget()

    def _learn(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.whole.encode_batch_fast(pieces, add_special_tokens=False)]
        count = np.array([len(x) for x in found], np.int64)
        place = self.used + np.cumsum(count) - count
        end = self.used + int(count.sum())
        if end > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), end - len(self.ids)), np.int32)])
        self.ids[self.used: end] = np.fromiter((i for x in found for i in x), np.int32, end - self.used)
        self.used = end
        return place, count

    def group(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.used > tokens._MOST_IDS:
            self._forget()
        starts, ends, first = K.word_bounds(data, offsets)
        if b"<|" not in data.tobytes() and len(starts):
            lower = _CAPITAL[data]
            lower[:-1] &= data[1:] < 128
            data = np.where(lower, data + np.uint8(32), data)
            last = ends - 1
            cut = (last > starts) & _CLOSERS[data[last]] & _PLAIN[data[np.maximum(last - 1, 0)]]
            starts = np.insert(starts, np.flatnonzero(cut) + 1, last[cut])
            ends = np.insert(ends, np.flatnonzero(cut), last[cut])
            first = first + np.concatenate([[0], np.cumsum(cut)])[first]
        hashes = K.run_hashes(data, starts, ends)
        slot = (hashes >> K.U64(64 - tokens._SLOT_BITS)).astype(np.int64)
        place, count = self.place[slot], self.count[slot].astype(np.int64)
        missed = np.flatnonzero(self.hash[slot] != hashes)
        if len(missed):
            fresh, of, back = np.unique(hashes[missed], return_index=True, return_inverse=True)
            joined, at = data.tobytes(), missed[of]
            new_place, new_count = self._learn([joined[a:b].decode() for a, b in zip(starts[at].tolist(), ends[at].tolist())])
            place[missed], count[missed] = new_place[back], new_count[back]
            s = slot[at]
            self.hash[s], self.place[s], self.count[s] = fresh, new_place, new_count
        total = np.concatenate([[0], np.cumsum(count)])
        return self.ids[np.repeat(place - total[:-1], count) + np.arange(total[-1])], total[first]


@functools.lru_cache(2)
def encoder(path: str) -> WordEncoder:
    """The worker's encoder; kept between the tasks of a worker."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordEncoder(path)


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, number long, ids array<int>"
_PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, number long, sequence_id long, offset long, free long, ids array<int>"
_TYPES = {"int": pa.int32(), "long": pa.int64(), "array<int>": pa.list_(pa.int32())}


def _batch(schema: str, columns) -> pa.RecordBatch:
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, _TYPES[t]) for c, (_, t) in zip(columns, fields)], [f for f, _ in fields])


def cut(docs: DataFrame, vocabulary: str, longest: int, with_ids: bool) -> DataFrame:
    """Pieces of all documents, with a number of their own."""

    def rows(batches):
        words = encoder(tokens.vocabulary(vocabulary))
        task, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            docs_of = batch.column("doc_id").to_pylist()
            for row, _, offsets, ids, bounds in words.texts(batch.column("text")):
                out: list[list] = [[] for _ in range(7)]
                for j in range(len(offsets) - 1):
                    own = np.append(ids[bounds[j]: bounds[j + 1]], CLOSING)
                    for k, at in enumerate(range(0, len(own), longest)):
                        part = own[at: at + longest]
                        for c, v in zip(out, (docs_of[row + j], k, at, len(part), crc(part), task << 34 | number, part if with_ids else None)):
                            c.append(v)
                        number += 1
                yield _batch(_PIECES, out)

    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return kept.mapInArrow(rows, _PIECES)


def best_fit(size: np.ndarray, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """Sequence (from 0) and offset of each piece of a shard."""
    capacity = rule.capacity
    scale = np.array(rule.weights) / capacity.astype(float) ** 2
    need = np.stack([size, np.ones_like(size), size**2])
    order = np.argsort(-size, kind="stable")
    smallest = need[:, order[-1]] if len(size) else None
    left = np.empty((3, 1024), np.int64)  # residuals of the open sequences
    name = np.empty(1024, np.int64)
    sequence, offset = np.empty(len(size), np.int64), np.empty(len(size), np.int64)
    opened = used = 0
    for i in order.tolist():
        v = need[:, i: i + 1]
        after = left[:, :used] - v
        fits = np.flatnonzero((after >= 0).all(0))
        if len(fits):
            if rule.choice == "norm":
                k = int(fits[np.argmin(scale @ after[:, fits].astype(float) ** 2)])
            else:
                k = int(fits[np.argmax(scale @ (left[:, fits] * v).astype(float))])
        else:
            if used == left.shape[1]:
                left, name = np.concatenate([left, np.empty_like(left)], 1), np.concatenate([name, np.empty_like(name)])
            k, used = used, used + 1
            left[:, k], name[k] = capacity, opened
            opened += 1
        sequence[i], offset[i] = name[k], capacity[0] - left[0, k]
        left[:, k] -= v[:, 0]
        if (left[:, k] < smallest).any():  # closed: nothing of this shard fits any more
            used -= 1
            left[:, k], name[k] = left[:, used], name[used]
    return sequence, offset


def shards(pieces: DataFrame, count: int, turn: int, rule: Rule, slack: float) -> DataFrame:
    """Pieces with their places after best fit in ``count`` shards. ``free`` is what the
    sequence has left, above ``slack`` only."""

    def rows(batches):
        table = pa.Table.from_batches(list(batches))  # one shard: bounded by its pieces
        if not table.num_rows:
            return
        size = table.column("length").to_numpy()
        sequence, offset = best_fit(size, rule)
        free = rule.length - np.bincount(sequence, weights=size).astype(np.int64)[sequence]
        # rounds are told apart by the low bits, whole pieces are round 0
        ids = (TaskContext.get().partitionId() << 40 | sequence << 4) + turn
        placed = [*(table.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32", "number")), ids, offset, np.where(free > slack * rule.length, free, 0), table.column("ids")]
        for b in pa.table([c if isinstance(c, pa.ChunkedArray) else pa.array(c) for c in placed], names=[x.split()[0] for x in _PLACED.split(", ")]).to_batches(8192):
            yield b

    names = [x.split()[0] for x in _PIECES.split(", ")]
    dealt = pieces.select(*names).repartition(count, F.xxhash64("number", F.lit(turn))).sortWithinPartitions("number")
    return dealt.mapInArrow(rows, _PLACED)


def packed(docs: DataFrame, rule: Rule = Rule(), vocabulary: str = "word_bpe_49k.json", with_ids: bool = False, shard: int = SHARD) -> DataFrame:
    """One row per piece: its document and place there, its sequence and place there, and
    with ``with_ids`` its ids."""
    spark = docs.sparkSession
    in_batches(spark)
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "ids"]
    with scratch(spark):
        pieces = stored(cut(docs, vocabulary, rule.longest, with_ids), "bestfit-pieces", keep=True)
        whole = pieces.filter(F.col("length") == rule.length).select(*names[:5], (F.col("number") * 16).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), "ids")
        done, left, before = [whole], pieces.filter(F.col("length") < rule.length), None
        count = left.agg(F.count("*").alias("n")).first()["n"]
        for turn in range(1, ROUNDS + 1):
            if not count:
                break
            last = count <= shard or turn == ROUNDS
            placed = stored(shards(left, -(-count // shard), turn, rule, 1.0 if last else SLACK), "bestfit-placed", keep=True)
            done.append(placed.filter("free = 0").select(*names))
            left = placed.filter("free > 0")
            before, count = count, left.count()
            if count and count > 0.9 * before:  # another round would gain nothing
                done.append(left.select(*names))
                break
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def op13_best_fit_packing(docs: DataFrame) -> DataFrame:
    return packed(docs).drop("ids")
