"""Token counts of sections: each document is encoded once as a whole, and its tokens
are joined to the sections by their places.

Places are compared in bytes of UTF-8, where the tokens of a byte-level vocabulary lie
behind each other without gaps; section bounds are code points and are turned into
bytes first. The interval join is two binary searches over the sorted sections.

The rule for a token that crosses a bound: it counts whole for the section that holds
most of its bytes, the earlier one of equals; with ``rule="first"`` for the section of
its first byte in any section; with ``rule="split"`` each section counts its share of
the bytes. A token without a byte in any section counts for section -1, so that the
counts of a document add up to its tokens.

Defined results: a null text counts as empty and has only its row for section -1; an
empty section has 0 tokens; sections may touch but a later one loses what an earlier
one holds already, and ends at the end of the text; null sections are none; repeated
ids are documents of their own; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.llm import tokens
from rollcall.llm.common import in_batches

RULES = ("most", "first", "split")


def lines(data: np.ndarray, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sections of a text given by its bytes: its lines, without the line feeds, as starts
    and ends in code points. ``chars`` is where its code points begin. Every text has at
    least one line."""
    feeds = np.searchsorted(chars, np.flatnonzero(data == 10))
    return np.append(0, feeds + 1), np.append(feeds, len(chars))


def allocate(begin: np.ndarray, end: np.ndarray, lo: np.ndarray, hi: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray, float]:
    """Tokens [begin, end) against disjoint sorted sections [lo, hi): tokens of each
    section, tokens that cross a bound among them, tokens of no section."""
    counts, crossing = np.zeros(len(lo)), np.zeros(len(lo), np.int64)
    if not len(begin):
        return counts, crossing, 0.0
    real = np.flatnonzero(hi > lo)  # an empty section holds no byte
    a, b = lo[real], hi[real]
    first, stop = np.searchsorted(b, begin, "right"), np.searchsorted(a, end, "left")
    inside = np.flatnonzero((stop - first == 1) & (end > begin))
    at = first[inside]
    whole = (a[at] <= begin[inside]) & (b[at] >= end[inside])
    np.add.at(counts, real[at[whole]], 1)
    outside = float(np.sum(stop <= first))
    odd = np.concatenate([inside[~whole], np.flatnonzero(stop - first > 1)])
    for t in odd.tolist():
        s = np.arange(first[t], stop[t])
        held = np.minimum(b[s], end[t]) - np.maximum(a[s], begin[t])
        if rule == "split":
            counts[real[s]] += held / (end[t] - begin[t])
            outside += 1 - held.sum() / (end[t] - begin[t])
            crossing[real[s]] += 1
        else:
            k = s[np.argmax(held)] if rule == "most" else s[0]
            counts[real[k]] += 1
            crossing[real[k]] += 1
    return counts, crossing, outside


SCHEMA = "doc_id long, section int, start int, end int, n_tokens double, n_crossing long, doc_tokens long"


def attributed(docs: DataFrame, sections: str | None = "sections", rule: str = "most", vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    """One row per document and section (-1: outside). ``sections`` is an array of
    structs with ``start`` and ``end``; with None the sections of a text are its lines."""
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    in_batches(docs.sparkSession)
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.int64(), pa.int64()]

    def rows(batches):
        encoder = tokens.encoder(tokens.vocabulary(vocabulary))
        for batch in batches:
            ids_of = batch.column("doc_id").to_pylist()
            if sections:
                spans = batch.column("sections")
                flat = spans.flatten()
                starts, ends = (flat.field(k).fill_null(0).to_numpy(zero_copy_only=False) for k in ("start", "end"))
                sizes = np.nan_to_num(pa.compute.list_value_length(spans).fill_null(0).to_numpy(zero_copy_only=False)).astype(np.int64)
                place = np.concatenate([[0], np.cumsum(sizes)])
            for row, data, offsets, ids, bounds in encoder.texts(batch.column("text")):
                out: list[list] = [[] for _ in names]
                edges = np.concatenate([[0], np.cumsum(encoder.bytes[ids])])
                begins_char = np.flatnonzero((data & 0xC0) != 0x80)
                for j in range(len(offsets) - 1):
                    i = row + j
                    first, last = bounds[j], bounds[j + 1]
                    token = edges[first: last + 1] - edges[first]
                    c0, c1 = np.searchsorted(begins_char, offsets[j: j + 2])
                    byte_of = np.append(begins_char[c0:c1] - offsets[j], offsets[j + 1] - offsets[j])
                    if sections:
                        s, e = starts[place[i]: place[i + 1]], ends[place[i]: place[i + 1]]
                    else:
                        s, e = lines(data[offsets[j]: offsets[j + 1]], byte_of[:-1])
                    order = np.lexsort((e, s))
                    lo = byte_of[np.clip(s[order], 0, len(byte_of) - 1)]
                    hi = byte_of[np.clip(e[order], 0, len(byte_of) - 1)]
                    lo = np.maximum(lo, np.concatenate([[0], np.maximum.accumulate(hi)[:-1]])) if len(lo) else lo
                    hi = np.maximum(lo, hi)
                    counts, crossing, outside = allocate(token[:-1], token[1:], lo, hi, rule)
                    m = len(order)
                    for c, v in zip(out, ([ids_of[i]] * (m + 1), [-1, *order.tolist()], [None, *s[order].tolist()], [None, *e[order].tolist()], [outside, *counts.tolist()], [0, *crossing.tolist()], [int(last - first)] * (m + 1))):
                        c += v
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names)

    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *([F.col(sections).alias("sections")] if sections else []))
    return kept.mapInArrow(rows, SCHEMA)


def op3_token_counts(docs: DataFrame) -> DataFrame:
    """Tokens of every line of every document."""
    rows = attributed(docs, sections=None)
    return rows.select("doc_id", "section", "start", "end", F.col("n_tokens").cast("long").alias("n_tokens"), "n_crossing", "doc_tokens")
