"""Substring dedup: words covered by a window that occurs earlier are removed.

A window is ``WINDOW`` consecutive words of a document. It is represented by its key,
the smallest hash among its runs of ``GRAM`` words; equal windows have equal keys, and
a document has one key place for several windows in a row. So:

1. each partition counts its key places in a sketch, one row of ``WIDTH`` counters,
   kept sparse; Spark merges the partitions' sketches by counter. A window occurs at
   most as often as the counter of its key says, so nothing that repeats is lost;
2. key places whose counter is at least two go back to their documents, and only
   windows with such a key are emitted, with a 64-bit hash of all their words;
3. those are grouped exactly by hash: the first (smallest document, then start) stays,
   every other one covers its words.

A single row of very many counters is used instead of several short rows: it is
spread over the cluster by counter, so nothing is broadcast, and its width does not
have to fit in a task. Documents with equal words are grouped first; later copies of
at least a window are removed whole, and emit nothing.

Defined results: a null text has no words; a document shorter than a window is kept;
repeated document ids are told apart by their order of (id, words) when windows are
compared, each row having a result of its own; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.llm import kernels as K
from rollcall.llm.common import in_batches, numbered, stored

#: Words of a window, words of the runs that its key is chosen from, and counters of
#: the sketch.
WINDOW, GRAM, WIDTH = 20, 5, 2**44


def _keys(words: np.ndarray, counts: np.ndarray, window: int, gram: int):
    """For the words of a group of texts: run hashes, smallest run hash of the window
    from each position on (0 where a window would leave its text), key places."""
    grams = K.gram_hashes(words, gram)
    span = window - gram + 1
    if len(grams) < span:
        return grams, np.empty(0, K.U64), np.zeros(len(grams), bool)
    least = K.sliding_min(grams, span)
    valid = np.zeros(len(words) + 1, np.int64)
    for a, b in zip(counts[:-1], counts[1:]):
        if b - a >= window:
            valid[a] += 1
            valid[b - window + 1] -= 1
    least[np.cumsum(valid)[: len(least)] == 0] = 0
    padded = np.concatenate([np.zeros(span - 1, K.U64), least, np.zeros(span - 1, K.U64)])
    return grams, least, (K.sliding_max(padded, span) == grams) & (grams != 0)


def _places(column: pa.Array, window: int, gram: int):
    """Yield (first row, words before each text, words, run hashes, smallest, key places)."""
    for row, data, offsets in K.groups(column):
        words, counts = K.word_hashes(data, offsets, lower=False)
        grams, least, key = _keys(words, counts, window, gram)
        yield row, data, offsets, words, counts, grams, least, key


def repeated_keys(docs: DataFrame, window: int, gram: int, width: int) -> DataFrame:
    """Counters of the merged sketch that are at least two."""

    def sketch(batches):
        for batch in batches:
            cells = [grams[key] % K.U64(width) for *_, grams, _, key in _places(batch.column("text"), window, gram)]
            cell, n = np.unique(np.concatenate(cells) if cells else np.empty(0, K.U64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int64)), pa.array(np.minimum(n, 2).astype(np.int32))], ["cell", "n"])

    partial = docs.select("text").mapInArrow(sketch, "cell long, n int")
    return partial.groupBy("cell").agg(F.sum("n").alias("n")).filter("n > 1").select("cell")


def key_places(docs: DataFrame, window: int, gram: int, width: int) -> DataFrame:
    """(row_id, cell, place) of every key."""

    def places(batches):
        for batch in batches:
            ids = batch.column("row_id").to_numpy()
            out = []
            for row, _, _, _, counts, grams, _, key in _places(batch.column("text"), window, gram):
                at = np.flatnonzero(key)
                doc = np.searchsorted(counts, at, "right") - 1
                out.append((ids[row + doc], (grams[at] % K.U64(width)).astype(np.int64), (at - counts[doc]).astype(np.int32)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["row_id", "cell", "place"])

    return docs.select("row_id", "text").mapInArrow(places, "row_id long, cell long, place int")


def _kept_rows(words_of, removed: np.ndarray) -> str:
    return hashlib.sha256(b" ".join(w for w, r in zip(words_of, removed) if not r)).hexdigest()


def _window_hashes(words: np.ndarray, starts: np.ndarray, window: int) -> np.ndarray:
    return K.gram_hashes(words, window)[starts]


def deduplicated(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, width: int = WIDTH, text_out: bool = False) -> DataFrame:
    """One row per document: words, words removed, digest of the kept words joined by
    single spaces (and these themselves with ``text_out``)."""
    spark = docs.sparkSession
    in_batches(spark)
    docs = numbered(docs)

    # documents with equal words: all but the first are copies
    def digests(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            words = [t.encode().split() for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row_id"), pa.array([hashlib.sha256(b" ".join(w)).digest() for w in words], pa.binary()), pa.array([len(w) for w in words], pa.int32())], ["row_id", "digest", "n"]
            )

    whole = docs.select("row_id", "text").mapInArrow(digests, "row_id long, digest binary, n int")
    whole = whole.filter(F.col("n") >= window)
    # the first of each is found by a partial aggregate; the others are those that are
    # no first, by row, so that a text with very many copies is no key of a join
    first = whole.groupBy("digest").agg(F.min("row_id").alias("row_id")).select("row_id")
    copies = whole.select("row_id").join(first, "row_id", "left_anti").withColumn("copy", F.lit(True))

    repeated = stored(repeated_keys(docs, window, gram, width), "substring-sketch")
    flagged = key_places(docs, window, gram, width).join(repeated, "cell", "left_semi")
    flagged = stored(flagged.groupBy("row_id").agg(F.collect_list("place").alias("places")), "substring-places")
    # every text once, with its repeated key places; texts that may lose words are
    # stored with their candidate windows, the others are finished
    joined = docs.join(flagged, "row_id", "left").join(copies, "row_id", "left")
    schema = "doc_id long, row_id long, n_words int, done string, text string, starts array<int>, hashes array<long>"

    def windows(batches):
        for batch in batches:
            ids, rows = batch.column("doc_id").to_pylist(), batch.column("row_id").to_pylist()
            copy, places = batch.column("copy").to_pylist(), batch.column("places")
            none = hashlib.sha256(b"").hexdigest()
            cols: list[list] = [[] for _ in range(7)]
            size = 0

            def out():
                types = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int64())]
                return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], [x.split()[0] for x in schema.split(", ")])

            for row, data, offsets, words, counts, grams, least, _ in _places(batch.column("text"), window, gram):
                marked = np.zeros(len(grams), bool)
                for j in range(len(offsets) - 1):
                    got = places[row + j]
                    if got.is_valid and not copy[row + j]:
                        marked[np.asarray(got.values) + counts[j]] = True
                span = window - gram + 1
                hit = np.zeros(len(least), bool)
                if marked.any():
                    high = np.where(marked, grams, K.U64(2**64 - 1))
                    hit = (K.sliding_min(high, span) == least) & (least != 0)
                every = K.gram_hashes(words, window) if hit.any() else None
                for j in range(len(offsets) - 1):
                    a, b = counts[j], counts[j + 1]
                    text = data[offsets[j]: offsets[j + 1]].tobytes()
                    at = np.flatnonzero(hit[a: max(a, b - window + 1)])
                    i = row + j
                    finished, rest, starts, hashes = None, None, None, None
                    if copy[i]:
                        finished = none
                    elif not len(at):
                        finished = hashlib.sha256(b" ".join(text.split())).hexdigest()
                        rest = text.decode() if text_out else None
                    else:
                        rest, starts, hashes = text.decode(), at.astype(np.int32), every[a + at].astype(np.int64)
                    for c, v in zip(cols, (ids[i], rows[i], int(b - a), finished, rest, starts, hashes)):
                        c.append(v)
                    size += len(text)
                    if size > 8_000_000:
                        yield out()
                        cols, size = [[] for _ in range(7)], 0
            if cols[0]:
                yield out()

    judged = stored(joined.select("doc_id", "row_id", "text", "places", "copy").mapInArrow(windows, schema), "substring-windows")

    # exact grouping of the candidate windows; a hot window is summed up before it is
    # shuffled, and joined as an ordinary skewed key
    seen = judged.filter("done is null").select("row_id", F.explode(F.arrays_zip("starts", "hashes")).alias("w")).select("row_id", F.col("w.starts").alias("start"), F.col("w.hashes").alias("hash"))
    firsts = seen.groupBy("hash").agg(F.min(F.struct("row_id", "start")).alias("f"), F.count("*").alias("n")).filter("n > 1").select("hash", "f")
    firsts = stored(firsts, "substring-firsts")
    later = seen.join(firsts, "hash").filter("row_id != f.row_id or start != f.start").groupBy("row_id").agg(F.collect_list("start").alias("later"))
    later = stored(later, "substring-later")
    pending = judged.filter("done is null").select("doc_id", "row_id", "n_words", "text").join(later, "row_id", "left")
    result = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"

    def remove(batches):
        for batch in batches:
            out = []
            for doc, n, text, starts in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_words", "text", "later"))):
                edge = np.zeros(n + 1, np.int64)
                if starts:
                    s = np.asarray(starts)
                    np.add.at(edge, s, 1)
                    np.add.at(edge, s + window, -1)
                gone = np.cumsum(edge)[:n] > 0
                kept = b" ".join(w for w, g in zip(text.encode().split(), gone) if not g)
                out.append((doc, n, int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode() if text_out else None))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()))], [x.split()[0] for x in result.split(", ")])

    empty = hashlib.sha256(b"").hexdigest()
    removed = F.when((F.col("done") == empty) & (F.col("n_words") > 0), F.col("n_words")).otherwise(0).cast("long")
    clean = F.array_join(F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != ""), " ") if text_out else F.lit(None).cast("string")
    done = judged.filter("done is not null").select("doc_id", F.col("n_words").cast("long").alias("n_words"), removed.alias("n_removed"), F.col("done").alias("kept_sha256"), clean.alias("kept_text"))
    rows = done.unionByName(pending.select("doc_id", "n_words", "text", "later").mapInArrow(remove, result))
    return rows if text_out else rows.drop("kept_text")


def op10_substring_dedup(docs: DataFrame) -> DataFrame:
    return deduplicated(docs)


ORACLE = r"""
with d as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x != '') as w from documents),
     win as (select doc_id, s, array_to_string(w[s + 1 : s + 20], ' ') as k from d, unnest(range(0, greatest(len(w) - 19, 0))) as u(s)),
     dup as (select doc_id, s from (select doc_id, s, row_number() over (partition by md5(k) order by doc_id, s) as r from win) where r > 1),
     cov as (select distinct doc_id, s + o as p from dup, unnest(range(0, 20)) as u(o)),
     words as (select doc_id, p, w[p + 1] as word from d, unnest(range(0, len(w))) as u(p)),
     kept as (select doc_id, count(*) as n, string_agg(word, ' ' order by p) as t from words anti join cov using (doc_id, p) group by doc_id)
select d.doc_id, len(w)::bigint as n_words, (len(w) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(t, '')) as kept_sha256
from d left join kept using (doc_id)
"""
