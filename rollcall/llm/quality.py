"""Quality classifier: ordinal cumulative-link regression on graded documents.

Grades come from the labels: 0 toxic, 1 not toxic but poor, 2 good. One
weight vector over hashed text features is shared by all grades, with ordered
thresholds: ``P(grade <= k) = sigmoid(t_k - w.x)``. A document's expected grade and the
probability of the top grade follow; documents whose top-grade probability is at least
``LEAST`` are kept.

Features: which letter words occur and how they begin (hashed, lower case), which words are written how
(capitals, digits, signs, length; the share of words of each shape), and how large a
share of the words is repeated.

The model is fitted on at most ``SAMPLE`` labelled documents, those with the smallest
hashes of their ids, and by seeded gradient steps, so the fit is repeatable. Scoring
runs over all documents; the weights are a fixed ``BUCKETS`` numbers.

Defined results: a null text counts as empty; an empty text has no features and gets
the scores of the thresholds alone; labels with nulls, unknown ids or several rows for
an id are used as they are, null ones skipped; without any label every document has
grade 2 and is kept; repeated rows are scored each; extra columns stay out of the way.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.llm import kernels as K
from rollcall.llm.common import in_batches

#: Values come to the driver as whole parts of this.
SCALE = 1000
SAMPLE, BUCKETS, SHAPES, LEAST = 16_000, 2**20, 1024, 0.6
#: Bytes of the word beginnings that are features beside the whole words.
BEGINNINGS = (4, 5)
#: Documents of the sample that a feature must occur in to get a weight, so that the
#: very many rare words cannot learn the sample by heart.
OCCURS = 12
EPOCHS, BATCH, RATE, DECAY = 10, 128, 0.15, 1e-4
GRADES = 3


def _shape_codes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How each word is written, as a number below SHAPES."""
    if not len(starts):
        return np.empty(0, np.int64)

    def count(mark):
        total = np.zeros(len(data) + 1, np.int64)
        np.cumsum(mark, out=total[1:])
        return total[ends] - total[starts]

    size = ends - starts
    upper = count((data >= 65) & (data <= 90))
    digits = count((data >= 48) & (data <= 57))
    signs = count(~K.LETTER[data] & (data != 46) & (data != 44))
    few = lambda x: np.minimum(x, 2)
    code = few(upper) + 3 * few(digits) + 9 * np.minimum(signs, 3) + 36 * (upper * 2 > size)
    return code * 4 + np.searchsorted([3, 8, 15], size, "right")


def features(column: pa.Array):
    """Yield (first row, texts, text of each feature, feature, value) for groups of
    texts; features of a text are distinct."""
    for row, data, offsets in K.groups(column):
        texts = len(offsets) - 1
        starts, ends, counts = K.word_bounds(data, offsets)
        doc = np.repeat(np.arange(texts), np.diff(counts))
        words = np.maximum(np.diff(counts), 1)
        shape, n = np.unique(doc * SHAPES + _shape_codes(data, starts, ends), return_counts=True)
        shape_doc = shape // SHAPES
        low = K.lowered(data)
        starts, ends, counts = K.word_bounds(low, offsets, K.LETTER)
        hashes = K.run_hashes(low, starts, ends)
        doc = np.repeat(np.arange(texts), np.diff(counts))
        place = lambda h, d: d * BUCKETS + (h % K.U64(BUCKETS - SHAPES)).astype(np.int64) + SHAPES
        whole = np.unique(place(hashes, doc))
        parts = [whole]
        for k in BEGINNINGS:
            long = ends - starts > k
            parts.append(np.unique(place(K.run_hashes(low, starts[long], starts[long] + k) + K.U64(k), doc[long])))
        lexical = np.unique(np.concatenate(parts))
        lexical_doc = lexical // BUCKETS
        distinct = np.bincount(whole // BUCKETS, minlength=texts)
        repeated = 1 - distinct / np.maximum(np.diff(counts), 1)
        yield (
            row, texts,
            np.concatenate([shape_doc, lexical_doc, np.arange(texts)]),
            np.concatenate([shape % SHAPES, lexical % BUCKETS, np.full(texts, SHAPES - 1)]),
            np.concatenate([4.0 * n / words[shape_doc], np.ones(len(lexical)), 4.0 * repeated]),
        )


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def grade_probabilities(score: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """P(grade = k) for each score: rows by grades."""
    below = np.concatenate([np.zeros((len(score), 1)), _sigmoid(cuts[None, :] - score[:, None]), np.ones((len(score), 1))], axis=1)
    return np.diff(below, axis=1)


def fit(first: np.ndarray, index: np.ndarray, value: np.ndarray, grade: np.ndarray, grades: int = GRADES, epochs: int = EPOCHS, seed: int = 7):
    """Weights and thresholds by seeded mini-batch gradient steps with per-weight
    rates. The features of document i are those from first[i] to first[i + 1]."""
    rng = np.random.default_rng(seed)
    often = (np.bincount(index, minlength=BUCKETS) >= min(OCCURS, len(grade) // 100))[index]
    first = np.concatenate([[0], np.cumsum(often)])[first]
    value, index = value[often], index[often]
    w, seen = np.zeros(BUCKETS), np.full(BUCKETS, 1e-3)
    share = np.cumsum(np.bincount(grade, minlength=grades)[:-1] + 1.0) / (len(grade) + grades)
    cuts = np.log(share / (1 - share))
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs) + 0.005
        order = rng.permutation(len(grade))
        for at in range(0, len(order), BATCH):
            rows = order[at: at + BATCH]
            sizes = first[rows + 1] - first[rows]
            pick = np.repeat(first[rows] - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum())
            own, x, i = np.repeat(np.arange(len(rows)), sizes), value[pick], index[pick]
            score = np.bincount(own, weights=w[i] * x, minlength=len(rows))
            y = grade[rows]
            edge = np.concatenate([[-np.inf], cuts, [np.inf]])
            hi, lo = _sigmoid(edge[y + 1] - score), np.where(y == 0, 0.0, _sigmoid(edge[y] - score))
            p = np.maximum(hi - lo, 1e-9)
            d_hi, d_lo = hi * (1 - hi) / p, lo * (1 - lo) / p
            step = np.clip(d_hi - d_lo, -1, 1)  # slope of the loss by the score
            touched, slot = np.unique(i, return_inverse=True)
            g = np.bincount(slot, weights=step[own] * x) / len(rows) + DECAY * w[touched]
            seen[touched] += g * g
            w[touched] -= rate * g / np.sqrt(seen[touched])
            for k in range(grades - 1):
                cuts[k] -= rate * 0.5 * (np.sum(d_lo[y == k + 1]) - np.sum(d_hi[y == k])) / len(rows)
            cuts = np.maximum.accumulate(cuts + np.arange(grades - 1) * 1e-3)
    return w, cuts


def graded(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """(doc_id, text, grade) of at most ``sample`` labelled documents."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).otherwise(2)
    marked = labels.filter("quality is not null and toxic is not null").select("doc_id", grade.alias("grade"))
    chosen = marked.orderBy(F.xxhash64("doc_id"), "doc_id", "grade").limit(sample)
    # at most `sample` rows of two numbers; an id that occurs again counts once
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return found.groupBy("doc_id", "grade").agg(F.min("text").alias("text"))


def model(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE):
    """Fit on a bounded sample. The sample's features, not its texts, come to the
    driver."""
    in_batches(docs.sparkSession)

    def rows(batches):
        for batch in batches:
            ids, grades = batch.column("doc_id"), batch.column("grade")
            for row, texts, doc, index, value in features(batch.column("text")):
                order = np.argsort(doc, kind="stable")
                cut = np.searchsorted(doc[order], np.arange(texts + 1)).astype(np.int32)
                i = pa.ListArray.from_arrays(pa.array(cut), pa.array(index[order].astype(np.int32)))
                x = pa.ListArray.from_arrays(pa.array(cut), pa.array(np.rint(value[order] * SCALE).astype(np.int16)))
                yield pa.RecordBatch.from_arrays([ids.slice(row, texts), grades.slice(row, texts), i, x], ["doc_id", "grade", "index", "value"])

    got = graded(docs, labels, sample).mapInArrow(rows, "doc_id long, grade int, index array<int>, value array<short>").toArrow()
    if not got.num_rows:
        return np.zeros(BUCKETS), np.full(GRADES - 1, -35.0)
    # the same order on every run
    got = got.sort_by([("doc_id", "ascending"), ("grade", "ascending")]).combine_chunks()
    index, value = (got.column(c).chunk(0) for c in ("index", "value"))
    # numpy's own copies: the table goes before the fit takes memory
    first, grade = index.offsets.to_numpy().copy(), got.column("grade").to_numpy().astype(np.int64)
    index, value = index.flatten().to_numpy().copy(), value.flatten().to_numpy() / np.float32(SCALE)
    del got
    pa.default_memory_pool().release_unused()
    return fit(first, index, value, grade)


def scored(docs: DataFrame, weights: np.ndarray, cuts: np.ndarray) -> DataFrame:
    """``docs`` with its columns and (expected_grade, p_top) of each row."""
    in_batches(docs.sparkSession)
    w = weights.astype(np.float32)

    def rows(batches):
        for batch in batches:
            score = np.zeros(batch.num_rows)
            for row, texts, doc, index, value in features(batch.column("text")):
                score[row: row + texts] = np.bincount(doc, weights=w[index] * value, minlength=texts)
            p = grade_probabilities(score, cuts)
            more = [pa.array(p @ np.arange(p.shape[1])), pa.array(p[:, -1])]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "expected_grade", "p_top"])

    from pyspark.sql import types as T

    schema = T.StructType([*docs.schema.fields, T.StructField("expected_grade", T.DoubleType()), T.StructField("p_top", T.DoubleType())])
    return docs.mapInArrow(rows, schema)


def op7_quality_classifier(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = scored(docs.select("doc_id", "text"), *model(docs, labels))
    return out.select("doc_id", F.round("expected_grade", 6).alias("expected_grade"), F.round("p_top", 6).alias("p_top"), (F.col("p_top") >= LEAST).alias("keep"))
