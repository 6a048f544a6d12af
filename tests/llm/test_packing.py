from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
from conftest import ODD, SMALL, documents
from tokenizers import Tokenizer

from rollcall.llm import packing as P
from rollcall.llm import tokens


def ids_of(text):
    whole = Tokenizer.from_file(tokens.vocabulary())
    return whole.encode(text or "", add_special_tokens=False).ids + [0]


def verify(pieces, texts, length=1024):
    """Every id in exactly one piece with the right checksum, sequences gapless and
    not over length; returns the padding."""
    of_doc, of_sequence = defaultdict(list), defaultdict(list)
    for r in pieces:
        of_doc[r["doc_id"]].append(r)
        of_sequence[r["sequence_id"]].append(r)
    assert set(of_doc) == {k for k, _ in texts}
    for k, t in texts:
        ids, at = ids_of(t), 0
        for r in sorted(of_doc[k], key=lambda r: r["start"]):
            assert r["start"] == at and r["length"] > 0 and r["doc_tokens"] == len(ids)
            part = np.array(ids[at: at + r["length"]], "<u4")
            assert zlib.crc32(part.tobytes()) == r["ids_crc32"]
            at += r["length"]
        assert at == len(ids)
    padding = 0
    for rows in of_sequence.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert 0 < at <= length
        padding += 0 if at & (at - 1) == 0 else length - at
    return padding


def test_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert verify(P.op2_packing(docs).collect(), texts) == 0


def test_odd_texts_and_small_shards(spark):
    random.seed(5)
    rows = ODD + [(100 + i, " ".join(random.choices("red green blue\n 12 <|endoftext|> ö x".split(" "), k=random.randint(0, 300)))) for i in range(60)]
    got = P.packed(documents(spark, rows), length=64, with_ids=True, shard=16).collect()
    assert verify(got, rows, 64) == 0
    assert all(P.crc(np.array(r["ids"])) == r["ids_crc32"] for r in got)
    assert P.op2_packing(documents(spark, [])).collect() == []


def test_repeated_rows_are_packed_each(spark):
    got = P.op2_packing(documents(spark, [(1, "a b c")] * 5)).collect()
    assert sum(r["length"] for r in got) == 5 * len(ids_of("a b c"))


def test_neighbours_are_lexical():
    """Tails of four vocabularies: windows hold one vocabulary, mostly."""
    rng = np.random.default_rng(1)
    tails = [rng.integers(1 + 500 * (i % 4), 501 + 500 * (i % 4), 200) for i in range(200)]
    df = np.bincount(np.concatenate([np.unique(t) for t in tails]), minlength=2100)
    idf = np.log1p((len(tails) - df + 0.5) / (df + 0.5)).astype(np.float32)
    pure = [len({i % 4 for i, _, _ in w}) == 1 for w in P.fill(tails, P.Index(tails, idf, 200.0), 1024)]
    assert np.mean(pure) > 0.8


def test_bm25_matches_the_formula():
    tails = [np.array([1, 1, 2]), np.array([2, 3]), np.array([1, 4, 4, 4])]
    idf = np.array([0, 0.5, 0.7, 1.1, 1.3], np.float32)
    index = P.Index(tails, idf, 3.0)
    want = [sum(idf[t] * (tail == t).sum() * (P.K1 + 1) / ((tail == t).sum() + P.K1 * (1 - P.B + P.B * len(tail) / 3.0)) for t in (1, 2)) for tail in tails]
    assert np.allclose(index.scores(0), want, atol=1e-5)


def test_all_terms_of_a_seed_ask():
    """A tail that shares only one of the seed's lightest terms is a neighbour."""
    tails = [np.arange(1, 601), np.array([600, 900]), np.array([901, 902])]
    idf = np.linspace(2.0, 1.0, 1000, dtype=np.float32)
    index = P.Index(tails, idf, 200.0)
    scores = index.scores(0)
    assert scores[1] > 0 == scores[2]
    for i, tail in enumerate(tails):
        want = sum(idf[t] * (P.K1 + 1) / (1 + P.K1 * (1 - P.B + P.B * len(tail) / 200.0)) for t in tail if t <= 600)
        assert np.isclose(scores[i], want, rtol=1e-5)


def plain_windows(tails, idf, mean, length):
    """The same filling with all postings kept and every tail ranked for each seed."""

    class All(P.Index):
        def keep(self, unused):
            pass

    lazy, P.nearest = P.nearest, lambda score, least: np.argsort(-score, kind="stable")
    try:
        return list(P.fill(tails, All(tails, idf, mean), length))
    finally:
        P.nearest = lazy


def test_dropped_postings_change_no_window():
    rng = np.random.default_rng(7)
    for case in range(6):
        # skewed terms, many equal tails (ties) and lengths from 1 to the window
        base = [np.minimum(rng.zipf(1.4, rng.integers(1, 128)), 800) for _ in range(300)]
        tails = base + [base[0]] * 120 + [np.array([0])] * 50
        n = len(tails)
        df = np.bincount(np.concatenate([np.unique(t) for t in tails]), minlength=801)
        idf = np.log1p((n - df + 0.5) / (df + 0.5)).astype(np.float32)
        got = list(P.fill(tails, P.Index(tails, idf, 60.0), 128))
        assert got == plain_windows(tails, idf, 60.0, 128)
        assert sum(b - a for w in got for _, a, b in w) == sum(map(len, tails))


def test_nearest_is_a_prefix_of_the_whole_order():
    rng = np.random.default_rng(8)
    for _ in range(50):
        score = rng.integers(-1, 6, rng.integers(1, 200)).astype(float)
        whole = np.argsort(-score, kind="stable")
        near = P.nearest(score, 16)
        assert len(near) >= min(16, len(score)) and (near == whole[: len(near)]).all()
