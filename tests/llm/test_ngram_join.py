from __future__ import annotations

import random
import re

import numpy as np
import pytest
from conftest import ODD, documents

from rollcall.llm import ngram_join as J
from rollcall.llm.components import components


def grams(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    return {tuple(w[i: i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def brute(rows, n, num, den):
    sets = {k: grams(t, n) for k, t in rows}
    up = {k: k for k in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1:]:
            if sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((root(a), root(b)))
                    up[y] = x
    return {k: (len(sets[k]), root(k)) for k in keys}


def family(rng, first, size, words, edits, vocabulary):
    """A text and ever more edited copies of it."""
    base = [rng.choice(vocabulary) for _ in range(words)]
    out = []
    for i in range(size):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            at = rng.randrange(len(w))
            w[at: at + 1] = rng.choice([[rng.choice(vocabulary)], [], [w[at], rng.choice(vocabulary)]])
        out.append((first + i, " ".join(w)))
    return out


@pytest.mark.parametrize("n, num, den", [(4, 85, 100), (5, 80, 100), (3, 1, 2)])
def test_components_match_brute_force(spark, n, num, den):
    rng = random.Random(n)
    vocabulary = [f"w{i}" for i in range(300)]
    line = " ".join(rng.choice(vocabulary) for _ in range(25))
    rows = list(ODD)
    for f, (size, words, edits) in enumerate([(60, 60, 4), (30, 20, 2), (40, 12, 1), (25, 200, 12), (20, 7, 1), (15, 500, 30)]):
        rows += family(rng, 1000 * (f + 1), size, words, edits, vocabulary)
    # a passage that many unlike texts hold
    rows += [(20_000 + i, line + " " + " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 40)))) for i in range(60)]
    rows = [(k, t.upper() if t and k % 7 == 0 else t) for k, t in rows]
    want = brute(rows, n, num, den)
    got = {r["doc_id"]: (r["n_shingles"], r["component"]) for r in J.classes(documents(spark, rows), n, num, den).collect()}
    assert got == want


def test_rounds_and_full_product(spark, monkeypatch):
    """The same with no rounds and with many, and with other bands."""
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(50)]
    rows = family(rng, 1, 70, 50, 6, vocabulary) + family(rng, 500, 40, 30, 5, vocabulary)
    want = brute(rows, 4, 85, 100)
    for rounds, band in ((0, 1.5), (4, 1.02)):
        monkeypatch.setattr(J, "ROUNDS", rounds)
        monkeypatch.setattr(J, "BAND", band)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in J.op6_ngram_jaccard_join(documents(spark, rows)).collect()}
        assert got == want


def test_later_rounds_read_only_rows_that_are_still_apart(spark, monkeypatch):
    """Unlike texts with a common passage take rounds; families that are whole after the
    first links are not read again, however many they are."""
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(2000)]
    line = " ".join(rng.choice(vocabulary) for _ in range(60))
    rows = [(i, line + " " + " ".join(rng.choice(vocabulary) for _ in range(60))) for i in range(40)]
    for f in range(12):
        rows += family(rng, 1000 * (f + 1), 6, 80, 2, vocabulary)
    seen, explode = [], J._one_by_one

    def counted(table, *more):
        out = explode(table, *more)
        if more == ("c",):
            seen.append(out.count())
        return out

    monkeypatch.setattr(J, "_one_by_one", counted)
    got = {r["doc_id"]: (r["n_shingles"], r["component"]) for r in J.classes(documents(spark, rows), 3, 1, 2).collect()}
    assert got == brute(rows, 3, 1, 2)
    assert len(seen) > 1 and all(2 * later < seen[0] for later in seen[1:])


def test_crowded_blocks(spark, monkeypatch):
    """The same if every block with rows of two components takes rounds."""
    monkeypatch.setattr(J, "CROWD", 0)
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)]
    rows = family(rng, 1, 50, 50, 6, vocabulary) + family(rng, 500, 30, 20, 4, vocabulary)
    got = {r["doc_id"]: (r["n_shingles"], r["component"]) for r in J.classes(documents(spark, rows), 4, 85, 100).collect()}
    assert got == brute(rows, 4, 85, 100)


def test_linked_sets_share_a_signature():
    """The bound: any two sets at the threshold agree in some signature."""
    rng = np.random.default_rng(4)
    for _ in range(400):
        size = int(rng.integers(1, 300))
        a = rng.integers(0, 2**63, size).astype(np.uint64)
        most = size * 15 // 100
        drop = int(rng.integers(0, most + 1))
        b = np.concatenate([a[drop:], rng.integers(0, 2**63, int(rng.integers(0, max(0, int(15 * size / 100) - drop) + 1))).astype(np.uint64)])
        a, b = np.unique(a), np.unique(b)
        both = len(np.intersect1d(a, b))
        if not len(b) or 100 * both < 85 * (len(a) + len(b) - both) or np.array_equal(a, b):
            continue
        x = np.concatenate([s for s, _ in J.signatures(a, 85, 100)] or [np.empty(0, np.uint64)])
        y = np.concatenate([s for s, _ in J.signatures(b, 85, 100)] or [np.empty(0, np.uint64)])
        assert len(np.intersect1d(x, y))


def test_odd_tables(spark):
    assert J.op6_ngram_jaccard_join(documents(spark, [])).collect() == []
    rows = J.op6_ngram_jaccard_join(documents(spark, [(1, "a b c d e"), (1, "a b c d e"), (None, "a b c d e"), (2, None)])).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in rows) == [(0, 0), (1, 0), (1, 0), (2, 2)]


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 140)] + [(50, 50), (61, 60)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 140)} | {60: 60, 61: 60}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
