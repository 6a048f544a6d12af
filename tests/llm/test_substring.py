from __future__ import annotations

import hashlib
import random

import pytest
from conftest import ODD, documents

from rollcall.llm import substring as S


def brute(rows, window):
    seen, out = set(), {}
    for k, t in sorted(rows, key=lambda r: r[0]):
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            key = tuple(w[s: s + window])
            if key in seen:
                gone[s: s + window] = [True] * window
            seen.add(key)
        out[k] = (len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g))
    return out


def table(seed, window):
    rng = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(40)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passages = [text(n) for n in (window, window + 1, 3 * window, window - 1)]
    rows = list(ODD)
    for i in range(150):
        w = text(rng.randint(0, 60))
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, len(w))
            w[at:at] = rng.choice(passages)
        rows.append((100 + i, " ".join(w)))
    rows += [(400 + i, rng.choice(rows[20:40])[1]) for i in range(40)]
    rows += [(500, "x " * 100), (501, "x " * 50 + "y"), (502, "a b " * 60)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("window, gram, width", [(20, 5, 2**44), (20, 8, 64), (6, 3, 2**44)])
def test_matches_brute_force(spark, window, gram, width):
    """Also with a sketch so narrow that nearly every counter is shared."""
    rows = table(window, window)
    want = brute(rows, window)
    for r in S.deduplicated(documents(spark, rows), window, gram, width, text_out=True).collect():
        n, gone, kept = want[r["doc_id"]]
        assert (r["n_words"], r["n_removed"], r["kept_text"]) == (n, gone, kept.decode() if not (gone == n and n) else r["kept_text"])
        assert r["kept_sha256"] == hashlib.sha256(kept).hexdigest()


def test_odd_tables(spark):
    assert S.op10_substring_dedup(documents(spark, [])).collect() == []
    text = " ".join(f"w{i}" for i in range(30))
    rows = S.op10_substring_dedup(documents(spark, [(1, text), (1, text), (None, text), (2, None)])).collect()
    assert sorted((r["doc_id"] or 0, r["n_words"], r["n_removed"]) for r in rows) == [(0, 30, 0), (1, 30, 30), (1, 30, 30), (2, 0, 0)]
