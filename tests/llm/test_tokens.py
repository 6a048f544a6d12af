from __future__ import annotations

import random
import time

import numpy as np
import pyarrow as pa
from conftest import ODD, SMALL, documents
from tokenizers import Tokenizer

from rollcall.llm import attribution as A
from rollcall.llm import tokens


def test_cached_ids_are_those_of_tokenizers():
    random.seed(1)
    signs = ["a", "the", " ", "  ", "\n", "\t", " \n", "é", "'s", "'ll", "12", "3", "!!", "...", "\x85", " ", " ", "<|endoftext|>", "😀", "\r\n", "_", "-", "x" * 90]
    column = pa.array(["".join(random.choices(signs, k=random.randint(0, 40))) for _ in range(3000)] + ["", None, " ", "\n\n"])
    encoder, whole = tokens.encoder(tokens.vocabulary()), Tokenizer.from_file(tokens.vocabulary())
    got = []
    for _, _, offsets, ids, bounds in encoder.texts(column):
        got += [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])]
    assert got == [e.ids for e in whole.encode_batch([t or "" for t in column.to_pylist()], add_special_tokens=False)]


def test_cache_starts_again_and_stays_right(monkeypatch):
    monkeypatch.setattr(tokens, "_MOST_IDS", 50)
    encoder, whole = tokens.Encoder(tokens.vocabulary()), Tokenizer.from_file(tokens.vocabulary())
    for i in range(20):
        t = " ".join(f"w{j}x{i}" for j in range(30))
        _, _, _, ids, _ = next(encoder.texts(pa.array([t])))
        assert ids.tolist() == whole.encode(t).ids


def brute(text):
    """Line of each token from the tokenizer's own character offsets."""
    enc = Tokenizer.from_file(tokens.vocabulary()).encode(text, add_special_tokens=False)
    line = np.cumsum([0] + [c == "\n" for c in text])[:-1] if text else []
    counts = {}
    for a, b in enc.offsets:
        held = {}
        for p in range(a, b):
            if text[p] != "\n":
                held[int(line[p])] = held.get(int(line[p]), 0) + len(text[p].encode())
        key = max(sorted(held), key=lambda k: held[k]) if held else -1
        counts[key] = counts.get(key, 0) + 1
    return counts, len(enc.ids)


def test_lines_match_brute_force(spark):
    rows = [(1000 + r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()][:60]
    rows += [o for o in ODD if o[0] != 5] + [(9001, "a\n\n\nb"), (9002, "\n"), (9003, "é\n😀😀 x\r\n y")]
    got = {}
    for r in A.op3_token_counts(documents(spark, rows)).collect():
        got.setdefault(r["doc_id"], {})[r["section"]] = (r["n_tokens"], r["doc_tokens"])
    for k, t in rows:
        want, total = brute(t or "")
        assert {s: n for s, (n, _) in got[k].items() if n} == want
        assert all(d == total for _, d in got[k].values()) and sum(n for n, _ in got[k].values()) == total


def test_rules_for_crossing_tokens(spark):
    docs = documents(spark, [(1, "unbelievable stories")]).selectExpr("doc_id", "text", "array(named_struct('start', 0, 'end', 3), named_struct('start', 3, 'end', 100), named_struct('start', 5, 'end', 5)) as sections")
    total = len(Tokenizer.from_file(tokens.vocabulary()).encode("unbelievable stories").ids)
    for rule in A.RULES:
        rows = A.attributed(docs, rule=rule).collect()
        assert abs(sum(r["n_tokens"] for r in rows) - total) < 1e-9 and len(rows) == 4
    counts, crossing, outside = A.allocate(np.array([0, 4]), np.array([4, 6]), np.array([0, 1]), np.array([1, 5]), "most")
    assert counts.tolist() == [0, 2] and crossing.tolist() == [0, 2] and outside == 0
    counts, _, _ = A.allocate(np.array([0, 4]), np.array([4, 6]), np.array([0, 1]), np.array([1, 5]), "first")
    assert counts.tolist() == [1, 1]
    counts, _, outside = A.allocate(np.array([0, 4]), np.array([4, 6]), np.array([0, 1]), np.array([1, 5]), "split")
    assert counts.tolist() == [0.25, 1.25] and outside == 0.5


def test_empty_table(spark):
    assert A.op3_token_counts(documents(spark, [])).collect() == []


def test_time_is_in_proportion_to_lines(spark):
    took = {}
    for n in (20_000, 200_000):
        docs = documents(spark, [(1, "é a line.\n" * n)])
        began = time.perf_counter()
        rows = A.op3_token_counts(docs).selectExpr("count(*) as n", "sum(n_tokens) as t", "max(doc_tokens) as d", "max(end) as e").first()
        took[n] = time.perf_counter() - began
        assert (rows["n"], rows["t"], rows["e"]) == (n + 2, rows["d"], 10 * n)
    assert took[200_000] < 20 * took[20_000] + 5
