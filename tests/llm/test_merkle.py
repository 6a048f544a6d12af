from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict

import duckdb
from conftest import SMALL

from rollcall.llm import merkle as M

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, idx long, tree string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, more=0):
    n = None if row[4] is None else row[4] + more
    fields = [row[0], row[3], row[2], n, row[1]]
    return sha("".join("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def tree(digests):
    """Levels of a tree, leaves first."""
    levels = [digests]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i: i + 2])) for i in range(0, len(levels[-1]), 2)])
    return levels


def brute(rows):
    of_lang = defaultdict(list)
    for r in rows:
        of_lang[r[2]].append(r)
    langs = sorted(of_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        of_lang[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[lang] = tree([leaf(r) for r in of_lang[lang]])
    top = tree([trees[x][-1][0] for x in langs])
    out = []
    for k, lang in enumerate(langs):
        for pos, r in enumerate(of_lang[lang]):
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            now, proof = leaf(r, int(bad)), []
            for levels, i in ((trees[lang], pos), (top, k)):
                for nodes in levels[:-1]:
                    pair = nodes[i & ~1: (i | 1) + 1]
                    proof += [d for j, d in enumerate(pair) if j != i & 1]
                    pair[i & 1] = now
                    now, i = sha("".join(pair)), i >> 1
            out.append((r[0], leaf(r), trees[lang][-1][0], top[-1][0], sha("".join(proof)), now, now == top[-1][0]))
    return sorted(out, key=str)


def run(spark, rows):
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    return sorted((tuple(r) for r in M.op11_merkle_manifest(docs).collect()), key=str)


ODD = [
    (7, "a", "en", "s", 1), (7, "a", "en", "s", 1), (7, "b", "en", None, None), (None, "c", "en", "s", 3), (None, None, None, None, None), (None, None, None, None, None),
    (14, "", "", "", 0), (2**63 - 1, "é😀" * 50_000, "zz", "x", 2**63 - 1), (-5, "neg", "En", "s", -1), *[(i, f"t{i}", "de", "s", i) for i in range(33)],
]


def test_odd_rows(spark):
    assert run(spark, ODD) == brute(ODD)


def test_sizes_around_powers_of_two(spark):
    rows = [(i, f"t{i}", f"l{n}", "s", i) for n in (1, 2, 3, 4, 5, 8, 9) for i in range(100 * n, 100 * n + n)]
    assert run(spark, rows) == brute(rows)


def test_one_row_one_language_and_none(spark):
    for rows in ([(3, "x", None, "s", 1)], [(i, "x", "en", "s", 1) for i in range(6)], []):
        assert run(spark, rows) == brute(rows) if rows else run(spark, rows) == []


def test_a_language_for_every_row(spark):
    rows = [(i, "x", f"{i:04}", "s", 1) for i in range(37)]
    assert run(spark, rows) == brute(rows)


def test_several_steps_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(M, "BITS", 2)
    rows = [(i, f"t{i}", "en" if i % 3 else "fr", "s", i) for i in range(150)]
    assert run(spark, rows) == brute(rows)


def test_tables_and_sql(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in docs.collect()]
    want = brute(rows)
    assert sorted((tuple(r) for r in M.op11_merkle_manifest(docs).collect()), key=str) == want
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SMALL}/documents.parquet'")
    assert sorted(con.execute(M.ORACLE).fetchall(), key=str) == want


def test_proofs_and_tables_left(spark, tmp_path):
    docs = spark.createDataFrame([(i, "x", "en", "s", 1, 1, "x") for i in range(5)], SCHEMA)
    for r in M.manifest(docs).collect():
        assert len(r["proof"]) == 64 * (1 if r["doc_id"] == 4 else 3)
