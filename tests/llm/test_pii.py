from __future__ import annotations

import hashlib
import random
import re
import time

import pytest
from conftest import ODD, documents
from pyspark.sql import functions as F

from rollcall.llm import pii

RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    out = []
    for kind, rule in RULES.items():
        for m in re.finditer(rule, text):
            d = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else True,
                  "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def noisy(n):
    parts = ["a.b@c.de", "x@y", "@", ".", "1.2.3.4", "0255.1.1.01", "256.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (968) 555-9369", "+12", "+", "é😀", " ", "\n", "12", "-", "a@b.c%d@e.f", "49927398716", "(", ")", "a@b.c.", "..", "%", "+4 "]
    return "".join(random.choices(parts, k=n))


def test_base_spans_match_brute_force(spark):
    random.seed(3)
    rows = [(100 + i, noisy(random.randint(0, 60))) for i in range(400)] + ODD
    got = {r["doc_id"]: r for r in pii.op1_pii(documents(spark, rows)).collect()}
    for k, t in rows:
        want = brute(t or "")
        assert got[k]["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest(), (t, want, got[k]["spans"])
        assert [got[k][f"n_{n}"] for n in RULES] == [sum(w.startswith(n + ":") for w in want) for n in RULES]
        assert [s for s in got[k]["spans"].split(",") if s.split(":")[0] in RULES] == want


def test_real_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    found = 0
    for r in pii.op1_pii(docs).collect():
        want = brute(text[r["doc_id"]])
        found += len(want)
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
    assert found > 20


def test_added_kinds_need_checksum_or_context(spark):
    rows = [(1, "konto GB82 WEST 1234 5698 7654 32 ."), (2, "konto GB83 WEST 1234 5698 7654 32 ."), (3, "call 020 7946 0958 now"), (4, "sum 020 7946 0958 now")]
    got = {r["doc_id"]: r["spans"] for r in pii.op1_pii(documents(spark, rows)).collect()}
    assert "iban:6:33" in got[1] and "iban" not in got[2]
    assert "phone_local:5:18" in got[3] and "phone_local" not in got[4]


def test_redaction(spark):
    df = pii.find_pii(spark.createDataFrame([("mail a@b.co and 1.2.3.4!",)], "text string"))
    every = F.concat(*[F.col(f"pii_{k}") for k in pii.PATTERNS])
    assert df.select(pii.redacted(F.col("text"), every).alias("t")).first()["t"] == "mail [EMAIL] and [IP]!"


def test_time_is_in_proportion_on_long_runs(spark):
    rows = [(1, "a" * 300_000), (2, "1" * 300_000), (3, "1." * 150_000), (4, "+1(" * 100_000), (5, "a.b-" * 75_000 + "@"), (6, "x@" + "y." * 100_000), (7, "1 " * 150_000)]
    assert len(pii.op1_pii(documents(spark, rows)).collect()) == 7


def test_native_and_empty(spark):
    out = pii.op1_pii(documents(spark, []))
    assert out.collect() == []
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


IBANS = ["DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32", "FR14 2004 1010 0505 0001 3M02 606", "NO93 8601 1117 947", "MT84 MALT 0110 0001 2345 MTLC AST0 01S", "DE89370400440532013000"]


def test_account_numbers_among_other_words(spark):
    rows, want = [], {}
    for i, iban in enumerate(IBANS):
        for j, (before, after) in enumerate([("", ""), ("IBAN ", " BIC COBADEFFXXX"), ("é😀 ", " 2024 A B C"), ("NO12 AB12 ", " Bank"), ("", " GB82"), ("x", ""), ("", "x")]):
            rows.append((100 * i + j, f"{before}{iban}{after}"))
            want[100 * i + j] = [] if j > 4 else [(len(before), len(before) + len(iban))]
    rows.append((9000, " ".join(IBANS)))
    want[9000] = [(at := sum(len(x) + 1 for x in IBANS[:k]), at + len(x)) for k, x in enumerate(IBANS)]
    other = f"XX{98 - int('123456789012345' + '333300') % 97:02d} 1234 5678 9012 345"  # a country without a known length
    rows.append((9001, f"{other} BIC AB"))
    want[9001] = [(0, len(other))]
    for r in pii.op1_pii(documents(spark, rows)).collect():
        got = [tuple(map(int, s.split(":")[1:])) for s in r["spans"].split(",") if s.startswith("iban:")]
        assert got == want[r["doc_id"]], (dict(rows)[r["doc_id"]], got)


def test_context_reaches_over_other_matches(spark):
    rows = [(1, "Tel. 030 123 4567, 030 123 4568"), (2, "Tel. 12 345 678 or 030 123 4568"), (3, "Tel. 030 123 4567, " + "x" * 40 + " 030 123 4568")]
    got = {r["doc_id"]: [s for s in r["spans"].split(",") if s.startswith("phone_local")] for r in pii.op1_pii(documents(spark, rows)).collect()}
    assert got[1] == ["phone_local:5:17", "phone_local:19:31"]
    assert got[2][-1] == "phone_local:19:31"
    assert got[3] == ["phone_local:5:17"]


def test_time_is_in_proportion_on_many_matches(spark):
    rows = [(1, "é " + "AB12 " * 6_000), (2, "é " + "a@b.c " * 5_000), (3, "AB12" * 75_000)]
    assert len(pii.op1_pii(documents(spark, rows)).collect()) == 3


def test_many_matches_in_proportion(spark):
    took = {}
    for n in (20_000, 200_000):
        docs = documents(spark, [(1, "é a@b.c; " * n)])
        began = time.perf_counter()
        row = pii.find_pii(docs, kinds=("email",)).select(F.size("pii_email").alias("n"), F.element_at("pii_email", -1).alias("last"), pii.redacted(F.col("text"), F.col("pii_email")).alias("t")).first()
        took[n] = time.perf_counter() - began
        assert row["n"] == n and (row["last"]["start"], row["last"]["end"]) == (9 * n - 7, 9 * n - 2)
        assert row["t"] == "é [EMAIL]; " * n
    assert took[200_000] < 20 * took[20_000] + 5, took


@pytest.mark.parametrize("most", [1, 2, 3, 7])
def test_blocks_of_matches_change_nothing(spark, most, monkeypatch):
    rows = [(1, "mail a@b.c " + "x " * 30 + "1.2.3.4, tel. 030 123 4567, 030 123 4568 " + " ".join(IBANS) + " a@b.c, 1.2.3.4, +49 30 1234567"), (2, "a@b.c"), (3, "a@1.2.3.4 a@b.c 5.6.7.8")]
    every = F.concat(*[F.col(f"pii_{k}") for k in pii.PATTERNS])
    read = lambda: pii.find_pii(documents(spark, rows)).select("doc_id", every.alias("s"), pii.redacted(F.col("text"), every).alias("t")).orderBy("doc_id").collect()
    want = read()
    monkeypatch.setattr(pii._folded, "__defaults__", (most,))
    monkeypatch.setattr(pii, "BLOCK", most)
    assert read() == want
