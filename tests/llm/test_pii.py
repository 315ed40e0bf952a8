"""Personal data: the base spans against Python's matcher, proposals, long texts, redaction."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from millrace.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, text or ""):
            d = re.sub(r"[^0-9]", "", m[0])
            if {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else 0, "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]:
                out.append((kind, m.start(), m.end()))
    return out


def card(rng, n=16):
    head = "4" + "".join(rng.choice("0123456789") for _ in range(n - 2))
    return next(head + c for c in "0123456789" if luhn(head + c))


def texts():
    rng = random.Random(2)
    out = [None, "", "é😀 a@b.c", "a@b.c.d_e@f.g x@y", "1.2.3.4.5.6.7.8 999.1.2.3 0001.2.3.255 1.2.3.256", "4111 1111 1111 1111", "4111-1111-1111-1111 5", "5 4111111111111111", "+1+2 345 678 901", "+1 (838) 555-7235.", "+12 3", "@" * 50, "1" * 40, "1 -2 -3"]
    alphabet = "0123456789" * 3 + " .-()+@aZ_%é"
    out += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(120))) for _ in range(300)]
    out += [f"x {card(rng)} y {' '.join(card(rng)[i : i + 4] for i in (0, 4, 8, 12))}" for _ in range(20)]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "z", "w", "v") for i, t in enumerate(rows)], "doc_id long, text string, pii string, held string, base0 string").repartition(3)


def test_base_spans_equal_brute_force(spark):
    rows = texts()
    docs = frame(spark, rows)
    out = pii.detect(docs, pii.Model())
    for r in out.withColumn("digest", pii.digest(F.col("pii"))).collect():
        want = brute(rows[r.doc_id])
        assert [(s.kind, s.start, s.end) for s in r.pii] == want, rows[r.doc_id]
        assert r.digest == ",".join(f"{k}:{a}:{b}" for k, a, b in want) and all(s.base for s in r.pii)
        assert (r.text, r.input_pii, r.held, r.base0) == (rows[r.doc_id], "z", "w", "v")


def test_long_runs_take_linear_time(spark):
    n = 400_000
    rows = ["a" * n, "1" * n, "1." * (n // 2), "1 " * (n // 2), "+" * n, "+1" + " " * n, "a@" * (n // 2), "a@" + "b." * (n // 2), "a@b.c " * 20_000, "10.0.0.1 " * 20_000, " at " * (n // 4), "(1" * (n // 2)]
    got = {r.doc_id: r.n for r in pii.detect(frame(spark, rows), pii.Model([(1.0, 0.0)], dict.fromkeys(range(4), 0.9))).select("doc_id", F.size(F.filter("pii", lambda s: s["base"])).alias("n")).collect()}
    assert [got[i] for i in range(len(rows))] == [0, 0, n // 8, 0, 0, 0, 0, 1, 20_000, 20_000, 0, 0]


@pytest.fixture(scope="module")
def trained(spark):
    rng, rows = random.Random(6), []
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    for i in range(800):
        number = f"{rng.randrange(100, 999)}) {rng.randrange(100, 999)}-{rng.randrange(1000, 9999)}"
        kind = i % 8
        rows.append([
            f"call +1 ({number} now", f"write to {word()}@{word()}.com please", f"pay with card {card(rng)} {word()}", f"host {rng.randrange(200)}.{rng.randrange(200)}.{rng.randrange(200)}.9 is up",
            f"order 20{rng.randrange(10, 24)}-0{rng.randrange(1, 9)}-1{rng.randrange(9)} {rng.randrange(10**9)}", f"serial {rng.randrange(10**15, 10**16)} {word()}", f"version 1.{rng.randrange(300, 999)}.2.3 of {word()}", f"{word()} {word()}",
        ][kind])
    rows += [f"call (212) 555-{1000 + i} now" for i in range(5)] + ["write to jane (at) mail (dot) org please", "pay with card 4111.1111.1111.1111 today", "nothing here 12"]
    docs = frame(spark, rows)
    return rows, docs, pii.fit(docs, spans=5_000)


def test_proposals_are_added_and_base_spans_stay(spark, trained):
    rows, docs, model = trained
    assert set(model.thresholds) >= {2, 3} and all(t >= 0.5 for t in model.thresholds.values())
    out = {r.doc_id: r for r in pii.detect(docs, model).withColumn("clean", pii.redact(F.col("text"), F.col("pii"))).collect()}
    for i, t in enumerate(rows):
        assert [(s.kind, s.start, s.end) for s in out[i].pii if s.base] == brute(t)
        ends = sorted((s.start, s.end) for s in out[i].pii)
        assert all(a[1] <= b[0] for a, b in zip(ends, ends[1:]))
    added = {i: [t[s.start : s.end] for s in out[i].pii if not s.base] for i, t in enumerate(rows)}
    assert sum(bool(a) for a in added.values()) >= 5 and added[800] == ["(212) 555-1000"] and added[len(rows) - 1] == []
    assert added[len(rows) - 2] == ["4111.1111.1111.1111"] and not any(a for i, a in added.items() if i < 800 and i % 8 in (4, 5, 6, 7))
    assert out[800].clean == "call [PHONE] now" and out[0].clean == "call [PHONE] now" and out[len(rows) - 1].clean == rows[-1]


def test_model_and_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    model = pii.fit(none)
    assert model == pii.Model() and pii.detect(none, model).collect() == []
    assert pii.fit(spark.createDataFrame([(1, "no data"), (2, None)], "doc_id long, text string")) == pii.Model()


def test_redaction_of_meeting_spans(spark):
    spans = spark.sql("select 'ab12345cd' as text, array(named_struct('kind', 'phone', 'start', 2, 'end', 5), named_struct('kind', 'card', 'start', 4, 'end', 7)) as pii")
    assert spans.select(pii.redact(F.col("text"), F.col("pii"))).first()[0] == "ab[PHONE]cd"


def test_running_totals(spark):
    for n in (0, 1, 127, 128, 129, 1000):
        a = [(i * 7919) % 101 for i in range(n)]
        got = spark.createDataFrame([(a,)], "a array<int>").select(pii._running(F.col("a"), 0, lambda x, y: x + y)).first()[0]
        assert got == [sum(a[: i + 1]) for i in range(n)]


def test_query(spark):
    from millrace.llm import queries

    out = queries.op11(spark, "/root/testdata/sf0.001").collect()
    text = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert len(out) == len(text)
    for r in out:
        want = brute(text[r.doc_id])
        line = [f"{k}:{a}:{b}" for k, a, b in want]
        assert r.base_sha256 == hashlib.sha256(",".join(line).encode()).hexdigest() and set(line) <= set(r.spans.split(",")) | {""}
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for k, _, _ in want) for x in PATTERNS)
