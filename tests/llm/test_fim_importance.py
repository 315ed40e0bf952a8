"""Fill-in-middle and importance resampling against brute force, with their edge cases."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import common, fim, importance

EXTRA = "n_units form held h1 n a b n_words weight score rank at id fit place part start text_no".split()


def texts():
    rng = random.Random(4)
    made = ["".join(rng.choice("ab Cd éß😀.\n\t1<>PSM") for _ in range(rng.randrange(200))) for _ in range(60)]
    return [None, "", " \n", "a", "A b", "x <P> y", "ends with <", "S> starts", "tail   ", "word " * 4_000, "é" * 3_000, " " * 5_000, made[0], made[0], *made]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i if i % 17 else None, t) for i, t in enumerate(texts())] + [(3, "a")] * 3 + [(None, None)] * 2
    return spark.createDataFrame([(*r, *("x" for _ in EXTRA)) for r in rows], ", ".join(["doc_id long", "text string", *(f"{c} string" for c in EXTRA)])).repartition(3)


def test_fill_in_middle(docs):
    aside = common.set_aside(docs, fim.NEW)
    from pyspark.sql import functions as F

    out = fim.fill_in_middle(docs)
    rows = out.withColumn("again", fim.restore(F.col("fim_text"), F.col("form"))).collect()
    assert len(rows) == docs.count() and {r.form for r in rows} == {"plain", "psm", "spm"}
    for r in rows:
        text = r.text or ""
        h = hashlib.sha256(f"42:{'' if r.doc_id is None else r.doc_id}".encode()).hexdigest()
        h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
        units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
        a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
        pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
        plain = not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50
        want = ("plain", None, None, text) if plain else ("spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}") if h4 % 100 < 80 else ("psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}")
        assert (r.n_units, r.form, r.prefix_chars, r.middle_chars, r.fim_text) == (len(units), *want)
        assert r.again == text and all(r[aside.get(c, c)] == "x" for c in EXTRA)


def test_a_million_words_hold_no_units():
    import tracemalloc

    text = "word " * 1_000_000
    tracemalloc.start()
    n = fim.count_units(text)
    ends = fim.unit_ends(text, 10, 900_000)
    held = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 1_000_001 and ends == [49, 4_499_999] and held < 100_000


def brute(text):
    words = common.words_of((text or "").encode())
    return len(words), [zlib.crc32(b" ".join(words[i : i + n])) % 10_000 for n in (1, 2, 3) for i in range(len(words) - n + 1)]


@pytest.mark.parametrize("chunk", [40, 1 << 20])
def test_features(monkeypatch, chunk):
    monkeypatch.setattr(importance, "CHUNK", chunk)
    rows = [*texts(), " ".join(c * n for c, n in zip("qrstu", (255, 256, 257, 258, 9_000), strict=True))]
    words, found = np.zeros(len(rows), int), [[] for _ in rows]
    for k, counts, bucket, text in importance.text_features(pa.array(rows)):
        words[k : k + len(counts)] += counts
        for b, t in zip(bucket.tolist(), text.tolist(), strict=True):
            found[k + t].append(b)
    for t, n, f in zip(rows, words, found, strict=True):
        assert (n, sorted(f)) == (brute(t)[0], sorted(brute(t)[1]))


def test_resampling(spark, docs):
    bench = spark.createDataFrame([("a b cd",), (None,), ("word word word",)], "text string")
    weighted = importance.importance(docs, bench)
    out = importance.draw(weighted, percent=50, min_words=3)
    aside = common.set_aside(docs, (*importance.NEW, *importance.DRAWN))
    rows = out.collect()
    features = [brute(r.text)[1] for r in rows]
    s, t = np.zeros(10_000), np.zeros(10_000)
    for f in features:
        np.add.at(s, f, 1)
    for r in bench.collect():
        np.add.at(t, brute(r.text)[1], 1)
    gain = [math.floor(1000 * math.log((y + 1) * (s.sum() + 10_000) / ((x + 1) * (t.sum() + 10_000)))) for x, y in zip(s, t, strict=True)]
    want = []
    for r, f in zip(rows, features, strict=True):
        h = int(hashlib.sha256(f"42:{'' if r.doc_id is None else r.doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        assert (r.n_words, r.n_features, r.weight, r.score) == (brute(r.text)[0], len(f), weight, score)
        assert all(r[aside.get(c, c)] == "x" for c in EXTRA)
        if r.n_words >= 3:
            want.append((-score, -1 if r.doc_id is None else r.doc_id))
        else:
            assert r["rank"] is None
    assert len(rows) == docs.count()
    drawn = sorted((r["rank"], -r.score, -1 if r.doc_id is None else r.doc_id) for r in rows if r["rank"])
    assert [d[1:] for d in drawn] == sorted(want)[: len(want) // 2] and [d[0] for d in drawn] == list(range(1, len(want) // 2 + 1))


def test_many_rows_of_one_id_and_score_are_dealt_out(spark):
    same = spark.range(0, 4_000, 1, 8).selectExpr("cast(null as long) doc_id", "'a b c' text")
    out = importance.draw(importance.importance(same, same), percent=10, min_words=1).where("rank is not null").collect()
    assert sorted(r["rank"] for r in out) == list(range(1, 401))


def test_empty_tables(spark, docs):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert fim.fill_in_middle(none).collect() == []
    assert importance.draw(importance.importance(none, none)).collect() == []
    assert {r.weight for r in importance.importance(docs.where("text = 'a'"), none).collect()} and importance.bucket_counts(none).sum() == 0
