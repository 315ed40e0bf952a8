"""Disk: what all prefixes shuffle is dealt into slices that are shuffled one after another."""

import random

from pyspark.sql import functions as F

from millrace.llm import jaccard
from millrace.llm.common import Scratch


def test_prefixes_are_shuffled_by_slices(spark, monkeypatch):
    """pipeline, op6: no write sees half of the shared tokens or more; links are those of brute force."""
    rng, texts = random.Random(5), []
    for _ in range(40):
        words = [f"w{rng.randrange(5000)}" for _ in range(60)]
        near = words[:30] + ["other"] + words[31:]
        texts += [" ".join(words), " ".join(near), " ".join(words[::-1])]
    shared, write = [], Scratch.write

    def counted(self, df, name):
        out = write(self, df, name)
        if name == "shared":
            shared.append(out.count())
        return out

    monkeypatch.setattr(Scratch, "write", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(docs, percent=80).collect()}
    sets = [{tuple(w[i : i + 3]) for i in range(len(w) - 2)} for w in map(str.split, texts)]
    least = [min(j for j, t in enumerate(sets) if 100 * len(s & t) >= 80 * len(s | t)) for s in sets]
    assert got == dict(enumerate(least)) and len(set(least)) == 80
    assert sum(shared) > 100 and max(shared) < 0.5 * sum(shared)


def test_slices_are_one_table(spark):
    """Each slice is made when the one before is written."""
    done = []

    def slices():
        for k in range(3):
            done.append(k)
            yield spark.range(k, k + 2).withColumn("at", F.lit(len(done)))

    scratch = Scratch(spark, "slices")
    out = scratch.write_slices(slices(), "numbers")
    assert sorted((r["id"], r["at"]) for r in out.collect()) == [(0, 1), (1, 1), (1, 2), (2, 2), (2, 3), (3, 3)]
    scratch.drop(out)
