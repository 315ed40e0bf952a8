"""Licence scans with a positional rare-token index, in DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, Scratch, lower_ascii

#: Base phrases and their labels (fixed by the contract).
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: label, licence notice, key phrase that a file must hold.
TEMPLATES = (
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction", "permission is hereby granted free of charge"),
    ("apache", "licensed under the apache license version 2 0", "apache license"),
    ("gpl", "licensed under the gnu general public license version 3", "general public license"),
    ("gpl", "free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gnu general public license"),
    ("lgpl", "licensed under the gnu lesser general public license version 3", "lesser general public license"),
    ("agpl", "licensed under the gnu affero general public license version 3", "affero general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    ("mpl", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission to use copy modify and or distribute this software"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    ("cc-by", "licensed under cc by 4 0", "cc by 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc0", "dedicated to the public domain under cc0 1 0 universal", "cc0 1 0"),
)
#: Function words and numbers aren't indexed.
STOP = set("a an and any are as at be by can for free from in is it of on or that the this to under use v with without you your 0 1 2 3 4".split())
#: Share of a template's IDF that must agree on one offset.
COVERAGE = 0.6
#: Highest-IDF licence words of a file that are looked up.
LOOKUP = 64


def _postings() -> list[tuple[str, int, int]]:
    """(word, template, position) of all indexed words."""
    return [(w, t, p) for t, (_, notice, _) in enumerate(TEMPLATES) for p, w in enumerate(notice.split()) if w not in STOP]


def vocabulary() -> list[str]:
    return sorted({w for w, _, _ in _postings()} | {w for phrase, _ in BASE for w in phrase.split()})


def _phrase_starts(hits: Column, phrase: str) -> Column:
    """Word positions at which a phrase of indexed words starts; hits are in text order."""
    words = phrase.split()

    def here(h, i):
        ok = h["word"] == words[0]
        for k, w in enumerate(words[1:], 1):
            later = F.get(hits, (i + k).cast("int"))
            ok = ok & F.coalesce((later["word"] == w) & (later["pos"] == h["pos"] + k), F.lit(False))
        return ok

    return F.transform(F.filter(hits, here), lambda h: h["pos"])


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", coverage: float = COVERAGE, lookup: int = LOOKUP, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    One pass finds the positions of indexed licence words in every whole text; their
    document frequencies over all documents give the IDF.  Each file's highest-IDF words
    are joined to the template postings, file position less template position is the
    offset, and a template is found where the words that agree on one offset hold the
    given share of its IDF and its key phrase occurs.  Phrases labelled in BASE always
    count; the score is the best template's share, 1 for a base phrase, to six places.  Null text is empty: no words, no labels, score 0.  Repeated rows are kept.
    Other columns are not read.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "licences")
    vocab = vocabulary()
    words = docs.select(
        F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("th"),
        F.regexp_extract_all(F.coalesce(lower_ascii(F.col(text)), F.lit("")), F.lit(WORD), F.lit(0)).alias("words"),
    )
    some = F.arrays_overlap("words", F.array(*(F.lit(w) for w in vocab)))
    at = F.filter(
        F.transform("words", lambda w, i: F.struct(i.cast("int").alias("pos"), w.alias("word"))), lambda h: h["word"].isin(vocab)
    )
    joined = F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" "))
    keys = F.filter(
        F.array(*(F.when(F.contains(joined, F.lit(f" {key} ")), F.lit(t)) for t, (_, _, key) in enumerate(TEMPLATES))),
        lambda k: k.isNotNull(),
    )
    found = scratch.write(
        words.select(
            "doc_id", "th", F.size("words").cast("long").alias("n_words"),
            F.when(some, at).alias("hits"), F.when(some, keys).alias("keys"),
        ),
        "found",
    )
    n = found.count()
    df = {
        r["word"]: r["n"]
        for r in found.select(F.explode(F.array_distinct(F.transform("hits", lambda h: h["word"]))).alias("word"))
        .groupBy("word").agg(F.count("*").alias("n")).collect()  # at most the words of the index
    }
    idf = spark.createDataFrame([(w, float(_idf(n, df.get(w, 0)))) for w in vocab], "word string, idf double")
    weight = F.create_map(*(x for w in vocab for x in (F.lit(w), F.lit(float(_idf(n, df.get(w, 0)))))))
    postings = spark.createDataFrame(_postings(), "word string, template int, at int").join(idf, "word")
    totals = postings.groupBy("template").agg(F.sum("idf").alias("total"))

    ranked = F.slice(
        F.array_sort(F.array_distinct(F.transform("hits", lambda h: F.struct((-F.element_at(weight, h["word"])).alias("w"), h["word"].alias("word"))))), 1, lookup
    )
    files = found.where("hits is not null").select("doc_id", "th", "hits", "keys").dropDuplicates(["doc_id", "th"])
    rare = files.select("doc_id", "th", "keys", "hits", F.transform(ranked, lambda r: r["word"]).alias("rare"))
    votes = (
        rare.select("doc_id", "th", "keys", F.explode(F.filter("hits", lambda h: F.array_contains(F.col("rare"), h["word"]))).alias("h"))
        .select("doc_id", "th", "keys", "h.word", "h.pos")
        .join(F.broadcast(postings), "word")  # the index: a constant of the code
        .groupBy("doc_id", "th", "template", (F.col("pos") - F.col("at")).alias("offset"))
        .agg(F.sum("idf").alias("agreed"), F.first("keys").alias("keys"))
        .join(F.broadcast(totals), "template")
        .where((F.col("agreed") >= coverage * F.col("total")) & F.array_contains(F.col("keys"), F.col("template")))
    )
    label = F.element_at(F.array(*(F.lit(x) for x, _, _ in TEMPLATES)), F.col("template") + 1)
    labelled = votes.groupBy(F.col("doc_id").alias("_id"), F.col("th").alias("_th")).agg(
        F.collect_set(label).alias("more"), F.least(F.lit(1.0), F.max(F.col("agreed") / F.col("total"))).alias("covered")
    )
    none = F.array().cast("array<int>")
    starts = [F.coalesce(_phrase_starts(F.col("hits"), p), none) for p, _ in BASE]
    places = F.concat(*starts)
    base = F.array_compact(F.array(*(F.when(F.size(s) > 0, F.lit(x)) for s, (_, x) in zip(starts, BASE, strict=True))))
    out = found.select("doc_id", "th", "n_words", places.alias("places"), base.alias("base"))
    out = out.join(labelled, out["doc_id"].eqNullSafe(labelled["_id"]) & (out["th"] == labelled["_th"]), "left")
    every = F.array_sort(F.array_distinct(F.concat("base", F.coalesce("more", F.array().cast("array<string>")))))
    return out.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min("places").cast("long").alias("first_word"), F.array_max("places").cast("long").alias("last_word"),
        F.array_join(F.array_sort("base"), ",").alias("base_labels"), F.array_join(every, ",").alias("labels"),
        F.round(F.greatest(F.when(F.size("places") > 0, 1.0).otherwise(0.0), F.coalesce("covered", F.lit(0.0))), 6).alias("score"),
    )


def _idf(n: int, df: int) -> float:
    return math.log(1 + (n + 1) / (df + 1))
