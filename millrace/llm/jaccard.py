"""N-gram Jaccard join with prefix filters under several global token orders."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, packed
from .components import connected_components
from .shingles import _M1, _M3, mix, shingle_sets

#: Earlier prefix tokens by which a pair that was met before is recognised.
RECALL = 4
#: Cells of a set's sketch: how many of its tokens fall in each, FULL at most.
SKETCH, FULL = 128, 127
#: Rounds of pairs whose number is at most twice that of the prefix tokens.  A second one spares looser
#: laws, whose near copies share fewer prefix tokens, most pairs of the last round.
ROUNDS, LOOSE_ROUNDS = 1, 2
#: Slices, by hash, in which all prefixes are shuffled one after another: a shuffle's files on disk are
#: those of a slice or two.  Each slice reads the sets again.
SLICES = 3


def _needed(n, percent: int):
    """Smallest overlap of a set of n with any partner: ceil(n * percent / 100)."""
    return -(-n * percent // 100)


def _due(n: Column, percent: int) -> Column:
    return F.ceil(n * percent / F.lit(100))


def _first(n: Column, percent: int) -> Column:
    """Length of the shortest prefix that shares a token with any partner."""
    return n - _due(n, percent) + 1


def _overlap(n: Column, m: Column, percent: int) -> Column:
    """Smallest overlap of similar sets of n and m."""
    return F.ceil((n + m) * percent / F.lit(100 + percent))


def _slice(key: str, k: int) -> Column:
    """The rows of slice k by ``key``, a hash."""
    return F.pmod(F.col(key), F.lit(SLICES)) == k


def _at_most(x: str, y: str) -> Column:
    """Most tokens that sets of these sketches can share: tokens are shared within a cell.
    ``over`` counts those beyond FULL in their cell."""
    cells = F.aggregate(F.zip_with(f"{x}.sketch", f"{y}.sketch", lambda a, b: F.least(a, b)), F.lit(0), lambda n, k: n + k.cast("int"))
    return cells + F.least(f"{x}.over", f"{y}.over")


def _unlike(x: str, y: str) -> Column:
    """Fewest tokens that only one of two sets has: one in each cell of unlike parity."""
    return sum(F.bit_count(F.col(f"{x}.{p}").bitwiseXOR(F.col(f"{y}.{p}"))) for p in ("odd1", "odd2"))


def _lists(sets: list[np.ndarray]) -> pa.ListArray:
    sizes = np.cumsum([0, *map(len, sets)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64)))


def _sets(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """doc_id, th, n, f1, f2 (fingerprint of the set), the long prefix in hash order,
    sketch, over, odd1, odd2 (which of its cells are odd)."""

    def make(batches):
        for batch in batches:
            at = 0
            for sets in shingle_sets(batch.column(2), shingle):
                n, f1, f2, prefix, cells = [], [], [], [], []
                for s in sets:
                    u = s.view(np.uint64)
                    n.append(len(s))
                    f1.append(int(mix(u + _M1).sum(dtype=np.uint64).view(np.int64)))
                    f2.append(int(mix(u * _M3).sum(dtype=np.uint64).view(np.int64)))
                    first = len(s) - _needed(len(s), percent) + 1
                    # one more shared token is due for each token added to the prefix; a set
                    # that only its equals can match needs no prefix
                    prefix.append(s[: 2 * first] if 100 * len(s) >= percent * (len(s) + 1) else s[:0])
                    cells.append(np.bincount(s % SKETCH, minlength=SKETCH))
                ids, hashes = batch.column(0).slice(at, len(sets)), batch.column(1).slice(at, len(sets))
                at += len(sets)
                ends = pa.array(np.arange(len(sets) + 1, dtype=np.int32) * SKETCH)
                counts = np.stack(cells)
                held = np.minimum(counts, FULL)
                sketch = pa.ListArray.from_arrays(ends, pa.array(held.reshape(-1).astype(np.int8)))
                over = pa.array((counts - held).sum(axis=1).astype(np.int64))
                odd = np.packbits(counts & 1, axis=1).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [ids, hashes, *(pa.array(x, pa.int64()) for x in (n, f1, f2)), _lists(prefix), sketch, over, pa.array(odd[:, 0].copy()), pa.array(odd[:, 1].copy())],
                    ["doc_id", "th", "n", "f1", "f2", "prefix", "sketch", "over", "odd1", "odd2"],
                )

    return docs.select("doc_id", F.xxhash64("text").alias("th"), "text").mapInArrow(
        make, "doc_id long, th long, n long, f1 long, f2 long, prefix array<long>, sketch array<tinyint>, over long, odd1 long, odd2 long"
    )


def _shingles(texts: DataFrame, shingle: int) -> DataFrame:
    """(id, set) of (id, text)."""

    def make(batches):
        for batch in batches:
            at = 0
            for sets in shingle_sets(batch.column(1), shingle):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(sets)), _lists(sets)], ["id", "set"])
                at += len(sets)

    return texts.mapInArrow(make, "id long, `set` array<long>")


def _verify(pairs: DataFrame, sets: DataFrame, source: DataFrame, shingle: int, percent: int, scratch: Scratch, sketched: bool = True) -> DataFrame:
    """The pairs (a, b) that pass the hash order's filter and, if ``sketched``, the
    sketches' too, and then the exact test.

    In hash order, prefixes of twice the least length share one token more than that
    length: only prefixes are joined for this.  Whole sets are made again from the texts,
    and only for the pairs that are left.
    """
    of = sets.select("id", "n", "pb", *(["sketch", "over"] if sketched else []))
    due = 1 + F.least(_first(F.col("x.n"), percent), _first(F.col("y.n"), percent))
    left = pairs.join(of.alias("x"), F.col("a") == F.col("x.id")).join(of.alias("y"), F.col("b") == F.col("y.id"))
    left = left.where(F.size(F.array_intersect("x.pb", "y.pb")) >= due)
    if sketched:
        left = left.where(_at_most("x", "y") >= _overlap(F.col("x.n"), F.col("y.n"), percent))
    left = scratch.write(left.select("a", "b"), "candidates")
    nodes = left.select(F.col("a").alias("id")).union(left.select("b")).distinct()
    nodes = scratch.write(sets.select("id", "th").join(nodes, "id", "left_semi").withColumnRenamed("th", "_th"), "nodes")
    scratch.release()
    texts = source.withColumn("th", F.xxhash64("text")).join(nodes, F.col("th") == F.col("_th")).select("id", "text")
    whole = scratch.write(_shingles(texts, shingle).dropDuplicates(["id"]), "whole-sets")
    scratch.release()
    both = F.size(F.array_intersect("set_a", "set_b"))
    one = lambda k: whole.select(F.col("id").alias(k), F.col("set").alias(f"set_{k}"))
    enough = 100 * both >= percent * (F.size("set_a") + F.size("set_b") - both)
    links = scratch.write(left.join(one("a"), "a").join(one("b"), "b").where(enough).select("a", "b"), "links")
    scratch.drop(left, nodes, whole)
    return links


def _mixed(posted: DataFrame, comp: DataFrame | None, turn: int, scratch: Scratch) -> DataFrame:
    """The rows of ``posted`` whose token has sets of several components, with comp (``id``
    where it has none yet), main and drawn: the token's largest component and one that a
    hash of its number and ``turn`` draws, each as (comp, id, n) of one of its sets."""
    if comp is None:
        owned = posted.withColumn("comp", F.col("id"))
    else:
        of = comp.select("node", "component")
        owned = posted.join(of, posted["id"] == of["node"], "left").withColumn("comp", F.coalesce("component", "id")).drop("node", "component")
        owned = scratch.write(owned, "owned")
    one = F.min(F.struct(F.xxhash64("id", F.lit(turn)).alias("h"), "id", "n"))
    parts = owned.groupBy("token", "comp").agg(F.count("*").alias("c"), one.alias("one"))
    parts = parts.select("token", "c", F.struct("comp", "one.id", "one.n").alias("part"))
    drawn = F.min_by("part", F.struct(F.xxhash64("part.comp", F.lit(turn)), "part.comp"))
    heads = parts.groupBy("token").agg(F.max_by("part", F.struct("c", "part.comp")).alias("main"), drawn.alias("drawn"), F.count("*").alias("parts"))
    heads = scratch.write(heads.where("parts > 1").select(F.col("token").alias("t"), "main", "drawn"), "heads")
    return owned.join(heads, owned["token"] == heads["t"]).drop("t")


def _labels(docs: DataFrame, shingle: int, percent: int, doc_id: str, text: str, scratch: Scratch, rounds: int) -> DataFrame:
    """doc_id, th, n, node (its set), component (a node): one row per input row."""
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    made = scratch.write(_sets(source, shingle, percent), "sets")
    all_sets = scratch.write(made.select("doc_id", "th", "n", "f1"), "rows")
    # a class is known by its fingerprint; one text stands for it
    classes = made.where("n > 0").groupBy("f1", "f2", "n").agg(F.min("th").alias("th"), F.count("*").alias("copies"))
    classes = scratch.write(classes, "classes")

    # which sets can have a partner: how many tokens of its prefix any other class has
    def hits_of_slices():
        for k in range(SLICES):
            tokens = made.select("f1", F.explode("prefix").alias("token")).where(_slice("token", k))
            shared = tokens.groupBy("token").agg(F.min("f1").alias("lo"), F.max("f1").alias("hi")).where("lo <> hi").select(F.col("token").alias("t"))
            shared = scratch.write(shared, "shared")
            scratch.release()
            yield tokens.join(shared, tokens["token"] == shared["t"], "left_semi").groupBy("f1").agg(F.count("*").alias("hits"))
            scratch.drop(shared)

    some_hits = scratch.write_slices(hits_of_slices(), "hits")
    # a prefix lengthened by m tokens shares 1 + m with a partner's of as many; a partner
    # may be smaller, down to the needed overlap, and its own prefix shorter
    first = _first(F.col("n"), percent)
    due = 1 + _first(_due(F.col("n"), percent), percent)
    hits = some_hits.groupBy("f1").agg(F.sum("hits").alias("hits"))
    able = classes.join(hits, "f1").where(F.col("hits") >= due * F.col("copies"))
    ids = scratch.write(able.select(F.col("f1").alias("id"), F.col("th").alias("_th")), "able")
    scratch.drop(classes, some_hits)
    of = [made.where(_slice("f1", k)).join(ids, (made["f1"] == ids["id"]) & (made["th"] == ids["_th"])) for k in range(SLICES)]
    of = [x.select("id", "th", "n", F.col("prefix").alias("pb"), "sketch", "over", "odd1", "odd2").dropDuplicates(["id"]) for x in of]
    sets = scratch.write_slices(of, "able-sets")
    scratch.drop(ids, made)

    # the other order: by frequency, within the long prefixes, of which a pair shares the
    # tokens that are due; what no other prefix has uses up the prefix in this order
    flat = sets.select("id", F.explode("pb").alias("token"))
    often = scratch.write(flat.groupBy("token").agg(F.count("*").alias("freq")).where("freq > 1").select(F.col("token").alias("t"), "freq"), "often")
    lists = flat.join(often, flat["token"] == often["t"]).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("freq", "token"))).alias("tokens"))  # of one set
    lists = sets.select("id", "n", F.size("pb").alias("size")).join(lists, "id").where(F.size("tokens") >= due)
    alone = F.col("size") - F.size("tokens")
    keep = F.greatest(F.lit(0), F.col("size") - due + 1 - alone).cast("int")
    ordered = lists.select("id", "n", "size", alone.alias("alone"), F.transform(F.slice("tokens", 1, keep), lambda x: x["token"]).alias("pa"))
    # a token carries the few before it: a pair is taken at its first common token
    before = F.slice("pa", F.greatest(F.lit(1), F.col("k") - RECALL + 1), F.least(F.col("k"), F.lit(RECALL)))
    posted = ordered.select("id", "n", "size", "alone", "pa", F.posexplode("pa").alias("k", "token"))
    posted = scratch.write(posted.select("id", "n", "size", "token", (F.col("alone") + F.col("k") + 1).alias("pos"), before.alias("before")), "posted")
    scratch.drop(often)

    # rounds of few pairs: each token's sets against one of its components, drawn anew each
    # time, and against its largest; both by one set
    near = comp = None
    for turn in range(rounds):
        mixed = scratch.write(_mixed(posted, comp, turn, scratch), "mixed")
        fits = lambda one: (100 * F.least("n", f"{one}.n") >= percent * F.greatest("n", f"{one}.n")) & (F.col("comp") != F.col(f"{one}.comp"))
        others = F.array(*(F.when(fits(one), F.col(f"{one}.id")) for one in ("drawn", "main")))
        stars = mixed.select("id", F.explode(F.array_compact(others)).alias("other")).select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"))
        found = _verify(stars.distinct(), sets, source, shingle, percent, scratch)
        near = found if near is None else near.union(found)
        comp = connected_components(near, scratch)
        scratch.drop(mixed)

    # the last round: pairs of different components; the largest of a token is not paired with itself
    mixed_rows = scratch.write(_mixed(posted, comp, rounds, scratch).withColumn("in_main", F.expr("comp = main.comp")).drop("main", "drawn"), "mixed")
    scratch.drop(posted)
    sketches = sets.select(F.col("id").alias("_id"), "sketch", "over", "odd1", "odd2")
    mixed = scratch.write(mixed_rows.join(sketches, mixed_rows["id"] == sketches["_id"]).drop("_id"), "sketched")
    scratch.drop(mixed_rows)
    x, y = mixed.where("not in_main").drop("in_main").alias("x"), mixed.alias("y")
    lo, hi = F.least("x.n", "y.n"), F.greatest("x.n", "y.n")
    # what the long prefixes can share, by the places of this token in the order
    can = F.least("x.pos", "y.pos") + F.least(F.col("x.size") - F.col("x.pos"), F.col("y.size") - F.col("y.pos"))
    candidates = (
        x.join(y, F.col("x.token") == F.col("y.token"))
        .where((F.col("x.comp") != F.col("y.comp")) & (F.col("y.in_main") | (F.col("x.id") < F.col("y.id"))))
        .where((100 * lo >= percent * hi) & (can >= 1 + _first(lo, percent)) & (_unlike("x", "y") <= lo + hi - 2 * _overlap(lo, hi, percent)))
        .where((F.size(F.array_intersect("x.before", "y.before")) == 0) & (_at_most("x", "y") >= _overlap(lo, hi, percent)))
        .select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()
    )
    more = _verify(candidates, sets, source, shingle, percent, scratch, sketched=False)
    scratch.drop(mixed)
    comp = connected_components(near.union(more), scratch)
    scratch.drop(sets)
    return all_sets.join(comp, all_sets["f1"] == comp["node"], "left").select(
        "doc_id", "th", "n", F.col("f1").alias("node"), F.coalesce("component", "f1").alias("component")
    )


def jaccard_components(
    docs: DataFrame, shingle: int = 3, percent: int = 90, doc_id: str = "doc_id", text: str = "text", scratch: Scratch | None = None, rounds: int = ROUNDS
) -> DataFrame:
    """doc_id, n_shingles, component_id, one row per input row.

    1. Every text becomes its set of hashed shingles; equal sets form a class.
    2. Under the hash order, a set that has a partner shares a known number of the tokens
       of its lengthened prefix with it.  Sets with too few tokens that any other class
       has in its own prefix have no partner and go.
    3. The lengthened prefixes left are ordered by frequency: whatever shares that number
       of tokens shares one of the first in this order.  Candidates share prefix tokens
       under both orders, at lengths and positions that allow the similarity.
    4. Candidates are verified on sets made from the texts again.  In the first ``rounds`` each
       token's sets meet one set drawn from them and one of its largest component; this
       joins groups of near copies without pairing them all.  Then the pairs that are
       still in different components, unless the counts of their tokens in the cells of a
       hash already bound the overlap below what is needed.

    Links found are exact; pairs that are left out are of one component already.  Null or
    empty text has no shingles and is alone.  Rows of one doc_id with different texts are
    separate documents.  Rows without doc_id link like others, but name no component: a
    component is null only if none of its rows has a doc_id.  Other columns are not read.
    """
    scratch = scratch or Scratch(docs.sparkSession, "jaccard")
    rows = scratch.write(_labels(docs, shingle, percent, doc_id, text, scratch, rounds), "labelled")
    least = scratch.write(rows.where("n > 0").groupBy("component").agg(F.min("doc_id").alias("least")).withColumnRenamed("component", "_c"), "least-ids")
    out = rows.join(least, F.when(F.col("n") > 0, F.col("component")) == F.col("_c"), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, shingle: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text", scratch: Scratch | None = None, rounds: int = LOOSE_ROUNDS) -> DataFrame:
    """The rows of ``docs`` with one row of each component: that of the smallest
    (doc_id, hash of the text), null ids last; of repeated rows one stays.

    Rows without words are alone and stay.  All columns are kept under their names.
    """
    scratch = scratch or Scratch(docs.sparkSession, "jaccard-one")
    rows = scratch.write(_labels(docs, shingle, percent, doc_id, text, scratch, rounds), "labelled")
    place = F.struct(F.col("doc_id").isNull(), "doc_id", "th")
    best = rows.where("n > 0").groupBy("component").agg(F.min(place).alias("best"))
    chosen = scratch.write(best.select(F.xxhash64("best.doc_id", "best.th").alias("row")), "chosen")
    row = F.xxhash64(F.col(doc_id).cast("long"), F.xxhash64(F.col(text)))
    held = docs.select(packed(docs).alias("held"), row.alias("row"), F.col(text).rlike(r"[^\x20\x09-\x0D]").alias("worded"))
    kept = held.where("worded").join(chosen, "row", "left_semi").groupBy("row").agg(F.first("held").alias("held"))
    return kept.select("held.*").unionByName(held.where("not coalesce(worded, false)").select("held.*"))
