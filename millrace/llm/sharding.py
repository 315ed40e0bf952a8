"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE_TOKEN, Scratch, packed, running_sums, set_aside

DIMS = ("size", "tokens", "rows")


def pack(items: np.ndarray, shards: int) -> np.ndarray:
    """Greedy vector bin packing, largest item first.

    ``items`` is (n, d) in units of one shard's fair share.  Each goes to the shard whose
    residual capacity has the highest dot product with it, among those it fits in if any.
    """
    residual = np.ones((shards, items.shape[1]))
    placed = np.zeros(len(items), np.int32)
    for i in np.argsort(-items.max(axis=1), kind="stable"):
        v = items[i]
        score = residual @ v
        fits = (residual >= v - 1e-12).all(axis=1)
        if fits.any():
            score = np.where(fits, score, -np.inf)
        k = int(score.argmax())
        placed[i] = k
        residual[k] -= v
    return placed


def _assignment(rows: DataFrame, shards: int, lots_per_shard: int) -> tuple[DataFrame, DataFrame, int]:
    """(hot groups with their number of pieces, unit -> shard, number of rows).

    Groups above 1/(shards*lots_per_shard) of any total are packed by themselves: there are
    at most 3*shards*lots_per_shard of them, whatever the input.  The others are hashed
    into shards*lots_per_shard lots.  So the driver packs a bounded number of units.
    """
    spark = rows.sparkSession
    lots = shards * lots_per_shard
    tot = rows.agg(*(F.coalesce(F.sum(d), F.lit(0)).alias(d) for d in DIMS)).first()
    total = np.array([max(1, tot[d]) for d in DIMS], float)
    groups = rows.groupBy("grp").agg(*(F.sum(d).alias(d) for d in DIMS))
    heavy = F.greatest(*(F.col(d) / F.lit(float(t)) for d, t in zip(DIMS, total, strict=True))) > F.lit(1 / lots)
    units = (
        groups.withColumn("heavy", heavy)
        .withColumn("a", F.when(F.col("heavy"), F.col("grp")).otherwise(F.pmod("grp", F.lit(lots))))
        .groupBy("heavy", "a").agg(*(F.sum(d).alias(d) for d in DIMS))
        .collect()
    )  # at most 4 * lots rows
    hot = {}
    for u in units:
        share = max(u[d] / t for d, t in zip(DIMS, total, strict=True)) * shards
        if u["heavy"] and share > 0.5 and u["rows"] > 1:
            hot[u["a"]] = int(np.ceil(share / 0.125))
    hot_df = spark.createDataFrame([(k, p) for k, p in hot.items()], "hot_grp long, pieces int")
    keys = [(u["a"], -1 if u["heavy"] else -2, [u[d] for d in DIMS]) for u in units if not (u["heavy"] and u["a"] in hot)]
    if hot:
        pieces = (
            rows.join(F.broadcast(hot_df), rows["grp"] == hot_df["hot_grp"])
            .groupBy("grp", F.pmod("dh", "pieces").cast("int").alias("piece"))
            .agg(*(F.sum(d).alias(d) for d in DIMS)).collect()
        )  # a hot group takes half a shard at least, so there are few
        keys += [(u["grp"], u["piece"], [u[d] for d in DIMS]) for u in pieces]
    keys.sort(key=lambda k: k[:2])
    placed = pack(np.array([k[2] for k in keys], float).reshape(-1, len(DIMS)) / total * shards, shards)
    units_df = spark.createDataFrame(
        [(k[0], k[1], int(s)) for k, s in zip(keys, placed, strict=True)], "unit_a long, unit_b int, shard int"
    )
    return hot_df, units_df, int(tot["rows"])


def assign_shards(
    docs: DataFrame, shards: int = 40, lots_per_shard: int = 256, doc_id: str = "doc_id", text: str = "text",
    scratch: Scratch | None = None, slots: bool = True,
) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, one row per input row.

    Documents of equal text form a group and go to one shard, but a group that would fill
    more than half a shard is split by a hash of doc_id.  Null text has no bytes, the crc of
    no bytes (0) and one group of its own; an empty table gives an empty result.  Repeated
    rows are kept and get slots of their own.  Other columns are not read.
    """
    scratch = scratch or Scratch(docs.sparkSession, "shards")
    t = F.col(text)
    rows = scratch.write(
        docs.select(
            F.col(doc_id).alias("doc_id"),
            (F.coalesce(F.octet_length(t), F.lit(0)) + 16).cast("long").alias("size"),
            F.coalesce(F.regexp_count(t, F.lit(SPACE_TOKEN)), F.lit(0)).cast("long").alias("tokens"),
            F.coalesce(F.crc32(t.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
            F.xxhash64(t).alias("grp"),
            F.xxhash64(F.col(doc_id), F.lit(5)).alias("dh"),
            F.lit(1).cast("long").alias("rows"),
        ),
        "rows",
    )
    hot, units, n = _assignment(rows, shards, lots_per_shard)
    placed = place(rows, hot, units, shards * lots_per_shard)
    if slots:
        placed = scratch.write(placed.select("doc_id", "size", "text_crc32", "shard"), "placed")
        placed = running_sums(
            placed.withColumn("_one", F.lit(1).cast("long")), scratch, "shard", ["doc_id", "text_crc32"], "_one",
            buckets=max(256, n // shards // 50_000),
        ).withColumnRenamed("_before", "slot")
    else:
        placed = placed.withColumn("slot", F.lit(None).cast("long"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def place(rows: DataFrame, hot: DataFrame, units: DataFrame, lots: int) -> DataFrame:
    """Adds ``shard`` to rows with ``grp`` and ``dh``.

    Both lookups are of bounded size (see ``_assignment``), so both are broadcast.
    """
    heavy = F.broadcast(units.where("unit_b >= -1").select(F.col("unit_a").alias("heavy_grp")).distinct())
    out = rows.join(F.broadcast(hot), rows["grp"] == hot["hot_grp"], "left")
    out = out.join(heavy, out["grp"] == F.col("heavy_grp"), "left")
    a = F.when(F.col("heavy_grp").isNull(), F.pmod("grp", F.lit(lots))).otherwise(F.col("grp"))
    b = F.when(F.col("heavy_grp").isNull(), F.lit(-2)).otherwise(
        F.when(F.col("pieces").isNull(), F.lit(-1)).otherwise(F.pmod("dh", "pieces").cast("int"))
    )
    out = out.withColumn("_a", a).withColumn("_b", b)
    return out.join(
        F.broadcast(units), (out["_a"] == units["unit_a"]) & (out["_b"] == units["unit_b"])
    ).drop("_a", "_b", "unit_a", "unit_b", "hot_grp", "pieces", "heavy_grp")


def shard_stage(docs: DataFrame, shards: int = 40, lots_per_shard: int = 256) -> DataFrame:
    """The input rows, with ``shard``: texts are not shuffled.

    A column of that name in the input is kept under the name of ``set_aside``; all others
    keep their names and values.
    """
    scratch = Scratch(docs.sparkSession, "shard-stage")
    named = docs.withColumnsRenamed(set_aside(docs, ["shard"]))
    t = F.col("text")
    keyed = named.select(packed(named).alias("held"), t.alias("text"), F.xxhash64(t).alias("grp"), F.xxhash64("doc_id", F.lit(5)).alias("dh"))
    rows = scratch.write(
        keyed.select(
            (F.coalesce(F.octet_length(t), F.lit(0)) + 16).cast("long").alias("size"),
            F.coalesce(F.regexp_count(t, F.lit(SPACE_TOKEN)), F.lit(0)).cast("long").alias("tokens"), "grp", "dh", F.lit(1).cast("long").alias("rows"),
        ),
        "rows",
    )
    hot, units, _ = _assignment(rows, shards, lots_per_shard)
    return place(keyed.select("held", "grp", "dh"), hot, units, shards * lots_per_shard).select("held.*", "shard")
