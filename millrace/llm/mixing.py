"""Mixing sources to target weights along a time-varying curriculum."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_TOKEN, Scratch, packed, running_sums


def source_targets(sizes: DataFrame, weights: tuple = (5, 2, 1), cap: float = 3.0, ramps: tuple = (-0.5, 0.0, 0.5)) -> DataFrame:
    """Target words of each source: ``sizes`` has one row (source, source_size) per source.

    Sources by code point, null last, get the weights in turn and share the words of all.
    A target stops at ``cap`` times its source; what it leaves is reshared by weight.
    Let g(x) = sum of least(cap*size, x*weight): the level x with g(x) = total is found
    by one pass in the order in which sources reach their cap.
    """
    everything = Window.partitionBy()  # one row a source
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    k = F.row_number().over(order) - 1
    pick = lambda xs: F.element_at(F.array(*(F.lit(float(x)) for x in xs)), (k % len(xs) + 1).cast("int"))
    w = sizes.select("source", "source_size", pick(weights).alias("weight"), pick(ramps).alias("ramp"))
    w = w.withColumn("full", F.col("source_size") * F.lit(cap)).withColumn("at", F.col("full") / F.col("weight"))
    by_level = Window.orderBy("at", F.col("source").isNull(), "source")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    after = by_level.rowsBetween(0, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("full").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    w = w.withColumn("level", level).withColumn("open", F.col("level") <= F.col("at"))
    x = F.min_by(F.when(F.col("open"), F.col("level")), F.when(F.col("open"), F.col("at"))).over(everything)
    w = w.withColumn("x", x)
    # sums of doubles may miss the cap by a rounding error: the cap itself is compared
    return w.select(
        "source", "source_size", "ramp",
        F.coalesce(F.least("full", F.col("x") * F.col("weight")), F.col("full")).alias("target"),
        F.coalesce(F.col("x") * F.col("weight") >= F.col("full"), F.lit(True)).alias("capped"),
    )


def mix(
    docs: DataFrame, weights: tuple = (5, 2, 1), cap: float = 3.0, ramps: tuple = (-0.5, 0.0, 0.5),
    doc_id: str = "doc_id", text: str = "text", source: str = "source", scratch: Scratch | None = None,
) -> DataFrame:
    """doc_id, th, size, source_size, target, taken, source, passes, positions (of each pass).

    Source i asks for tokens at the rate f_i(t) = 1 + ramp_i*(2t - 1) over training time t
    in 0..1, scaled to its target; its demand up to t is target*(t + ramp*(t*t - t)).
    Its documents stand in a hashed order; the words before a document, divided by the
    target, are put through the inverse of that integral to give its position.  Every
    document is taken floor(target/size of source) times; the words still asked for come
    from the first documents, the last of which is cut where the demand ends.

    Null text has no words and is never taken.  Rows of one doc_id are separate documents.
    Other columns are not read.
    """
    scratch = scratch or Scratch(docs.sparkSession, "mix")
    rows = scratch.write(
        docs.select(
            F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.xxhash64(F.col(text)).alias("th"),
            F.coalesce(F.regexp_count(F.col(text), F.lit(SPACE_TOKEN)), F.lit(0)).cast("long").alias("size"),
        ),
        "sizes",
    )
    sizes = scratch.write(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), "sources")
    most = sizes.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    targets = scratch.write(source_targets(sizes.drop("n"), weights, cap, ramps).withColumnRenamed("source", "_source"), "targets")
    placed = running_sums(rows, scratch, "source", ["doc_id", "th"], "size", buckets=max(512, most // 50_000))
    placed = placed.join(targets, placed["source"].eqNullSafe(targets["_source"])).drop("_source")
    full = F.when(F.col("capped"), F.lit(float(cap)).cast("long")).otherwise(F.floor(F.col("target") / F.greatest("source_size", F.lit(1))))
    left = F.round("target").cast("long") - F.col("full") * F.col("source_size")
    ramp = F.col("ramp")

    def position(words):
        """Inverts the demand."""
        u = F.least(F.lit(1.0), words / F.col("target"))
        root = F.sqrt((1 - ramp) * (1 - ramp) + 4 * ramp * u)
        return F.when(ramp == 0, u).otherwise((root - (1 - ramp)) / (2 * ramp))

    placed = (
        placed.withColumn("full", full)
        .withColumn("taken", F.col("full") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), left - F.col("_before"))))
        .withColumn("passes", F.when(F.col("size") > 0, F.ceil(F.col("taken") / F.col("size"))).otherwise(F.lit(0)))
    )
    mid = F.col("_before") + F.col("size") / 2.0
    each = F.transform(F.sequence(F.lit(0), F.greatest(F.col("passes").cast("int"), F.lit(1)) - 1), lambda e: position(mid + e * F.col("source_size")))
    return placed.select(
        "doc_id", "th", "size", "source_size", "target", F.col("taken").cast("long").alias("taken"), "source",
        F.col("passes").cast("int").alias("passes"), F.when(F.col("taken") > 0, each).alias("positions"),
    )


def training_order(mixed: DataFrame) -> DataFrame:
    """Range-sorts by position; what isn't taken comes last."""
    first = F.get("positions", F.lit(0))
    keys = [first.asc_nulls_last(), F.col("doc_id").asc_nulls_last()]
    return mixed.repartitionByRange(*keys).sortWithinPartitions(*keys)


def mix_stage(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, each as often as the mix passes over it, in training order.

    A document that is cut where its source's demand ends stays whole here.  All columns
    keep their names and values; texts without words are never taken.
    """
    mixed = mix(docs, **options).where("passes > 0")
    order = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.lit(0)))
    # rows that repeat id and text are interchangeable: they are numbered on both sides
    right = mixed.select(F.col("doc_id").alias("id"), "th", "positions").withColumn("k", order("id", "th"))
    left = docs.select(packed(docs).alias("held"), F.col("doc_id").alias("l_id"), F.xxhash64("text").alias("l_th")).withColumn("l_k", order("l_id", "l_th"))
    both = left.join(right, F.col("l_id").eqNullSafe(F.col("id")) & (F.col("l_th") == F.col("th")) & (F.col("l_k") == F.col("k")))
    keys = [F.col("at"), F.col("id").asc_nulls_last()]
    placed = both.select("held", "id", F.explode("positions").alias("at")).repartitionByRange(*keys).sortWithinPartitions(*keys)
    return placed.select("held.*")
