"""Ranking, dedupe and merging of rival rows.

A plan has no row order: callers give the order columns, which must be total.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best_per_key(df: DataFrame, keys: list[str], order: list[Column], k: int = 1) -> DataFrame:
    """The first k rows of each key; Spark limits groups before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= k).drop("_rank")


def latest_per_key(df: DataFrame, keys: list[str], at: str, tie: str) -> DataFrame:
    """The latest row of each key, by (time, tie), without sorting the groups."""
    rest = [c for c in df.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.struct(at, tie)).alias("_r")
    return df.groupBy(*keys).agg(last).select(*keys, *(F.col(f"_r.{c}").alias(c) for c in rest))


def ordered_distinct(df: DataFrame, key: str, order: str) -> DataFrame:
    """Distinct keys at the first place they stand."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(order).alias(order))


def capped_candidates(df: DataFrame, group: str, cap_by: str, order: list[Column], per_cap: int, total: int) -> DataFrame:
    """At most ``per_cap`` of each (group, cap key), then the best ``total`` of the group."""
    return best_per_key(best_per_key(df, [group, cap_by], order, per_cap), [group], order, total)


def merge_rows(df: DataFrame, keys: list[str], fields: list[str], order: list[Column]) -> DataFrame:
    """One row a key: each field is the first value present, in the given order.

    Rows where any key is null are kept as they are.
    """
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    whole = df.where(" and ".join(f"{k} is not null" for k in keys))
    first = whole.withColumns({f: F.first(F.when(F.trim(F.col(f).cast("string")) != "", F.col(f)), ignorenulls=True).over(w) for f in fields})
    kept = first.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")
    return kept.unionByName(df.where(" or ".join(f"{k} is null" for k in keys)))


def best_set(df: DataFrame, page: str, name: str, order: str, score: list[Column]) -> DataFrame:
    """The candidate set of the highest lexicographic score; the earliest wins ties."""
    sets = df.groupBy(page, name).agg(F.min(order).alias("_ord"), F.struct(*score).alias("_score"))
    return sets.groupBy(page).agg(F.max_by(name, F.struct(F.col("_score"), -F.col("_ord"))).alias("best_set"), F.count("*").alias("sets"))


def field_winners(candidates: DataFrame, record: str, source_rank: dict[str, int]) -> DataFrame:
    """Long candidates (record, field, value, source, idx): the winner of each field, by the
    rank of its source, then arrival."""
    rank = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in source_rank.items() for x in kv)), F.col("source")), F.lit(len(source_rank)))
    full = candidates.where(F.trim("value") != "").withColumn("source_rank", rank)
    return full.groupBy(record, "field").agg(
        F.min_by(F.struct("value", "source"), F.struct("source_rank", "idx")).alias("w"), F.count_distinct("value").alias("rivals")
    ).select(record, "field", "w.value", "w.source", "rivals")
