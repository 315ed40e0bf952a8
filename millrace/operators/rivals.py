"""Rival record sets of a page: scored as sets, united by URL, gaps filled in order of score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _filled(data: Column) -> Column:
    return F.map_filter(data, lambda k, v: v.isNotNull() & (F.trim(v) != ""))


def set_scores(rows: DataFrame, page: str, source: str = "source", data: str = "data", place: str = "place") -> DataFrame:
    """(page, source, size, populated, standing): sets by number of rows, then of filled columns
    (those that begin with _ don't count), then by place; the best stands first."""
    shown = F.size(F.map_filter(_filled(F.col(data)), lambda k, v: ~k.startswith("_")))
    sets = rows.groupBy(page, source).agg(F.count("*").alias("size"), F.sum(F.coalesce(shown, F.lit(0))).alias("populated"), F.min(place).alias(place))
    order = Window.partitionBy(page).orderBy(F.desc("size"), F.desc("populated"), place, source)  # the few sources of a page
    return sets.select(page, source, "size", "populated", F.row_number().over(order).alias("standing"))


def united(rows: DataFrame, page: str, source: str = "source", data: str = "data", place: str = "place", url: str = "url") -> DataFrame:
    """(page, url, data, best_source): the rows of all sets, one a URL.

    Rows of one URL are one: each column comes from the best set that fills it, the earlier
    row of equals.  Rows without a URL stay apart, equal ones once.  Columns are merged by
    key, so a page's rows are never gathered; a null map has no columns.  Rows are shuffled once, by page, where
    the standings of its sets lie beside them; all else is grouped in place.
    """
    sets = set_scores(rows, page, source, data, place).where(F.col(source).isNotNull())
    scores = sets.groupBy(page).agg(F.map_from_entries(F.collect_list(F.struct(source, "standing"))).alias("of"), F.min_by(source, F.when(F.col("standing") == 1, 1)).alias("best_source"))  # the few sources of a page
    kept = rows.select(page, source, F.col("ord"), _filled(F.coalesce(data, F.create_map().cast("map<string,string>"))).alias("d")).where(F.col(source).isNotNull())
    kept = kept.join(scores.hint("merge"), page).select(page, "best_source", F.element_at("of", F.col(source)).alias("standing"), "ord", "d")
    entries = F.array_sort(F.map_entries("d"))
    link = F.nullif(F.trim(F.col("d")[url]), F.lit(""))
    keyed = kept.withColumn("same", F.coalesce(F.concat(F.lit("u:"), link), F.concat(F.lit("r:"), F.sha2(F.to_json(entries), 256))))
    each = keyed.select(page, "same", "best_source", F.struct("standing", "ord").alias("at"), F.explode_outer("d").alias("k", "v"))
    first = each.groupBy(page, "same", "k").agg(F.min_by("v", "at").alias("v"), F.first("best_source").alias("best_source"), F.min("at").alias("at"))
    whole = first.groupBy(page, "same").agg(F.first("best_source").alias("best_source"), F.min("at").alias("at"), F.map_from_entries(F.collect_list(F.when(F.col("k").isNotNull(), F.struct("k", "v")))).alias("data"))
    return whole.where("best_source is not null").select(page, F.when(F.startswith("same", F.lit("u:")), F.substring("same", F.lit(3), F.length("same"))).alias("url"), "data", "at", "best_source")
