"""Scans, filters, joins and paging over runs, records, logs, users and monitors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ACTIVE = ("pending", "running", "paused")


def contains_text(c: Column, text: str) -> Column:
    """Case-insensitive containment; wildcards in ``text`` have no meaning."""
    return F.lower(c).contains(text.lower())


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def list_runs(runs: DataFrame, status: str | None = None, user_id: int | None = None, url_search: str | None = None) -> DataFrame:
    """Runs that match every filter given."""
    if status:
        runs = runs.where(F.col("status") == status)
    if user_id is not None:
        runs = runs.where(F.col("user_id") == user_id)
    if url_search:
        runs = runs.where(contains_text(F.col("url"), url_search))
    return runs


def active_runs(runs: DataFrame) -> DataFrame:
    """Active runs with their progress from the JSON summary, 0 if it has none."""
    progress = F.get_json_object("summary", "$.progress").try_cast("int")
    return runs.where(F.col("status").isin(*ACTIVE)).select("run_id", "status", F.coalesce(progress, F.lit(0)).alias("progress"))


def records_of_user(records: DataFrame, runs: DataFrame, user_id: int) -> DataFrame:
    """Records joined to the user's runs."""
    return records.join(runs.where(F.col("user_id") == user_id).select("run_id", "user_id"), "run_id")


def runs_with_logs(runs: DataFrame, logs: DataFrame, after_id: int) -> DataFrame:
    """Every run with its log rows past a cursor.  The cursor is part of the join, so runs
    without such rows stay."""
    return runs.join(logs, (runs["run_id"] == logs["log_run_id"]) & (logs["log_id"] > after_id), "left")


def commit_edits(edits: DataFrame, records: DataFrame) -> DataFrame:
    """Edited field values over the records they name."""
    return edits.join(records, "record_id").withColumn("changed", ~F.col("new_value").eqNullSafe(F.col("old_value")))


def backfill(rows: DataFrame, other: DataFrame, key: str, fallback: str, fields: list[str]) -> DataFrame:
    """Fills empty fields from rows of the same key, else of the same fallback key.

    One row of ``other`` counts for a key, the one with the smallest key of the other kind.
    """
    renamed = {f: f"_{f}" for f in fields}
    a = other.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_k")).agg(*(F.min_by(f, fallback).alias(f"_a_{f}") for f in fields))
    b = other.where(F.col(fallback).isNotNull()).groupBy(F.lower(F.col(fallback)).alias("_f")).agg(*(F.min_by(f, key).alias(f"_b_{f}") for f in fields))
    out = rows.join(a, F.col(key) == F.col("_k"), "left").join(b, F.lower(F.col(fallback)) == F.col("_f"), "left")
    fill = {f: F.coalesce(F.col(f), F.col(f"_a_{f}"), F.col(f"_b_{f}")) for f in renamed}
    return out.withColumns(fill).select(*rows.columns)


def new_keys(items: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Items whose key isn't there yet."""
    return items.join(existing.select(key).distinct(), key, "left_anti")


def due_monitors(monitors: DataFrame, now: Column) -> DataFrame:
    """Active monitors that are due, by priority, then the longest waiting, then id."""
    rank = F.when(F.col("priority") == "high", 0).when(F.col("priority") == "normal", 1).otherwise(2)
    due = monitors.where((F.col("status") == "active") & (F.col("next_run_at").isNull() | (F.col("next_run_at") <= now)))
    return due.withColumn("priority_rank", rank).orderBy("priority_rank", F.col("next_run_at").asc_nulls_last(), "monitor_id")
