"""Snapshot comparison, page state, retention and failure runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def compare_value(field: str, c: Column) -> Column:
    """The form in which values are compared: empty is null, prices are their first
    number, text is lower case with single spaces."""
    text = F.trim(F.regexp_replace(F.lower(c), r"[ \t\n\r\f]+", " "))
    if "price" in field.lower():
        n = F.nullif(F.regexp_extract(c, r"([0-9]+(\.[0-9]+)?)", 1), F.lit(""))
        text = F.coalesce(n.try_cast("decimal(38,4)").cast("string"), n, text)
    return F.when(F.trim(c) != "", text)


def snapshot_diff(previous: DataFrame, current: DataFrame, key: str, fields: list[str], plain: tuple[str, ...] = ()) -> DataFrame:
    """(key, event_type, field_name, old_value, new_value): record_new, record_removed, and
    a field_changed for each tracked field whose compared form differs; values stay raw.

    Fields in ``plain`` are compared in lower case only, so empty text is a value.  Keys must be
    unique on each side (see ``best_per_key``); a row without one meets none and is both new and
    removed.  One shuffle of each side.
    """
    p = previous.select(F.col(key).alias("_pk"), *(F.col(f).alias(f"_p_{f}") for f in fields))
    c = current.select(F.col(key).alias("_ck"), *(F.col(f).alias(f"_c_{f}") for f in fields))
    both = p.join(c, F.col("_pk") == F.col("_ck"), "full")
    event = lambda kind, f, a, b: F.struct(F.lit(kind).alias("event_type"), F.lit(f).cast("string").alias("field_name"), a.cast("string").alias("old_value"), b.cast("string").alias("new_value"))
    none = F.lit(None)
    form = lambda f, c: F.lower(c) if f in plain else compare_value(f, c)
    met = F.col("_pk").isNotNull() & F.col("_ck").isNotNull()
    events = [F.when(F.col("_pk").isNull(), event("record_new", None, none, none)), F.when(F.col("_ck").isNull(), event("record_removed", None, none, none))]
    events += [F.when(met & ~form(f, F.col(f"_p_{f}")).eqNullSafe(form(f, F.col(f"_c_{f}"))), event("field_changed", f, F.col(f"_p_{f}"), F.col(f"_c_{f}"))) for f in fields]
    return both.select(F.coalesce("_pk", "_ck").alias(key), F.explode(F.array_compact(F.array(*events))).alias("e")).select(key, "e.*")


def page_states(visits: DataFrame, url: str, at: str, tie: str, digest: str) -> DataFrame:
    """Each visit with its predecessor: changed at the first visit, on an error (null
    digest) or when the digest differs; and how often it was unchanged in a row."""
    w = Window.partitionBy(url).orderBy(at, tie)
    before = F.lag(digest).over(w)
    first = F.row_number().over(w) == 1
    marked = visits.withColumn("changed", first | F.col(digest).isNull() | ~F.col(digest).eqNullSafe(before))
    marked = marked.withColumn("_g", F.sum(F.col("changed").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy(url, "_g").orderBy(at, tie)
    return marked.withColumn("unchanged_count", (F.row_number().over(run) - 1).cast("bigint")).drop("_g")


def retain(rows: DataFrame, owners: DataFrame, key: str, at: str, now: Column) -> DataFrame:
    """Rows inside their owner's retention, which is a day at least."""
    days = F.greatest(F.col("retention_days"), F.lit(1))
    kept = rows.join(owners.select(key, "retention_days"), key)
    return kept.where(F.col(at) >= now - F.make_interval(days=days)).drop("retention_days")


def change_alerts(events: DataFrame, owner: str) -> DataFrame:
    """One alert for each owner with changed fields."""
    return events.where("event_type = 'field_changed'").groupBy(owner).agg(F.count("*").alias("event_count"))


def failure_streaks(df: DataFrame, key: str, at: str, tie: str, failed: str, stale_at: int = 2) -> DataFrame:
    """Runs of consecutive failures (gaps and islands), stale from ``stale_at`` on."""
    w = Window.partitionBy(key).orderBy(at, tie)
    marked = df.withColumn("_g", F.sum((~F.col(failed)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = marked.where(F.col(failed)).groupBy(key, "_g").agg(F.count("*").alias("failures"), F.min(at).alias("since"))
    return runs.select(key, "since", "failures", (F.col("failures") >= stale_at).alias("stale"))


def blocked_hosts(df: DataFrame, host: str, at: str, ttl_seconds: int, threshold: int, now: Column) -> DataFrame:
    """Blocks of a host, counted anew after a pause of the TTL; a host is avoided while its
    last count is at the threshold and the TTL runs."""
    w = Window.partitionBy(host).orderBy(at)
    pause = F.unix_timestamp(at) - F.unix_timestamp(F.lag(at).over(w)) > ttl_seconds
    marked = df.withColumn("_g", F.sum(F.coalesce(pause, F.lit(True)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = marked.groupBy(host, "_g").agg(F.count("*").alias("blocks"), F.max(at).alias("last_block"))
    last = runs.groupBy(host).agg(F.max_by("blocks", "_g").alias("blocks"), F.max("last_block").alias("last_block"))
    age = F.unix_timestamp(now) - F.unix_timestamp("last_block")
    return last.withColumn("avoid", (F.col("blocks") >= threshold) & (age <= ttl_seconds))


def stale_runs(runs: DataFrame, now: Column, threshold_seconds: int) -> DataFrame:
    """Running runs without a sign of life for the threshold."""
    seen = F.coalesce("last_heartbeat_at", "updated_at", "created_at")
    return runs.where((F.col("status") == "running") & (F.unix_timestamp(now) - F.unix_timestamp(seen) >= threshold_seconds))
