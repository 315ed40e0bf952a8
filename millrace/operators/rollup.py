"""Roll-ups: verdicts, health, fill rates, integrity, coverage, scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GOOD = ("success", "partial")


def url_verdict(is_listing: Column, blocked: Column, records: Column) -> Column:
    """The verdict of one page."""
    return (
        F.when((records > 0) & blocked, "partial").when(records > 0, "success").when(blocked, "blocked")
        .when(is_listing, "listing_detection_failed").otherwise("empty")
    )


def run_verdict(df: DataFrame, run: str, verdict: str, order: str) -> DataFrame:
    """One verdict a run from those of its pages."""
    v = F.when(F.trim(verdict) != "", F.trim(verdict))
    seen = df.groupBy(run).agg(F.collect_set(v).alias("s"), F.max_by(v, F.when(v.isNotNull(), F.col(order))).alias("last"))
    has = lambda x: F.array_contains("s", x)
    return seen.select(
        run,
        F.when(F.size("s") == 0, "empty").when((has("success")) & (F.size("s") == 1), "success").when(has("success") | has("partial"), "partial")
        .when(has("error"), "error").when(has("blocked"), "blocked").when(has("listing_detection_failed"), "listing_detection_failed")
        .otherwise(F.col("last")).alias("verdict"),
    )


def run_health(df: DataFrame, run: str, verdict: str, degraded: float = 0.05, failed: float = 0.25) -> DataFrame:
    """Failure rate of a run's pages and its band."""
    v = F.col(verdict)
    out = df.where(F.trim(v) != "").groupBy(run).agg(F.count("*").alias("url_count"), F.count_if(~v.isin(*GOOD)).alias("failure_count"))
    rate = F.col("failure_count") / F.col("url_count")
    return out.withColumn("failure_rate", F.round(rate, 4)).withColumn("health", F.when(rate >= failed, "failed").when(rate >= degraded, "degraded").otherwise("healthy"))


def fill_rates(df: DataFrame, fields: list[str], least: float = 0.8) -> DataFrame:
    """(field, filled, total, fill_rate, passed) of each required field, in one pass."""
    ok = lambda f: F.count_if(F.trim(F.col(f).cast("string")) != "")
    once = df.agg(F.count("*").alias("total"), *(ok(f).alias(f"_{f}") for f in fields))
    rows = once.select("total", F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"_{f}").alias("filled")) for f in fields))).alias("x"))
    rate = F.when(F.col("total") > 0, F.col("filled") / F.col("total")).otherwise(0.0)
    return rows.select("x.field", "x.filled", "total").withColumn("fill_rate", F.round(rate, 4)).withColumn("passed", rate >= least)


def homogeneity(df: DataFrame, page: str, signature: str) -> DataFrame:
    """Share of the most frequent signature among a page's records."""
    return df.groupBy(page, signature).agg(F.count("*").alias("n")).groupBy(page).agg(
        F.sum("n").alias("record_count"), F.max("n").alias("dominant_count"), (F.max("n") / F.sum("n")).alias("ratio")
    )


def integrity(df: DataFrame, page: str, signature: str, sibling: str, marker: str, support: str, min_records: int = 3, min_ratio: float = 0.5) -> DataFrame:
    """Is a page's set of records a grid of items or a cluster of links?

    Rules in order: few records, all sibling categories without evidence; mixed
    signatures, unless half of five or more have support; all sibling categories; some
    sibling category and no evidence at all; else a grid.
    """
    part = df.groupBy(page, signature).agg(
        F.count("*").alias("n"), F.sum(F.col(sibling).cast("int")).alias("s"), F.sum(F.col(marker).cast("int")).alias("m"), F.sum(F.col(support).cast("int")).alias("u")
    )
    g = part.groupBy(page).agg(
        F.sum("n").alias("record_count"), (F.max("n") / F.sum("n")).alias("ratio"), F.sum("s").alias("sibling_count"),
        F.sum("m").alias("marker_count"), F.sum("u").alias("support_count"),
    )
    n, s, m, u = (F.col(c) for c in ("record_count", "sibling_count", "marker_count", "support_count"))
    override = (n >= 5) & (u >= F.greatest(F.lit(1), F.floor(n / 2)))
    reason = (
        F.when((n < min_records) & (s == n) & (m == 0) & (u == 0), "below_min_records")
        .when((F.col("ratio") < min_ratio) & ~override, "cohort_heterogeneous")
        .when(s == n, "all_sibling_category_urls").when((m == 0) & (u == 0) & (s > 0), "no_support_signals").otherwise("supported_set")
    )
    return g.withColumn("reason", reason).withColumn("outcome", F.when(F.col("reason") == "supported_set", "product_grid").otherwise("promo_only_cluster"))


def compliance(df: DataFrame, subject: str, dimension: str, score: str, weight: str, gate: str, gate_max: int = 30) -> DataFrame:
    """Weighted score, cut to an integer; capped where the gate dimension is 0."""
    g = df.groupBy(subject).agg(
        F.floor(F.sum(F.col(score) * F.col(weight)) + 1e-9).cast("bigint").alias("raw"), F.max(F.when((F.col(dimension) == gate) & (F.col(score) == 0), 1).otherwise(0)).alias("g")
    )
    return g.select(subject, F.when(F.col("g") == 1, F.least("raw", F.lit(gate_max).cast("bigint"))).otherwise(F.col("raw")).alias("overall_score"), (F.col("g") == 1).alias("gate_applied"))


def coverage(df: DataFrame, item: str, attribute: str, wanted: list[str], total: int | Column, least: float = 0.7) -> DataFrame:
    """Share of items that have each wanted attribute, and whether that is a gap."""
    spark = df.sparkSession
    seen = df.where(F.col(attribute).isin(*wanted)).groupBy(F.col(attribute).alias("attribute")).agg(F.count_distinct(item).alias("items"))
    every = spark.createDataFrame([(w,) for w in wanted], "attribute string")
    rate = F.coalesce("items", F.lit(0)) / (total if isinstance(total, Column) else F.lit(total))
    return every.join(seen, "attribute", "left").select("attribute", F.coalesce("items", F.lit(0)).alias("items"), F.round(rate, 4).alias("coverage"), (F.round(rate, 4) < least).alias("gap"))


def case_clusters(df: DataFrame, value: str) -> DataFrame:
    """Values that differ only in case or outer space."""
    return df.where(F.trim(value) != "").groupBy(F.lower(F.trim(value)).alias("key")).agg(F.count_distinct(value).alias("spellings"), F.count("*").alias("n")).where("spellings > 1")


def histogram(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value) -> count: histograms as rows, which stay distributed."""
    return df.groupBy(*keys, value).agg(F.count("*").alias("n"))


def confidence(record_fields: DataFrame, record: str, weight: str, quality: str, penalty: str) -> DataFrame:
    """Weighted mean of field quality less penalty, with its band."""
    from millrace.functions.price import confidence_level

    q = F.sum(F.col(weight) * F.col(quality) * (1 - F.col(penalty))) / F.sum(weight)
    return record_fields.groupBy(record).agg(F.round(q + 1e-9, 4).alias("score")).withColumn("level", confidence_level(F.col("score")))


def source_shares(df: DataFrame, record: str, tier: str, weight: str) -> DataFrame:
    """Share of each source tier in a record's weight."""
    per = df.groupBy(record, tier).agg(F.sum(weight).alias("w"))
    total = df.groupBy(record).agg(F.sum(weight).alias("t"))
    return per.join(total, record).select(record, tier, F.round(F.col("w") / F.col("t") + 1e-9, 4).alias("share"))
