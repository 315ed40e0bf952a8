"""What leaves the store: pages of rows, fixed schemas, bundles, traces and histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ABSOLUTE = r"^https?://[^\s/]+"


def equal_filters(df: DataFrame, **wanted) -> DataFrame:
    """Rows equal to each value that is given; None filters nothing."""
    for name, value in wanted.items():
        if value is not None:
            df = df.where(F.col(name) == F.lit(value))
    return df


def page_with_total(df: DataFrame, order: list[Column], page: int, size: int) -> DataFrame:
    """One page of the rows, each with ``total``: all rows before paging.

    The total is a scalar subquery; the page is a top-k of page*size rows, so the table is
    never sorted whole.
    """
    total = df.agg(F.count("*")).scalar()
    return df.orderBy(*order).offset((page - 1) * size).limit(size).select("*", total.alias("total"))


def export_metadata(rows: DataFrame, key: str, most: int) -> DataFrame:
    """(key, total, returned, truncated) of an export that stops at ``most`` rows a key."""
    n = rows.groupBy(key).agg(F.count("*").alias("total"))
    return n.select(key, "total", F.least("total", F.lit(most)).cast("bigint").alias("returned"), (F.col("total") > most).alias("truncated"))


def fixed_schema(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Named text columns in order; what is missing is empty, as CSV has no null."""
    return rows.select(*(F.coalesce(c.cast("string"), F.lit("")).alias(n) for n, c in columns.items()))


def bundle(record: Column, tables: Column, evidence: Column) -> Column:
    """Record, tables and counts of evidence as one JSON text."""
    counts = F.struct(F.size(tables).alias("tables"), F.size(evidence).alias("evidence"))
    return F.to_json(F.struct(record.alias("record"), tables.alias("tables"), counts.alias("counts")))


def source_trace(method: Column, status: Column, fields: dict[str, Column], sources: dict[str, Column]) -> Column:
    """Provenance of a record: how it was got, and for each field that has a value its source."""
    found = F.filter(
        F.array(*(F.struct(F.lit(n).alias("field"), F.when(F.trim(v.cast("string")) != "", sources[n]).alias("source")) for n, v in fields.items())),
        lambda x: x["source"].isNotNull(),
    )
    return F.struct(F.struct(method.alias("method"), status.alias("status")).alias("acquisition"), F.map_from_entries(found).alias("field_discovery"))


def checked_url(c: Column) -> tuple[Column, Column]:
    """(URL, error) of an export row: it must be an absolute http address."""
    t = F.trim(c)
    fine = F.coalesce(t.rlike(ABSOLUTE), F.lit(False))
    return F.when(fine, t), F.when(~fine, F.when(F.coalesce(t, F.lit("")) == "", "missing url").otherwise("url is not absolute"))


def history(snapshots: DataFrame, records: DataFrame, key: str) -> DataFrame:
    """Snapshots with the count of their records and their latest record's time."""
    per = records.groupBy(key).agg(F.count("*").alias("records"), F.max("seen_at").alias("last_seen"))
    return snapshots.join(per, key, "left").withColumn("records", F.coalesce("records", F.lit(0).cast("bigint")))


def progress(results: DataFrame, run: str, order: list[str], verdict: str, kinds: list[str]) -> DataFrame:
    """Running counts of each verdict after every result of a run."""
    upto = Window.partitionBy(run).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return results.withColumns({"done": F.count("*").over(upto), **{k: F.count_if(F.col(verdict) == k).over(upto) for k in kinds}})


def newest(df: DataFrame, by: list[str], order: list[Column], keep: int) -> DataFrame:
    """The first ``keep`` rows of each key: what a bounded cache keeps."""
    return df.withColumn("_place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_place") <= keep).drop("_place")


def resolved(keys: DataFrame, stored: DataFrame, on: list[str], order: list[Column], defaults: dict[str, object]) -> DataFrame:
    """The latest stored row of each key, with defaults where there is none or a field is null."""
    latest = newest(stored, on, order, 1)
    joined = keys.join(latest.select(*on, *defaults), on, "left")
    return joined.select(*keys.columns, *(F.coalesce(F.col(c), F.lit(v)).alias(c) for c, v in defaults.items()))


def commit_source(provenance: Column, field: Column, source: Column, keep: bool = False) -> Column:
    """A provenance map with one field's source set; ``keep`` leaves an existing one."""
    had = F.element_at(provenance, field)
    new = F.map_from_arrays(F.array(field), F.array(F.coalesce(had, source) if keep else source))
    return F.map_concat(F.map_filter(provenance, lambda k, v: k != field), new)


def coverage(requested: Column, provenance: Column) -> Column:
    """Share of the requested fields that have a source; 1 where none is requested."""
    got = F.size(F.array_intersect(requested, F.map_keys(provenance)))
    return F.when(F.size(requested) > 0, got / F.size(requested)).otherwise(F.lit(1.0))


def repaired_fields(requested: Column, defaults: list[str]) -> Column:
    """Requested fields, then the surface's defaults that aren't among them."""
    return F.array_union(requested, F.array(*(F.lit(x) for x in defaults)))
