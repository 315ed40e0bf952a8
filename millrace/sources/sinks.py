"""Exports: JSON, CSV with the union of all keys, tables, Markdown; upsert."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def map_columns(df: DataFrame, data: str) -> list[str]:
    """Sorted union of the keys of a map column: the header of an export."""
    return [r[0] for r in df.select(F.explode(F.map_keys(data)).alias("k")).distinct().orderBy("k").collect()]


def write_csv_union(df: DataFrame, data: str, path: str) -> list[str]:
    """A map column as CSV: the header is the sorted union of keys, absent cells are blank."""
    names = map_columns(df, data)
    df.select(*(F.coalesce(F.col(data)[n], F.lit("")).alias(n) for n in names)).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)
    return names


def upsert(existing: DataFrame, incoming: DataFrame, key: str, order: str, fields: list[str]) -> DataFrame:
    """Existing rows overlaid by incoming ones: (key, fields, action).

    The first incoming row of a key counts, rows without a key or any field are dropped,
    and equal rows are ``unchanged``.
    """
    some = F.coalesce(*(F.nullif(F.trim(F.col(f).cast("string")), F.lit("")) for f in fields)).isNotNull()
    first = incoming.where(F.col(key).isNotNull() & some).groupBy(F.col(key).alias("_k")).agg(F.min_by(F.struct(*fields), order).alias("_new"))
    old = existing.select(F.col(key).alias("_o"), F.struct(*fields).alias("_old"))
    both = old.join(first, F.col("_o") == F.col("_k"), "full")
    action = F.when(F.col("_o").isNull(), "insert").when(F.col("_k").isNull() | F.col("_old").eqNullSafe(F.col("_new")), "unchanged").otherwise("update")
    return both.select(F.coalesce("_o", "_k").alias(key), *(F.coalesce("_new", "_old")[f].alias(f) for f in fields), action.alias("action"))


def markdown_report(title: str, rows: DataFrame, limit: int = 1000) -> str:
    """A small report as a Markdown table; ``rows`` are a roll-up, at most ``limit``."""
    names = rows.columns
    lines = [f"# {title}", "", "| " + " | ".join(names) + " |", "|" + " --- |" * len(names)]
    cell = lambda v: str("" if v is None else v).replace("|", "\\|").replace("\n", " ")
    return "\n".join([*lines, *("| " + " | ".join(cell(v) for v in r) + " |" for r in rows.limit(limit).collect())]) + "\n"
