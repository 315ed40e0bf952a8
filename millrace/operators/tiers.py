"""Second tiers: pages whose records lack fields are walked again, and only those fields are filled."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _empty(c: str) -> Column:
    return F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")


def incomplete(records: DataFrame, key: str, required: tuple[str, ...]) -> DataFrame:
    """(key, missing): the records that lack required fields, and which.  A null key is no page."""
    missing = F.array_compact(F.array(*(F.when(_empty(c), F.lit(c)) for c in required)))
    return records.select(key, missing.alias("missing")).where((F.size("missing") > 0) & F.col(key).isNotNull())


def completed(records: DataFrame, pages: DataFrame, key: str, required: tuple[str, ...], walk: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The records with their empty required fields filled from ``walk``, and ``filled``, the names of these.

    ``walk`` turns pages into (key, field, value); it is given only the pages whose record is
    incomplete, by a semi-join, so complete pages are not parsed again.  Of several values of a
    field the first by value counts; what a record has stays; a record without a page stays as it is.
    """
    short = incomplete(records, key, required)
    found = walk(pages.join(short.select(key).distinct(), key, "left_semi"))
    found = found.where(F.col("field").isin(*required) & (F.trim("value") != ""))
    one = found.groupBy(key).agg(*(F.min(F.when(F.col("field") == c, F.col("value"))).alias(f"_new_{c}") for c in required))
    joined = records.join(one, key, "left")
    kinds = dict(records.dtypes)
    value = lambda c: F.when(_empty(c), F.coalesce(F.col(f"_new_{c}").try_cast(kinds[c]), F.col(c))).otherwise(F.col(c))
    filled = F.array_compact(F.array(*(F.when(_empty(c) & F.col(f"_new_{c}").try_cast(kinds[c]).isNotNull(), F.lit(c)) for c in required)))
    return joined.select(*(value(c).alias(c) if c in required else F.col(c) for c in records.columns), filled.alias("filled"))
