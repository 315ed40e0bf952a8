"""Emptiness, identity and fingerprints of records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def present(c) -> Column:
    """Null when empty; "" and blank text are empty, 0 and false are not."""
    return F.when(F.trim(F.col(c) if isinstance(c, str) else c) != "", F.col(c) if isinstance(c, str) else c)


def first_present(*cols) -> Column:
    """The first value that isn't empty."""
    return F.coalesce(*(present(c) for c in cols))


def count_present(*cols) -> Column:
    return reduce(lambda a, b: a + b, (present(F.col(c).cast("string")).isNotNull().cast("int") for c in cols))


def drop_empty(m: Column) -> Column:
    """A map without empty values, private keys ("_...") or null."""
    return F.map_filter(m, lambda k, v: v.isNotNull() & (F.trim(v) != "") & ~k.startswith("_"))


def identity_key(url: Column) -> Column:
    """sha256 of the trimmed URL; null for an empty one."""
    return F.when(F.trim(url) != "", F.sha2(F.trim(url), 256))


def content_fingerprint(pairs: dict[str, Column], url: Column) -> Column:
    """sha256 of the canonical JSON of the identity fields that are present, else of the URL.

    Keys are sorted and values lowered with white space collapsed.
    """
    quote = lambda v: F.concat(F.lit('"'), F.replace(F.replace(v, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    value = lambda v: F.trim(F.regexp_replace(F.lower(v), r"\s+", " "))
    parts = [F.when(F.trim(pairs[k]) != "", F.concat(F.lit(f'"{k}":'), quote(value(pairs[k])))) for k in sorted(pairs)]
    body = F.concat_ws(",", *parts)
    return F.sha2(F.when(body != "", F.concat(F.lit("{"), body, F.lit("}"))).otherwise(F.trim(url)), 256)


def merge_max(a: Column, b: Column) -> Column:
    """Key-wise maximum of two maps of counts."""
    return F.map_zip_with(a, b, lambda k, x, y: F.greatest(F.coalesce(x, F.lit(0)), F.coalesce(y, F.lit(0))))


def positional_coalesce(current: Column, patch: Column) -> Column:
    """Arrays merged by position: the patch's value where it isn't empty."""
    return F.zip_with(current, patch, lambda x, y: F.coalesce(F.nullif(y, F.lit("")), x))
