"""Readers of URL lists, sitemaps and JSON bodies, all as DataFrame transformations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.text import field_key

HTTP = "^https?://"


def csv_urls(spark: SparkSession, path: str) -> DataFrame:
    """The first column of a CSV, trimmed, where it is a URL; a header is none."""
    rows = spark.read.option("header", False).schema("_c0 string").option("mode", "PERMISSIVE").csv(path)
    return rows.select(F.trim("_c0").alias("url")).where(F.col("url").rlike(HTTP))


def sitemap_links(bodies: DataFrame, key: str, xml: str, limit: int | None = None) -> DataFrame:
    """(key, ord, url, title) of the locations of sitemaps, the links of feeds and the addresses of Atom entries.

    Prefixes and CDATA are allowed, entities are decoded; of Atom links those to the feed itself, to
    editing and to enclosures are none.  Titles come from the slug.  URLs are distinct within a body, the
    first one stays; order is the body's.
    """
    inner, href = r"<(?:\w+:)?(?:loc|link)(?:\s[^>]*)?>\s*(?:<!\[CDATA\[)?\s*([^<\]]+?)\s*(?:\]\]>)?\s*</(?:\w+:)?(?:loc|link)>", r"""<(?:\w+:)?link\s(?:[^>]*\s)?href\s*=\s*["']([^"']+)["'][^>]*>"""
    whole = F.regexp_extract_all(F.col(xml), F.lit(f"({inner}|{href})"), F.lit(1))
    other = r"""\srel\s*=\s*["'](?:self|edit|enclosure|hub|search|stylesheet|icon)["']"""
    value = lambda m: F.coalesce(F.nullif(F.regexp_extract(m, href, 1), F.lit("")), F.regexp_extract(m, inner, 1))
    found = F.transform(F.filter(whole, lambda m: ~m.rlike(other)), lambda m: F.trim(value(m)))
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;|&#0*39;|&#x0*27;", "'"), ("&amp;|&#0*38;|&#x0*26;", "&")):
        found = _replaced(found, entity, sign)
    rows = bodies.select(key, F.posexplode(F.array_distinct(F.filter(found, lambda x: x.rlike(HTTP)))).alias("ord", "url"))
    slug = F.element_at(F.split(F.regexp_replace(F.regexp_replace("url", "[?#].*$", ""), "/+$", ""), "/"), -1)
    rows = rows.withColumn("title", F.initcap(F.trim(F.regexp_replace(F.regexp_replace(slug, r"\.[a-z]{2,5}$", ""), "[-_+]+", " "))))
    return rows.where(F.col("ord") < limit) if limit else rows


def _replaced(values: Column, pattern: str, by: str) -> Column:
    return F.transform(values, lambda x: F.regexp_replace(x, f"(?i){pattern}", by))


def json_records(bodies: DataFrame, key: str, body: str, path: str = "$") -> DataFrame:
    """(key, ord, record) of the array at a path of a JSON body; a lone object is one record.

    Bodies that are no JSON give nothing.
    """
    v = F.try_parse_json(body)
    at = bodies.select(key, F.try_variant_get(v, path, "variant").alias("v"))
    kind = F.schema_of_variant("v")
    array = at.where(kind.startswith("ARRAY")).select(key, F.posexplode(F.try_variant_get("v", "$", "array<variant>")).alias("ord", "r"))
    lone = at.where(kind.startswith("OBJECT")).select(key, F.lit(0).alias("ord"), F.col("v").alias("r"))
    return array.unionByName(lone).select(key, "ord", F.to_json("r").alias("record"))


def field_overlap(records: DataFrame, key: str, record: str, fields: list[str], absolute: int = 2, ratio: float = 0.25, sniff: int = 20) -> DataFrame:
    """Does a body's list look like records of a surface?  Counts those of the first
    ``sniff`` that hold one of the fields, themselves or one object further in; enough are
    max(absolute, ceil(n*ratio))."""
    entries = lambda c: F.from_json(c, "map<string,string>")
    inner = F.flatten(F.transform(F.map_values(entries(F.col(record))), lambda v: F.coalesce(F.json_object_keys(F.when(v.startswith("{"), v)), F.array().cast("array<string>"))))
    keys = F.concat(F.coalesce(F.json_object_keys(record), F.array().cast("array<string>")), F.coalesce(inner, F.array().cast("array<string>")))
    hit = F.arrays_overlap(F.transform(keys, field_key), F.array(*(F.lit(f) for f in fields)))
    g = records.where(F.col("ord") < sniff).groupBy(key).agg(F.count("*").alias("n"), F.count_if(hit).alias("hits"))
    return g.withColumn("matches", F.col("hits") >= F.greatest(F.lit(absolute), F.ceil(F.col("n") * ratio)))


def mapped_fields(bodies: DataFrame, body: str, spec: dict[str, list[str]]) -> DataFrame:
    """Columns from JSON paths: the first path of each that holds something."""
    value = lambda paths: F.coalesce(*(F.nullif(F.get_json_object(body, p), F.lit("")) for p in paths))
    return bodies.withColumns({name: value(paths) for name, paths in spec.items()})
