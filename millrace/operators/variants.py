"""Product variants as rows: (product, variant_id, sku, options map, price, available, url).

A product's variants are a bounded list, so expressions over its array are used where rows
must be compared; everything else groups by (product, identity).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import coerce, values
from millrace.functions.bind import once

#: Spellings of axes, and what sizes may end in: short lists of our own.
AXES = {"colour": "color", "colours": "color", "colors": "color", "sizes": "size", "shoe_size": "size"}
SIZE_SUFFIX = r"(?i)\s+(size|regular|standard)$"


def axis_key(c: Column) -> Column:
    k = F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]+", "_")
    names = F.create_map(*(F.lit(x) for kv in AXES.items() for x in kv))
    return once(k, lambda k: F.coalesce(F.element_at(names, k), k))


def axis_value(key: Column, c: Column) -> Column:
    """Cleaned; a size without what sizes end in."""
    cut = lambda t: F.when(key == "size", F.nullif(F.regexp_replace(t, SIZE_SUFFIX, ""), F.lit("")))
    return once(F.coalesce(coerce.text_or_none(c), F.lit("")), lambda t: F.coalesce(cut(t), t))


def _pairs(options: Column, clean: bool) -> Column:
    """Sorted "axis=value" texts of the options that have a value."""
    def pair(e):
        value = lambda k: axis_value(k, e["value"]) if clean else F.coalesce(coerce.text_or_none(e["value"]), F.lit(""))
        return once(axis_key(e["key"]) if clean else F.trim(e["key"]), lambda k: F.struct(k.alias("k"), value(k).alias("v")))

    kept = F.filter(F.transform(F.map_entries(options), pair), lambda p: (p["k"] != "") & (p["v"] != ""))
    return F.transform(F.array_sort(kept), lambda p: F.concat_ws("=", p["k"], p["v"]))


def identity(variant_id: Column, sku: Column, options: Column) -> Column:
    """id, else sku, else the options as they are; null where there is none of them."""
    named = lambda tag, c: F.concat(F.lit(tag), coerce.text_or_none(c))
    joined = once(_pairs(options, False), lambda pairs: F.when(F.size(pairs) > 0, F.concat(F.lit("options:"), F.array_join(pairs, "|"))))
    return F.coalesce(named("id:", variant_id), named("sku:", sku), joined)


def semantic_identity(options: Column) -> Column:
    """The options under their canonical names and values."""
    return once(_pairs(options, True), lambda pairs: F.when(F.size(pairs) > 0, F.concat(F.lit("semantic:"), F.array_join(pairs, "|"))))


def richness(*cols: str) -> Column:
    return values.count_present(*cols)


def sanitize(rows: DataFrame) -> DataFrame:
    """Options cleaned of selects, stock and prices; rows left without any identity go."""
    clean = F.map_filter(F.transform_values("options", lambda k, v: coerce.option_scalar(v)), lambda k, v: v.isNotNull())
    return rows.withColumn("options", clean).where(identity(F.col("variant_id"), F.col("sku"), F.col("options")).isNotNull())


def merged(rows: DataFrame, product: str, by: Column, fields: list[str]) -> DataFrame:
    """One row a product and identity: each field from the richest row that has it, ties by order.

    Rows without an identity stay apart.  Fields are texts.
    """
    keyed = rows.withColumn("identity", F.coalesce(by, F.concat(F.lit("row:"), F.col("ord").cast("string"))))
    rank = lambda f: F.struct(-richness(*fields), F.col("ord"))
    return keyed.groupBy(product, "identity").agg(*(F.min_by(F.col(f), F.when(F.trim(F.col(f)) != "", rank(f))).alias(f) for f in fields))


def without_subsets(rows: DataFrame, product: str) -> DataFrame:
    """Rows whose options aren't a proper part of another row's of the product."""
    pairs = F.transform("rows", lambda r: _pairs(r["options"], True))
    sets = rows.groupBy(product).agg(F.collect_list(F.struct(*(c for c in rows.columns if c != product))).alias("rows"))  # of one product
    sets = sets.withColumn("all", pairs)

    def kept(r: Column, i: Column) -> Column:
        own = F.get("all", i)
        return ~F.exists("all", lambda o: (F.size(own) > 0) & (F.size(o) > F.size(own)) & (F.size(F.array_except(own, o)) == 0))

    return sets.select(product, F.inline(F.filter("rows", kept))).select(*rows.columns)


def axes(rows: DataFrame, product: str) -> DataFrame:
    """(product, axis, values): the distinct canonical values of each axis, whatever their case, in order."""
    each = rows.select(product, "ord", F.explode("options").alias("k", "v")).select(product, "ord", axis_key(F.col("k")).alias("axis"), "v")
    each = each.withColumn("v", axis_value(F.col("axis"), F.col("v"))).where("v <> ''")
    first = each.groupBy(product, "axis", F.lower("v").alias("low")).agg(F.min(F.struct("ord", "v")).alias("f"))
    return first.groupBy(product, "axis").agg(F.transform(F.array_sort(F.collect_list("f")), lambda f: f["v"]).alias("values"))


def split_axes(found: DataFrame, product: str, always: tuple[str, ...] = ()) -> DataFrame:
    """(product, selectable, single): axes with a choice, and the one value of the others."""
    choice = (F.size("values") > 1) | F.col("axis").isin(*always)
    entry = lambda v: F.struct(F.col("axis").alias("key"), v.alias("value"))
    return found.groupBy(product).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.when(choice, entry(F.array_join("values", "|")))))).alias("selectable"),
        F.map_from_entries(F.array_sort(F.collect_list(F.when(~choice, entry(F.get("values", F.lit(0))))))).alias("single"),
    )


def real_value(v: Column) -> Column:
    """A value that a choice can have: no prompt, no long text, no page."""
    return coerce.option_scalar(v).isNotNull() & (F.length(v) <= 40) & ~v.rlike("^https?:")


def valid_groups(found: DataFrame) -> DataFrame:
    """Groups of choices that vary a product: two real values or more."""
    real = F.filter("values", real_value)
    return found.withColumn("values", real).where(F.size("values") >= 2)


def flat(rows: DataFrame, names: list[str]) -> DataFrame:
    """Options as columns; other columns stay."""
    keys = F.transform_keys("options", lambda k, v: axis_key(k))
    return rows.withColumn("options", keys).select(*(c for c in rows.columns if c != "options"), *(F.col("options")[n].alias(n) for n in names))


def selected(rows: DataFrame, product: str, page: Column) -> DataFrame:
    """The variant that the page's URL asks for, else the first available, else the first."""
    asked = F.regexp_extract(page, r"[?&]variant=([^&#]+)", 1)
    rank = F.struct((F.col("variant_id") != asked) | (asked == ""), ~F.col("available"), F.col("ord"))
    return rows.withColumn("rank", rank).groupBy(product).agg(F.min_by("variant_id", "rank").alias("variant_id"))


def from_products(payloads: DataFrame, product: str, payload: str) -> DataFrame:
    """Variant rows of structured products: hasVariant, else variants, else the offers.

    Names that differ between sites become one: id, sku, price, availability, URL.
    """
    get = lambda c, *paths: F.coalesce(*(coerce.text_or_none(F.get_json_object(c, f"$.{p}")) for p in paths))
    lists = [F.from_json(F.get_json_object(payload, f"$.{k}"), "array<variant>") for k in ("hasVariant", "variants", "offers")]
    some = F.coalesce(*(F.when(F.size(x) > 0, x) for x in lists))
    rows = payloads.select(product, F.posexplode(some).alias("ord", "v")).select(product, "ord", F.to_json("v").alias("v"))
    v, stock = F.col("v"), get(F.col("v"), "availability", "offers.availability")
    given = F.array(*(F.struct(F.lit(n).alias("key"), get(v, n).alias("value")) for n in ("color", "size", "material")))
    return rows.select(
        product, "ord", get(v, "productID", "id", "variant_id").alias("variant_id"), get(v, "sku").alias("sku"), F.map_from_entries(F.filter(given, lambda x: x["value"].isNotNull())).alias("options"),
        get(v, "offers.price", "price").alias("price"), F.coalesce(F.lower(stock).contains("instock"), F.lit(True)).alias("available"), get(v, "url", "offers.url").alias("url"),
    )


def distinct_images(urls: Column) -> Column:
    """Image URLs that differ by more than the size they ask for; the first stays."""
    plain = F.transform(urls, lambda x: F.regexp_replace(F.regexp_replace(F.lower(x), r"[?#].*$", ""), r"[_-]\d+x\d*(?=\.[a-z]+$)", ""))
    return F.filter(urls, lambda x, i: F.array_position(plain, F.element_at(plain, i + 1)) == i + 1)
