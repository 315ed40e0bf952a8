"""Derived product attributes, identities of search results, and audits of product data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import coerce, price, text
from millrace.functions import url as u
from millrace.sources import json_tree

#: Sizes: spellings of letter sizes, and systems: short lists of our own.
SIZES = {"small": "S", "medium": "M", "large": "L", "x-large": "XL", "extra large": "XL", "xx-large": "XXL", "x-small": "XS", "one size": "ONE SIZE"}
LETTERS = ("XXS", "XS", "S", "M", "L", "XL", "XXL", "XXXL", "ONE SIZE")
MATERIAL_CONTEXT = (r"\b(?:feels?|looks?) like (?:\w+)", r"\b(?:not|no|without|free of) (?:\w+)", r"\b(?:\w+)[- ]free\b", r"\bfaux \w+")
CONFLICTS = {"pet": ("baby", "men", "women"), "toy": ("vehicle", "furniture"), "baby": ("pet",), "phone": ("furniture",)}
REQUIRED, RECOMMENDED = ("name", "image", "offers.price", "offers.priceCurrency", "offers.availability"), ("description", "brand", "sku", "aggregateRating")


def canonical_size(c: Column) -> Column:
    """A letter size, or a number with its unit; null for what is no size."""
    t = F.lower(F.trim(F.regexp_replace(c, r"(?i)^\s*size\s*[:=]?\s*", "")))
    names = F.create_map(*(F.lit(x) for kv in SIZES.items() for x in kv))
    return F.coalesce(F.element_at(names, t), F.when(F.upper(t).isin(*LETTERS), F.upper(t)), F.when(t.rlike(r"^\d+(\.\d+)?(\s*(m|t|w|y|us|uk|eu|cm|in))?$"), F.upper(F.regexp_replace(t, r"\s+", ""))))


def plausible_size(c: Column) -> Column:
    return canonical_size(c).isNotNull()


def sizes(values: Column) -> tuple[Column, Column]:
    """(distinct sizes in order, their system: letter, numeric, or mixed)."""
    found = F.array_distinct(F.filter(F.transform(values, canonical_size), lambda s: s.isNotNull()))
    letters = F.size(F.filter(found, lambda s: s.isin(*LETTERS)))
    system = F.when(F.size(found) == 0, F.lit(None)).when(letters == F.size(found), "letter").when(letters == 0, "numeric").otherwise("mixed")
    return found, system


def allowed_values(values: Column, allowed: list[str]) -> Column:
    """The allowed values that stand in any of the texts, in order of the texts."""
    each = F.transform(values, lambda v: F.array_compact(F.array(*(F.when(F.lower(v).rlike(rf"(^|[^a-z0-9]){a}([^a-z0-9]|$)"), F.lit(a)) for a in allowed))))
    found = F.array_distinct(F.flatten(each))
    return F.when(F.size(found) > 0, found)


def without_material_context(c: Column) -> Column:
    """Text without phrases that name a material that the product isn't made of."""
    out = F.lower(c)
    for p in MATERIAL_CONTEXT:
        out = F.regexp_replace(out, p, " ")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def context_conflict(tokens: Column, category: Column) -> Column:
    """A token rules out the category's words."""
    words = F.filter(F.split(F.lower(category), "[^a-z0-9]+"), lambda w: w != "")
    out = F.lit(False)
    for token, against in CONFLICTS.items():
        out = out | (F.array_contains(tokens, token) & F.arrays_overlap(words, F.array(*(F.lit(x) for x in against))))
    return out


def known_brand(items: DataFrame, item: str, title: str, brands: DataFrame, brand: str) -> DataFrame:
    """(item, brand): the longest known brand whose words stand in the title one after another.

    Brands meet titles by the one of their words that the fewest brands have, so that a word common among
    brands ("the", "co") brings a title only the brands that have no rarer one.
    """
    pad = lambda words: F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    named = brands.select(F.col(brand).alias("brand")).distinct().withColumn("words", text.slug_tokens(F.col("brand"))).where(F.size("words") > 0)
    each = named.select("brand", F.explode(F.array_distinct("words")).alias("word"))
    often = each.groupBy("word").agg(F.count("*").alias("df"))
    rare = each.join(often, "word").groupBy("brand").agg(F.min_by("word", F.struct("df", "word")).alias("word"))
    b = named.select("brand", pad(F.col("words")).alias("bt")).join(rare, "brand").select("word", "brand", "bt")
    words = text.slug_tokens(F.col(title))
    t = items.select(item, pad(words).alias("tt"), F.explode(F.array_distinct(words)).alias("word"))
    hit = t.join(b, "word").where(F.contains("tt", "bt"))
    best = hit.groupBy(item).agg(F.max_by("brand", F.struct(F.length("bt"), "brand")).alias("brand"))
    return items.select(item).join(best, item, "left")


def brand_from_url(link: Column, title: Column, most: int = 4) -> Column:
    """The words before the title in a part of the URL's path that holds the whole title, the last such part.

    The title has two words at least; the words before it are ``most`` at most and not all numbers.
    """
    pad = lambda x: F.concat(F.lit(" "), F.array_join(text.slug_tokens(x), " "), F.lit(" "))
    parts = F.reverse(F.transform(F.filter(F.split(u.path(link), "/"), lambda p: p != ""), lambda p: pad(F.split_part(p, F.lit("."), F.lit(1)))))
    wanted = pad(title)

    def before(p: Column) -> Column:
        at = F.instr(F.substring(p, F.lit(2), F.length(p)), wanted)
        return F.when(at > 1, F.substring(p, F.lit(2), at - 1))

    fits = lambda x: x.isNotNull() & (F.size(F.split(x, " ")) <= most) & x.rlike("[a-z]")
    found = F.filter(F.transform(parts, before), fits)
    return F.when(F.size(text.slug_tokens(title)) >= 2, F.initcap(F.get(found, 0)))


def overlap_mismatch(a: Column, b: Column, share: float = 0.5) -> Column:
    """The words shared are less than a share of the shorter title's."""
    x, y = F.array_distinct(text.slug_tokens(a)), F.array_distinct(text.slug_tokens(b))
    return F.size(F.array_intersect(x, y)) / F.greatest(F.least(F.size(x), F.size(y)), F.lit(1)) < share


def same_identity(page: Column, link: Column, title: Column) -> Column:
    """The record is the page's: a code in both URLs, else at least two of the page's words in its title."""
    codes = F.arrays_overlap(u.codes(page), u.codes(link))
    wanted = F.filter(text.slug_tokens(u.last_words(page)), lambda t: (F.length(t) > 2) & ~t.rlike("[0-9]"))
    shared = F.size(F.array_intersect(wanted, text.slug_tokens(title)))
    return F.coalesce(codes | (F.size(wanted) > 0) & (shared >= F.least(F.lit(2), F.size(wanted))), F.lit(False))


def search_queries(brand: Column, title: Column, sku: Column, domain: Column) -> Column:
    """Queries for a product elsewhere, the surest first."""
    without = lambda q: F.concat(q, F.lit(" -site:"), domain)
    full = F.trim(F.concat_ws(" ", F.when(~F.contains(F.lower(title), F.lower(brand)), brand), title))
    return F.array_distinct(F.array_compact(F.array(F.when(F.length(sku) >= 4, without(F.concat(F.lit('"'), sku, F.lit('"')))), without(full), full)))


def snapshot(columns: dict[str, Column], link: Column) -> dict[str, Column]:
    """Canonical columns of a product: cleaned texts, price, currency, domain, words of its title."""
    given = {n: coerce.text_or_none(columns[n]) for n in ("title", "brand", "sku", "gtin") if n in columns}
    marked = columns["price"]
    return {**given, "price": price.as_float(marked), "currency": F.nullif(price.currency(marked), F.lit("")), "domain": u.domain(link), "tokens": F.array_distinct(text.slug_tokens(columns["title"]))}


def result_score(product: Column, found: Column, detail_like: Column, own_domain: Column) -> Column:
    """0 to 1 for a search result: words, brand and price shared, and a URL of a detail page.

    The product's own site is no result: it scores 0.
    """
    a, b = product["tokens"], found["tokens"]
    words = F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1))
    brand = F.coalesce(F.lower(product["brand"]) == F.lower(found["brand"]), F.lit(False))
    near = price.within_band(product["price"], found["price"])
    points = 0.5 * words + F.when(brand, 0.2).otherwise(0.0) + F.when(near, 0.15).otherwise(0.0) + F.when(detail_like, 0.15).otherwise(0.0)
    return F.when(own_domain, 0.0).otherwise(F.round(points, 4))


def schema_score(payload: Column) -> tuple[Column, Column]:
    """(completeness in percent, missing required paths) of a structured product."""
    has = {p: F.coalesce(json_tree.path_present(payload, p), F.lit(False)) for p in (*REQUIRED, *RECOMMENDED, "additionalProperty")}
    found = sum((c.cast("int") for c in has.values()), F.lit(0))
    return F.floor(found * 100 / len(has)).cast("int"), F.array_compact(F.array(*(F.when(~has[p], p) for p in REQUIRED)))


def variant_report(rows: DataFrame, product: str) -> DataFrame:
    """Per product: variants, whether several share one offer, and those without sku or availability."""
    no = lambda c: F.count_if(coerce.text_or_none(F.col(c)).isNull())
    return rows.groupBy(product).agg(
        F.count("*").alias("variants"), ((F.count("*") > 1) & (F.countDistinct("price", "url") <= 1)).alias("collapsed"), no("sku").alias("missing_sku"), no("availability").alias("missing_availability"),
    )


def readability(*signals: Column) -> Column:
    """25 points a signal that a machine can read."""
    return sum((F.coalesce(s, F.lit(False)).cast("int") for s in signals), F.lit(0)) * 25


def view_delta(agent: Column, human: Column) -> tuple[Column, Column]:
    """(only agents see, only people see) of two lists of values."""
    return F.array_sort(F.array_except(agent, human)), F.array_sort(F.array_except(human, agent))
