"""Surfaces: which fields a kind of record has, and records projected onto them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import text
from millrace.functions import url as u

#: Canonical fields of each surface.
SURFACES = {
    "ecommerce_detail": ("title", "brand", "price", "currency", "url", "image_url", "sku", "availability", "description", "rating"),
    "ecommerce_listing": ("title", "price", "url", "image_url", "brand"),
    "job_detail": ("title", "company", "location", "salary", "url", "apply_url", "posted_date", "description"),
    "job_listing": ("title", "company", "location", "url"),
    "article_detail": ("title", "url", "author", "published_at", "content", "tags"),
    "content_detail": ("title", "url", "content", "summary"),
    "forum_detail": ("title", "url", "author", "content", "replies", "views"),
}
#: Other names of a field.
ALIASES = {
    "title": ("name", "product_name", "headline", "job_title"), "price": ("sale_price", "current_price", "amount"), "brand": ("manufacturer", "vendor"),
    "url": ("link", "href", "product_url"), "image_url": ("image", "img", "thumbnail"), "company": ("employer", "hiring_organization"), "sku": ("product_id", "item_number"),
    "content": ("body", "text", "article_body"), "posted_date": ("date_posted", "published"), "availability": ("stock", "in_stock"),
}
URL_FIELDS = ("url", "image_url", "apply_url")


def surface_fields(surface: str, requested: tuple[str, ...] = ()) -> list[str]:
    """The surface's fields, then requested ones under their canonical names."""
    return list(dict.fromkeys([*SURFACES[surface], *(canonical_field(r) for r in requested)]))


def canonical_field(label: str) -> str:
    """The field that a label names: an exact alias, else the longest alias whose words
    the label holds, else the label as a key."""
    key = "_".join(label.lower().replace("&", " ").replace("-", " ").split())
    names = {a: f for f, alias in ALIASES.items() for a in (f, *alias)} | {f: f for fs in SURFACES.values() for f in fs}
    if key in names:
        return names[key]
    words = set(key.split("_"))
    inside = [a for a in names if set(a.split("_")) <= words]
    return names[max(inside, key=lambda a: (len(a), a))] if inside else key


def excluded_fields(surface: str) -> list[str]:
    return sorted({f for fs in SURFACES.values() for f in fs} - set(SURFACES[surface]))


def resolve_aliases(df: DataFrame, raw: str, surface: str) -> DataFrame:
    """Renames the keys of a map to canonical fields; of rival keys the field's own name
    wins, then the aliases in their order."""
    names = [(a, f, i) for f in SURFACES[surface] for i, a in enumerate((f, *ALIASES.get(f, ())))]
    lookup = F.create_map(*(F.lit(x) for a, f, _ in names for x in (a, f)))
    order = F.create_map(*(F.lit(x) for a, _, i in names for x in (a, i)))
    entries = F.array_sort(F.transform(F.map_entries(raw), lambda e: F.struct(
        F.coalesce(F.element_at(order, text.field_key(e["key"])), F.lit(len(names))).alias("rank"), F.coalesce(F.element_at(lookup, text.field_key(e["key"])), e["key"]).alias("key"), e["value"].alias("value")
    )))
    first = F.filter(entries, lambda e, i: F.array_position(F.transform(entries, lambda x: x["key"]), e["key"]) == i + 1)
    return df.withColumn(raw, F.map_from_entries(F.transform(first, lambda e: F.struct(e["key"], e["value"]))))


def project_surface(df: DataFrame, raw: str, surface: str, requested: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``data``, the fields allowed and well formed, and ``rejected``, reasons by key.

    Private keys are dropped without a reason.
    """
    fields = surface_fields(surface, requested)

    def problem(k, v):
        return (
            F.when(~k.isin(*fields), "not a field").when(v.isNull() | (F.trim(v) == ""), "empty").when(k.isin(*URL_FIELDS) & ~u.safe(v), "unsafe url")
        )

    public = F.map_filter(raw, lambda k, v: ~k.startswith("_"))
    return df.withColumn("data", F.map_filter(public, lambda k, v: problem(k, v).isNull())).withColumn(
        "rejected", F.map_filter(F.transform_values(public, problem), lambda k, v: v.isNotNull())
    )


def selector_rows(df: DataFrame, key: list[str], rules: str) -> DataFrame:
    """Maps of rules as rows."""
    return df.select(*key, F.explode(rules).alias("field", "rule"))
