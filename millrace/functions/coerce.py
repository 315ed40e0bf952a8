"""Values as found on pages, made into what a field holds.  Null where nothing is left."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import price, text
from . import url as u
from .bind import once

#: Kinds of fields by name: a short list of our own; other fields are texts.
KINDS = {
    "price": "price", "sale_price": "price", "original_price": "price", "currency": "currency", "availability": "availability", "rating": "rating", "review_count": "int",
    "url": "url", "image_url": "url", "in_stock": "bool", "description": "long", "brand": "text", "location": "location", "tags": "list", "salary": "salary",
}
#: Titles that name no thing: a short list of our own.
NOISE_TITLES = ("add to cart", "buy now", "click here", "home", "learn more", "login", "menu", "more", "next", "previous", "read more", "search", "see more", "shop now", "sign in", "view all", "view details")


def text_or_none(c: Column) -> Column:
    return F.nullif(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")), F.lit(""))


def decode_escapes(c: Column) -> Column:
    r"""\uXXXX of the Latin block, \n, \r, \t, \/ and quotes as characters; \\ is one backslash.

    Escapes are found by splitting at backslashes, so an escaped one hides what follows.
    """
    parts = F.split(F.replace(c, F.lit("\\\\"), F.lit("\x00")), r"\\")

    def one(s, i):
        code = F.conv(F.substr(s, F.lit(2), F.lit(4)), 16, 10).cast("int")
        plain = (
            F.when(s.rlike("^u00[0-9A-Fa-f]{2}"), F.concat(F.char(code), F.substr(s, F.lit(6)))).when(s.startswith("n"), F.concat(F.lit("\n"), F.substr(s, F.lit(2))))
            .when(s.startswith("t"), F.concat(F.lit("\t"), F.substr(s, F.lit(2)))).when(s.startswith("r"), F.concat(F.lit("\r"), F.substr(s, F.lit(2))))
            .when(s.rlike("^[/\"']"), s).otherwise(F.concat(F.lit("\\"), s))
        )
        return F.when(i == 0, s).otherwise(plain)

    return F.when(c.contains("\\"), F.replace(F.array_join(F.transform(parts, one), ""), F.lit("\x00"), F.lit("\\"))).otherwise(c)


def _list_items(c: Column) -> Column:
    """Items of a text that is a JSON list of texts, else null."""
    return F.when(F.trim(c).rlike(r"^\[.*\]$"), F.from_json(c, "array<string>"))


def coerce_text(c: Column) -> Column:
    """One line of text: lists joined by "; ", tags stripped."""
    items = _list_items(c)
    plain = F.when(c.contains("<") & c.contains(">"), text.strip_tags(c)).otherwise(c)
    return F.when(F.size(items) > 0, text_or_none(F.array_join(items, "; "))).otherwise(text_or_none(plain))


def coerce_long_text(c: Column) -> Column:
    """Text whose block breaks stay as line breaks."""
    marked = F.regexp_replace(c, r"(?i)\s*<(?:br|/p|/div|/li|/h[1-6]|/tr)[^>]*>\s*", "\n")
    lines = F.filter(F.transform(F.split(F.regexp_replace(marked, "<[^>]*>", " "), "\n"), lambda s: F.trim(F.regexp_replace(s, r"[ \t\r\f]+", " "))), lambda s: s != "")
    items = _list_items(c)
    return F.when(F.size(items) > 0, text_or_none(F.array_join(items, "; "))).when(c.contains("<"), F.nullif(F.array_join(lines, "\n"), F.lit(""))).otherwise(text_or_none(c))


def title_noise(c: Column) -> Column:
    """A title that names nothing: empty, a number, a call to act, a rating."""
    t = F.lower(F.coalesce(text_or_none(c), F.lit("")))
    flat = F.regexp_replace(t, r"[\s.…]+$", "")
    stars = t.contains("star") & t.rlike("[0-9]") & (F.size(F.split(t, " ")) <= 4)
    return (t == "") | t.contains("undefined") | t.isin("nan", "none", "null") | t.rlike("^[0-9]+$") | flat.isin(*NOISE_TITLES) | stars | t.rlike(r"^[0-9]+ reviews?$")


def long_text_noise(c: Column) -> Column:
    """A chunk of text that describes nothing."""
    t = F.lower(F.trim(c))
    return (F.length(t) < 3) | t.rlike(r"^(read more|show more|see more|add to (cart|bag)|share|loading)\b") | t.rlike(r"(cookie|javascript) (policy|is disabled|must be enabled)")


def sanitize_long_text(c: Column, title: Column) -> Column:
    """Sentences and lines without noise, repeats and the title alone, joined again."""
    chunks = F.transform(F.split(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?<=[.!?])\s+| : |\n+", "\x01"), "\x01"), lambda s: F.trim(s))
    kept = F.filter(chunks, lambda s: ~long_text_noise(s) & (F.lower(s) != F.lower(F.trim(F.coalesce(title, F.lit(""))))))
    lows = F.transform(kept, F.lower)
    return F.nullif(F.array_join(F.filter(kept, lambda s, i: F.array_position(lows, F.lower(s)) == i + 1), " "), F.lit(""))


def option_scalar(c: Column) -> Column:
    """An option's value without "select", counts and prices."""
    value = F.regexp_replace(F.coalesce(text_or_none(c), F.lit("")), r"(?i)\s*(\((?:\+|-)?\s*[$€£][^)]*\)|\([0-9]+ (?:left|in stock)\)|-\s*sold out)\s*$", "")
    return once(value, lambda t: F.when(~F.lower(t).rlike(r"^(select|choose|please select|pick)\b"), F.nullif(F.trim(t), F.lit(""))))


def location(c: Column) -> Column:
    """City, region, country of an address object as text, or the text itself."""
    parts = [F.get_json_object(c, f"$.{k}") for k in ("addressLocality", "addressRegion", "addressCountry")]
    joined = F.array_join(F.array_distinct(F.array_compact(F.array(*(text_or_none(p) for p in parts)))), ", ")
    return F.when(F.trim(c).startswith("{"), F.nullif(joined, F.lit(""))).otherwise(text_or_none(F.regexp_replace(c, r"(?i)^\s*locations?\s*:\s*", "")))


def string_list(values: Column, most: int, chars: int) -> Column:
    """Cleaned, cut and distinct whatever their case, the first ``most``."""
    cut = F.filter(F.transform(values, lambda v: F.substring(text_or_none(v), 1, chars)), lambda v: v.isNotNull())
    first = lambda cut, lows: F.filter(cut, lambda v, i: F.array_position(lows, F.lower(v)) == i + 1)
    return F.slice(once(cut, lambda cut: once(F.transform(cut, F.lower), lambda lows: first(cut, lows))), 1, most)


def scalar_by_keys(c: Column, keys: list[str]) -> Column:
    """The first of the keys that a JSON object holds a text or number for."""
    return F.when(F.trim(c).startswith("{"), F.coalesce(*(text_or_none(F.get_json_object(c, f"$.{k}")) for k in keys))).otherwise(text_or_none(c))


def price_from_object(c: Column, keys: tuple[str, ...] = ("price", "amount", "value", "lowPrice", "formatted")) -> Column:
    """The first value with a money sign or decimals, else the first that isn't negative."""
    held = once(c, lambda c: F.array(*(text_or_none(F.get_json_object(c, f"$.{k}")) for k in keys)))
    strong = lambda values: F.filter(values, lambda v: v.rlike(r"[$€£¥₹]|[0-9][.,][0-9]{2}\b"))
    return once(F.filter(held, lambda v: v.isNotNull() & ~v.rlike(r"^-")), lambda values: F.coalesce(F.get(strong(values), F.lit(0)), F.get(values, F.lit(0))))


def attributes(m: Column, noise: tuple[str, ...] = ("id", "position", "sort_order", "tracking")) -> Column:
    """An attribute map without empty values and keys of bookkeeping; null if nothing is left."""
    kept = F.map_filter(m, lambda k, v: text_or_none(v).isNotNull() & ~F.lower(F.trim(k)).isin(*noise))
    return F.when(F.size(kept) > 0, F.transform_values(kept, lambda k, v: text_or_none(v)))


def decimal_text(c: Column) -> Column:
    """A price's number, read first as marked text, then as any number."""
    return F.coalesce(price.decimal_price(c), price.canonical_decimal(c)).cast("decimal(18,2)")


def field(name: str, c: Column, page: Column) -> Column:
    """A value as its field holds it, always as text."""
    return once(c, lambda c: _as_kind(KINDS.get(name, "text"), c, page))


def _as_kind(kind: str, c: Column, page: Column) -> Column:
    if kind == "price":
        return price.decimal_price(F.when(F.trim(c).startswith("{"), price_from_object(c)).otherwise(c))
    if kind == "currency":
        return F.nullif(once(scalar_by_keys(c, ["currency", "priceCurrency"]), price.currency), F.lit(""))
    if kind == "url":
        return F.get(u.found_in(c, page), F.lit(0))
    if kind == "list":
        return F.nullif(F.array_join(string_list(F.coalesce(_list_items(c), F.split(c, r"\s*[,;|]\s*")), 20, 80), "; "), F.lit(""))
    made = {
        "availability": price.availability, "rating": lambda x: price.rating(scalar_by_keys(x, ["ratingValue"])).cast("string"), "int": lambda x: price.first_int(x).cast("string"),
        "bool": price.to_bool, "long": coerce_long_text, "location": location, "salary": lambda x: scalar_by_keys(x, ["value", "minValue"]), "text": lambda x: once(scalar_by_keys(x, ["name", "title", "value"]), coerce_text),
    }
    return made[kind](c)


def record(m: Column, names: list[str], page: Column) -> Column:
    """A map of raw values with each named field coerced; what is empty goes, others stay."""

    def coerced(m: Column) -> Column:
        pairs = F.array(*(F.struct(F.lit(n).alias("k"), field(n, F.element_at(m, F.lit(n)), page).alias("v")) for n in names))
        made = F.map_from_entries(F.filter(pairs, lambda p: p["v"].isNotNull()))
        return F.map_concat(F.map_filter(m, lambda k, v: ~k.isin(*names)), made)

    return once(m, coerced)
