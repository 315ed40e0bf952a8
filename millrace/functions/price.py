"""Prices, numbers, availability and dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .bind import once

NUMBER = r"[0-9][0-9.,]*[0-9]|[0-9]"
CURRENCY_CODES = "usd|eur|gbp|jpy|inr|cad|aud"
CURRENCY = rf"([$€£¥₹]|rs\.?|(^|[^a-z])({CURRENCY_CODES})([^a-z]|$))"


def canonical_decimal(c: Column) -> Column:
    """The first number of a text as decimal text: the last of "," and "." is the point.

    A lone comma before one or two digits is a point; dots before groups of three, and
    other commas, separate thousands.
    """
    return once(F.nullif(F.regexp_extract(c, f"({NUMBER})", 1), F.lit("")), _pointed)


def _pointed(n: Column) -> Column:
    dot, comma = n.contains("."), n.contains(",")
    last_comma, last_dot = F.length(n) - F.locate(",", F.reverse(n)), F.length(n) - F.locate(".", F.reverse(n))
    no = lambda x, s: F.replace(x, F.lit(s), F.lit(""))
    tail = F.regexp_extract(n, r",([0-9]*)$", 1)
    head = F.regexp_extract(n, r"^(.*),[0-9]*$", 1)
    return (
        F.when(dot & comma & (last_comma > last_dot), F.replace(no(n, "."), F.lit(","), F.lit(".")))
        .when(dot & comma, no(n, ","))
        .when(comma & F.length(tail).isin(1, 2), F.concat(no(no(head, ","), "."), F.lit("."), tail))
        .when(comma, no(n, ","))
        .when(n.rlike(r"^[0-9]+(\.[0-9]{3})+$"), no(n, "."))
        .otherwise(n)
    )


def decimal_price(c: Column, cents: bool = False) -> Column:
    """A price as decimal text; null for negatives and for bare numbers of up to 3 digits."""
    return once(F.trim(c), lambda t: once(canonical_decimal(t), lambda n: _unless_bare(t, n, cents)))


def _unless_bare(t: Column, n: Column, cents: bool) -> Column:
    bare = ~n.contains(".") & (F.length(n) <= 3) & ~F.lower(t).rlike(CURRENCY)
    value = n
    if cents:
        whole = ~n.contains(".") & (F.length(n) >= 3)
        value = F.when(whole, (n.cast("decimal(18,2)") / 100).cast("decimal(18,2)").cast("string")).otherwise(n)
        bare = F.lit(False)
    negative = F.lower(t).rlike(rf"^-\s*([$€£¥₹]|rs\.?|({CURRENCY_CODES}))?\s*[0-9]")
    return F.when(negative | bare, F.lit(None)).otherwise(value)


def as_float(c: Column) -> Column:
    """Locale float: after the last comma, one to three digits are decimals."""
    t = F.regexp_replace(c, "[^0-9.,]+", "")
    dot, comma = t.contains("."), t.contains(",")
    last_comma, last_dot = F.length(t) - F.locate(",", F.reverse(t)), F.length(t) - F.locate(".", F.reverse(t))
    tail = F.regexp_extract(t, r",([^,]*)$", 1)
    text = (
        F.when(dot & comma & (last_comma > last_dot), F.replace(F.replace(t, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
        .when(dot & comma, F.replace(t, F.lit(","), F.lit("")))
        .when(comma & F.length(tail).between(1, 3), F.regexp_replace(t, r",([^,]*)$", ".$1"))
        .otherwise(F.replace(t, F.lit(","), F.lit("")))
    )
    return F.regexp_replace(text, "[^0-9.]+", "").try_cast("double")


def first_number(c: Column) -> Column:
    """The first number, up to any comma."""
    return F.nullif(F.regexp_extract(c, r"(-?[0-9]+(\.[0-9]+)?)", 1), F.lit("")).try_cast("double")


def first_int(c: Column) -> Column:
    return F.nullif(F.regexp_extract(F.replace(c, F.lit(","), F.lit("")), r"(-?[0-9]+)", 1), F.lit("")).try_cast("bigint")


def price_texts(c: Column) -> Column:
    """All marked prices in a text, in order."""
    return F.regexp_extract_all(c, F.lit(rf"([$€£] ?(?:{NUMBER}))"), F.lit(1))


def currency(c: Column) -> Column:
    return F.when(c.contains("$"), "USD").when(c.contains("€"), "EUR").when(c.contains("£"), "GBP").otherwise(
        F.coalesce(F.nullif(F.upper(F.regexp_extract(F.lower(c), f"(?:^|[^a-z])({CURRENCY_CODES})(?:[^a-z]|$)", 1)), F.lit("")), F.lit(""))
    )


def within_band(a: Column, b: Column, ratio: float = 0.25) -> Column:
    """b within a share of a; false unless both are above 0."""
    return F.coalesce((a > 0) & (b > 0) & (F.abs(a - b) / F.when(a > 0, a) <= ratio), F.lit(False))


def score_label(c: Column) -> Column:
    return F.when(c >= 0.85, "high").when(c >= 0.60, "medium").when(c >= 0.40, "low").otherwise("uncertain")


def confidence_level(c: Column) -> Column:
    return F.when(c >= 0.8, "high").when(c >= 0.55, "medium").otherwise("low")


def to_bool(c: Column) -> Column:
    t = F.lower(F.trim(c))
    return F.when(t.isin("true", "yes", "1", "y"), "true").when(t.isin("false", "no", "0", "n"), "false").otherwise(F.trim(c))


def availability(c: Column) -> Column:
    """Schema.org links, words and flags to one vocabulary; other text stays."""
    t = F.lower(F.trim(c))
    t = F.regexp_replace(t, r"^https?://schema\.org/", "")
    flat = F.regexp_replace(t, "[^a-z]+", "")
    return (
        F.when(flat.contains("outofstock") | flat.contains("soldout") | t.isin("false", "0", "no"), "out_of_stock")
        .when(flat.contains("preorder"), "preorder").when(flat.contains("backorder"), "backorder")
        .when(flat.contains("limited"), "limited_stock").when(flat.contains("instock") | (flat == "available") | t.isin("true", "1", "yes"), "in_stock")
        .otherwise(F.trim(c))
    )


def rating(c: Column) -> Column:
    """Half-even to two places."""
    return F.bround(first_number(c), 2)


def two_places(c: Column) -> Column:
    """A double to two places by way of its hundredths, halves away from zero, as engines round doubles; Spark's round
    goes by a double's decimal text, so the two part where the hundredths come to a half only as a double."""
    return F.round(c * 100) / 100


def positive_prices(values: Column) -> Column:
    """The distinct positive values, to two places."""
    return F.array_distinct(F.transform(F.filter(values, lambda x: x > 0), two_places))


def unanimous(values: Column) -> Column:
    """The one positive value, to two places, that all positive values agree on."""
    return once(positive_prices(values), lambda v: F.when(F.size(v) == 1, F.get(v, F.lit(0))))


def price_range(c: Column) -> tuple[Column, Column]:
    """(least, most) of the prices in a text; equal where there is one."""
    p = F.transform(price_texts(c), lambda x: as_float(x))
    return F.array_min(p), F.array_max(p)


def next_run(now: Column, hours: Column) -> Column:
    return now + F.make_interval(hours=F.greatest(hours, F.lit(1)))


def salary_text(code: Column, least: Column, most: Column, unit: Column) -> Column:
    return F.concat_ws(" ", code, F.when(most.isNull() | (least == most), least.cast("string")).otherwise(F.concat(least.cast("string"), F.lit(" - "), most.cast("string"))), unit)


def listing_price(p: Column, sale: Column, original: Column) -> Column:
    """A listing's price: its own, else the sale price, else the original one."""
    return F.coalesce(*(F.when(F.trim(x) != "", x) for x in (p, sale, original)))


def valid_discounts(p: Column, sale: Column, original: Column, amount: Column, percent: Column) -> dict[str, Column]:
    """Sale price, discount amount and percentage, null where they can't be."""
    bad = (amount <= 0) | (F.coalesce(amount > p, F.lit(False))) | F.coalesce(amount > original, F.lit(False))
    return {
        "sale_price": F.when(~F.coalesce(sale >= p, F.lit(False)), sale), "discount_amount": F.when(~bad, amount), "discount_percentage": F.when((percent > 0) & (percent <= 100), percent),
    }


def cent_copy(a: Column, b: Column) -> Column:
    """a is b in cents."""
    return F.coalesce((b > 0) & (F.abs(a - b * 100) < 0.005), F.lit(False))


def magnitudes(parent: Column, variants: Column, strict: Column) -> tuple[Column, Column]:
    """(parent, variants) without copies in cents: variants that agree repair the parent,
    unless its source is strict; then the parent repairs each variant."""
    one = unanimous(variants)
    fixed = F.when(cent_copy(parent, one) & ~strict, one).otherwise(parent)
    return fixed, F.transform(variants, lambda v: F.when(cent_copy(v, fixed), fixed).otherwise(v))


def zero_price(p: Column, weak: Column, stocked_out: Column, others: Column) -> Column:
    """Zero from weak sources, or of what is sold out, is no price unless another price backs the product."""
    return F.when(~((p == 0) & (weak | stocked_out) & ~F.exists(others, lambda x: x > 0)), p)


def currency_by_url(given: Column, hint: Column, weak: Column) -> Column:
    """The page's currency where none is given, or where the given one comes from a weak source."""
    return F.when(hint.isNotNull() & (given.isNull() | weak), hint).otherwise(given)
