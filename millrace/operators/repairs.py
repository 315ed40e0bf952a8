"""Ordered repairs of records: each rule sees what the rules before it left, and leaves its name."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import coerce, price
from millrace.functions import url as u


#: Rules in one expression.
STEPS = 10


class Rule(NamedTuple):
    """``change`` of the record so far gives the columns that the rule sets."""

    name: str
    change: Callable[[Column], dict[str, Column]]


def repaired(rows: DataFrame, rules: list[Rule], trace: str = "repairs") -> DataFrame:
    """The rows with the rules applied in order, and the names of those that changed something.

    The record goes from rule to rule as one struct that is bound once for each, so the
    expression grows with the rules and not with their product: one projection for each STEPS rules, no shuffle.  Columns
    that no rule names stay as they are; an input column called like ``trace`` is replaced.
    """
    columns = [c for c in rows.columns if c != trace]
    record = F.struct(*(F.col(f"`{c}`") for c in columns), F.array().cast("array<string>").alias(trace))

    def applied(rule: Rule):
        def step(r: Column) -> Column:
            new = rule.change(r)
            moved = F.lit(False)
            for c, v in new.items():
                moved = moved | ~v.eqNullSafe(r[c])
            trail = F.when(moved, F.concat(r[trace], F.array(F.lit(rule.name)))).otherwise(r[trace])
            return F.struct(*(new.get(c, r[c]).alias(c) for c in columns), trail.alias(trace))

        return step

    out = rows.select(record.alias("_r"))
    for at in range(0, len(rules), STEPS):
        record = F.col("_r")
        for rule in rules[at : at + STEPS]:
            record = F.get(F.transform(F.array(record), applied(rule)), 0)
        out = out.select(F.explode_outer(F.array(record)).alias("_r"))  # projections of long chains aren't folded into one
    return out.select("_r.*")


def detail_rules(weak_currency: bool = True) -> list[Rule]:
    """Repairs of a product's detail record, in the order in which later ones rely on earlier ones.

    Columns: url, title, image_url, availability, currency, price, original_price, discount_amount (numbers), and of
    its variants variant_image, variant_availability, variant_prices (arrays of the last two).
    """
    text = lambda r, c: coerce.text_or_none(r[c])

    def availability(r):
        known = F.array_distinct(F.filter(r["variant_availability"], lambda v: v.isNotNull()))
        had = F.array_contains(known, "in_stock")
        unsure = F.coalesce(text(r, "availability"), F.lit("unknown")) == "unknown"
        none = (F.size(known) > 0) & (F.size(F.array_except(known, F.array(F.lit("out_of_stock"), F.lit("unknown")))) == 0)
        return {"availability": F.when(had, "in_stock").when(unsure & none, "out_of_stock").otherwise(r["availability"])}

    def money(r):
        parent, each = price.magnitudes(r["price"], r["variant_prices"], F.lit(False))
        return {"price": parent, "variant_prices": each}

    def within(r):
        one = price.unanimous(r["variant_prices"])
        return {"price": F.when(one.isNotNull() & (r["price"].isNull() | (one != r["price"])), one).otherwise(r["price"])}

    none = F.lit(None)
    return [
        Rule("placeholder title", lambda r: {"title": F.when(~coerce.title_noise(r["title"]), r["title"])}),
        Rule("image from variants", lambda r: {"image_url": F.coalesce(text(r, "image_url"), text(r, "variant_image"))}),
        Rule("availability from variants", availability),
        Rule("currency of the site", lambda r: {"currency": price.currency_by_url(r["currency"], u.currency_hint(r["url"]), F.lit(weak_currency))}),
        Rule("prices in cents", money),
        Rule("price of all variants", within),
        Rule("two places", lambda r: {c: F.bround(r[c], 2) for c in ("price", "original_price", "discount_amount")}),
        Rule("original not above price", lambda r: {"original_price": F.when(r["original_price"] > r["price"], r["original_price"]).otherwise(none)}),
        Rule("discount without original", lambda r: {"discount_amount": F.when(r["original_price"].isNotNull() & (r["discount_amount"] > 0) & (r["discount_amount"] <= r["original_price"]), r["discount_amount"]).otherwise(none)}),
    ]
