"""Variants from the option groups of page trees: selects, radio groups, swatches.

Groups and choices are nodes; a choice belongs to the innermost group whose interval holds it.
Which combinations exist is never guessed: structured variants meet the page's choices by
value, so no product of axes is made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import coerce
from millrace.functions.bind import once
from millrace.operators import variants

from .tree import spaced

#: What marks a group of choices, a choice, and a choice that can't be had; groups that vary
#: no product.  Short lists of our own.
GROUP_CLASS = r"(^|[\s_-])(swatch(es)?|variants?|variant-picker|options?|option-group|selector)($|[\s_-])"
GONE_CLASS = r"(^|[\s_-])(sold-?out|unavailable|out-of-stock|disabled)($|[\s_-])"
PLACEHOLDER = r"(?i)^(-+\s*)?(please\s+)?(choose|select|pick)\b|^-*$"
OTHER_AXES = "quantity qty sort sort_by order country language currency page per_page rating review country_code".split()


def _attr(n: Column, *names: str) -> Column:
    return F.coalesce(*(F.nullif(F.trim(F.element_at(n["attrs"], F.lit(k))), F.lit("")) for k in names))


def _text(n: Column) -> Column:
    return once(spaced(F.substring("text", n["start"] + 1, n["end"] - n["start"])), lambda t: F.nullif(t, F.lit("")))


def option_rows(trees: DataFrame, key: str) -> DataFrame:
    """(key, ord, group, options, available): a row a choice, ``options`` maps its axis to its value.

    The axis is named by the group's own data, its label, its legend or its name; placeholders
    and groups that vary no product are left out.  A page without groups gives no row.
    """
    role, cls = lambda n: F.lower(_attr(n, "role")), lambda n: F.coalesce(_attr(n, "class"), F.lit(""))
    group = lambda n: n["tag"].isin("select", "fieldset") | F.coalesce(role(n).isin("radiogroup", "listbox"), F.lit(False)) | n["tag"].isin("ul", "ol", "div") & cls(n).rlike(GROUP_CLASS)
    radio = lambda n: (n["tag"] == "input") & F.coalesce(F.lower(_attr(n, "type")) == "radio", F.lit(False))
    given = lambda n: n["tag"].isin("li", "button", "a") & _attr(n, "data-value", "data-option-value").isNotNull()
    choice = lambda n: (n["tag"] == "option") | radio(n) | F.coalesce(role(n).isin("radio", "option"), F.lit(False)) | given(n)
    parts = trees.select(key, "text", F.transform("nodes", lambda n, i: n.withField("node", i.cast("int"))).alias("nodes"))
    parts = parts.select(
        key, "text", F.filter("nodes", group).alias("groups"), F.filter("nodes", choice).alias("choices"), F.filter("nodes", lambda n: n["tag"] == "legend").alias("legends"), F.filter("nodes", lambda n: n["tag"] == "label").alias("labels"),
    )
    named = lambda n: _text(F.get(F.filter("labels", lambda x: _attr(x, "for") == _attr(n, "id")), 0))
    legend = lambda g: _text(F.get(F.filter("legends", lambda x: x["parent"] == g["node"]), 0))
    axis = lambda g: F.coalesce(_attr(g, "data-option-name", "data-attribute-name", "aria-label"), named(g), legend(g), _attr(g, "name"))
    inner = lambda a: F.regexp_replace(F.regexp_replace(F.regexp_replace(a, r"^.*\[([^\]]+)\]$", "$1"), r"(?i)^(attribute_(pa_)?|(choose|select)( an?| your)? |option-)", ""), r"\s*:?\s*$", "")
    parts = parts.withColumn("groups", F.transform("groups", lambda g: F.struct(g["node"].alias("node"), g["last"].alias("last"), once(axis(g), lambda a: variants.axis_key(inner(a))).alias("axis"))))
    wrapped = lambda m: _text(F.get(F.filter("labels", lambda x: (x["node"] < m["node"]) & (x["last"] >= m["node"])), 0))
    value = lambda m: F.when(m["tag"] == "option", _text(m)).when(radio(m), F.coalesce(_attr(m, "aria-label", "data-value"), named(m), wrapped(m), _attr(m, "value"))).otherwise(
        F.coalesce(_attr(m, "data-value", "data-option-value", "aria-label"), _text(m))
    )
    gone = lambda m: F.map_contains_key(m["attrs"], F.lit("disabled")) | F.coalesce(F.lower(_attr(m, "aria-disabled")) == "true", F.lit(False)) | F.lower(cls(m)).rlike(GONE_CLASS)
    blank = lambda m: (m["tag"] == "option") & F.map_contains_key(m["attrs"], F.lit("value")) & _attr(m, "value").isNull()
    around = lambda m: F.array_max(F.filter("groups", lambda g: (g["node"] < m["node"]) & (g["last"] >= m["node"])))
    made = F.transform(F.filter("choices", lambda m: ~blank(m)), lambda m: F.struct(m["node"].alias("ord"), around(m).alias("g"), coerce.option_scalar(value(m)).alias("value"), (~gone(m)).alias("available")))
    # cleaned before the rows are made: a filter on rows is not pushed into what makes them, which would be computed again
    rows = parts.select(key, F.inline(made)).where("g is not null").select(key, "ord", F.col("g.node").alias("group"), F.col("g.axis").alias("axis"), "value", "available")
    rows = rows.where((F.col("axis") != "") & ~F.col("axis").isin(*OTHER_AXES) & F.col("value").isNotNull() & ~F.col("value").rlike(PLACEHOLDER))
    return rows.select(key, "ord", "group", F.create_map("axis", "value").alias("options"), "available")


def choices(found: DataFrame, key: str) -> DataFrame:
    """(key, axis, low, value, available): the distinct choices of axes with two or more, as compared and as shown."""
    each = found.select(key, "ord", "available", F.explode("options").alias("axis", "v"))
    each = each.select(key, "ord", "available", "axis", variants.axis_value(F.col("axis"), F.col("v")).alias("value"))
    one = each.groupBy(key, "axis", F.lower("value").alias("low")).agg(F.min_by("value", "ord").alias("value"), F.max("available").alias("available"))
    real = F.count_if(variants.real_value(F.col("value"))).over(Window.partitionBy(key, "axis"))  # an axis of one page
    return one.withColumn("_n", real).where("_n >= 2").drop("_n")


def existing_variants(found: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """(key, ord, options, available) of the variants that a page's choices leave.

    ``known`` are structured variants (key, ord, options, available, ...).  A row stays where each
    of its options on an axis that the page offers is one of the choices there, and can be had
    where the row and these choices can.  A page without structured variants gives its choices if
    it offers one axis; of several axes nothing says which combinations exist.  The choices of a page,
    a bounded list, meet its variants by key, so the pages behind both are read once.
    """
    offer = F.collect_list(F.struct("axis", "low", "value", "available"))
    page = choices(found, key).groupBy(F.col(key).alias("_key")).agg(offer.alias("offered"))
    keys = F.transform_keys("options", lambda k, v: variants.axis_key(k))
    rows = known.select(key, F.struct(F.col("ord").cast("long").alias("ord"), F.transform_values(keys, lambda k, v: variants.axis_value(k, v)).alias("options"), F.col("available")).alias("row"))
    both = rows.join(page, rows[key] == page["_key"], "full").select(F.coalesce(key, "_key").alias(key), "row", F.coalesce("offered", F.array()).alias("offered"))
    on = lambda e: F.filter("offered", lambda o: o["axis"] == e["key"])
    same = lambda e: F.filter("offered", lambda o: (o["axis"] == e["key"]) & (o["low"] == F.lower(e["value"])))
    entries = F.map_entries(F.col("row.options"))
    real = F.forall(entries, lambda e: (F.size(on(e)) == 0) | (F.size(same(e)) > 0))
    had = F.forall(entries, lambda e: (F.size(on(e)) == 0) | F.exists(same(e), lambda o: o["available"]))
    kept = F.when(real, F.array(F.struct(F.col("row.ord").alias("ord"), F.col("row.options").alias("options"), (F.col("row.available") & had).alias("available"))))
    own = F.transform("offered", lambda o: F.struct(F.xxhash64(o["axis"], o["low"]).alias("ord"), F.create_map(o["axis"], o["value"]).alias("options"), o["available"].alias("available")))
    single = F.size(F.array_distinct(F.transform("offered", lambda o: o["axis"]))) == 1
    return both.select(key, F.inline(F.when(F.col("row").isNotNull(), kept).when(single, own)))
