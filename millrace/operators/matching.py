"""Product matching and enrichment."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import price, text

#: Weights of a match (fixed values).
WEIGHTS = {"title": 0.34, "brand": 0.24, "identifier": 0.25, "price": 0.05, "authority": 0.12}
#: Authority by kind of source (fixed values).
AUTHORITY = {"brand_dtc": 0.18, "retailer": 0.10, "marketplace": 0.06, "aggregator": 0.04, "unknown": 0.0}


def equal_present(a: Column, b: Column) -> Column:
    """Equal after trimming and lowering, and neither empty; missing never matches."""
    x, y = F.lower(F.trim(a)), F.lower(F.trim(b))
    return F.coalesce((x != "") & (x == y), F.lit(False))


def match_score(title: Column, brand: Column, identifier: Column, in_band: Column, source_type: Column) -> Column:
    """Score of a pair from its similarity and agreements, 0 to 1, to four places."""
    authority = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in AUTHORITY.items() for x in kv)), source_type), F.lit(0.0))
    s = (
        title * WEIGHTS["title"] + brand.cast("int") * WEIGHTS["brand"] + identifier.cast("int") * WEIGHTS["identifier"]
        + in_band.cast("int") * WEIGHTS["price"] + F.least(authority, F.lit(WEIGHTS["authority"]))
    )
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), s)), 4)


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """How much of two texts their longest common runs cover, twice the matched over the whole."""
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype=float)


def title_similarity(a: Column, b: Column, fuzzy: bool = True) -> Column:
    """The Jaccard index of the token sets or, if that is more, the sequence ratio of the
    sorted tokens; 0 where either has no token."""
    x, y = text.token_set(a), text.token_set(b)
    overlap = text.jaccard(x, y)
    if not fuzzy:
        return overlap
    line = lambda t: F.array_join(F.sort_array(t), " ")
    return F.when((F.size(x) > 0) & (F.size(y) > 0), F.greatest(overlap, sequence_ratio(line(x), line(y)))).otherwise(F.lit(0.0))


def score_pairs(pairs: DataFrame, fuzzy: bool = True) -> DataFrame:
    """Pairs with s_ and c_ columns (title, brand, sku, price) and source_type -> scored."""
    similarity = title_similarity(F.col("s_title"), F.col("c_title"), fuzzy)
    brand = equal_present(text.normalize_brand(F.col("s_brand")), text.normalize_brand(F.col("c_brand")))
    same = equal_present(F.col("s_sku"), F.col("c_sku"))
    band = price.within_band(F.col("s_price"), F.col("c_price"))
    scored = pairs.withColumn("title_similarity", F.round(similarity, 4)).withColumn("score", match_score(similarity, brand, same, band, F.col("source_type")))
    return scored.withColumn("label", price.score_label(F.col("score")))


def source_type(domain: Column, kinds: dict[str, tuple[str, ...]]) -> Column:
    """Kind of a domain: the first kind one of whose domains it is or lies under."""
    from millrace.functions.url import domain_matches

    out = F
    for kind, domains in kinds.items():
        out = out.when(domain_matches(domain, domains), kind)
    return out.otherwise("unknown")


def taxonomy_candidates(items: DataFrame, item: str, tokens: Column, categories: DataFrame, threshold: float = 0.5, limit: int = 3) -> DataFrame:
    """The best categories of each item by the share of the item's tokens that they hold.

    ``categories`` has (category, token).  A category that holds k of n tokens holds one of the
    n - k + 1 that the fewest categories have: only these make candidates, so a token that
    every category has meets them all only for items without rarer ones.  Candidates are then counted
    by equality of (category, token).  Items are known by ``item``.
    """
    held = categories.select("category", "token").distinct()
    often = held.groupBy("token").agg(F.count("*").alias("_df"))
    own = items.select(item, F.explode(F.array_distinct(tokens)).alias("token")).join(often, "token", "left")
    own = own.groupBy(item).agg(F.array_sort(F.collect_set(F.struct(F.coalesce("_df", F.lit(0)).alias("df"), "token"))).alias("_t"))  # of one item
    own = own.withColumn("_n", F.size("_t"))
    first = F.slice("_t", 1, (F.col("_n") - F.greatest(F.ceil(F.col("_n") * threshold), F.lit(1)) + 1).cast("int"))
    rare = own.select(item, F.explode(F.filter(first, lambda t: t["df"] > 0)).alias("t")).select(item, F.col("t.token").alias("token"))
    met = rare.join(held, "token").select(item, "category").distinct()
    every = own.select(item, "_n", F.explode("_t").alias("t")).select(item, "_n", F.col("t.token").alias("token"))
    hits = met.join(every, item).join(held, ["category", "token"]).groupBy(item, "_n", "category").agg(F.count("*").alias("shared"))
    scored = hits.withColumn("overlap", F.round(F.col("shared") / F.col("_n"), 4)).where(F.col("shared") / F.col("_n") >= threshold)
    rank = F.row_number().over(Window.partitionBy(item).orderBy(F.desc("overlap"), "category"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= limit).select(item, "category", "overlap", "rank")


def exact_category(items: DataFrame, item: str, value: str, categories: DataFrame) -> DataFrame:
    """A category by its path, else by its leaf if no other has it.  (path, leaf)"""
    unique = categories.groupBy(F.lower("leaf").alias("_leaf")).agg(F.count("*").alias("_n"), F.min("path").alias("_by_leaf")).where("_n = 1")
    paths = categories.select(F.lower("path").alias("_path"), F.col("path").alias("_by_path")).distinct()
    out = items.join(paths, F.lower(value) == F.col("_path"), "left").join(unique, F.lower(value) == F.col("_leaf"), "left")
    return out.select(item, value, F.coalesce("_by_path", "_by_leaf").alias("category"), F.when(F.col("_by_path").isNotNull(), "path").when(F.col("_by_leaf").isNotNull(), "leaf").alias("matched_by"))


def first_term(c: Column, terms: dict[str, tuple[str, ...]]) -> Column:
    """The first name one of whose terms stands in the text."""
    out = F
    for name, words in terms.items():
        out = out.when(F.lower(c).rlike("(^|[^a-z0-9])(" + "|".join(words) + ")([^a-z0-9]|$)"), name)
    return out.otherwise(F.lit(None))


def all_terms(c: Column, terms: dict[str, tuple[str, ...]]) -> Column:
    """Every name one of whose terms stands in the text, in the order of the names."""
    return F.array_compact(F.array(*(F.when(F.lower(c).rlike("(^|[^a-z0-9])(" + "|".join(w) + ")([^a-z0-9]|$)"), n) for n, w in terms.items())))


def seo_keywords(*parts: Column, limit: int = 10) -> Column:
    """Distinct keywords and neighbour pairs, in order, up to a limit."""
    tokens = F.flatten(F.array(*(F.coalesce(text.keyword_tokens(p), F.array().cast("array<string>")) for p in parts)))
    return F.slice(F.array_distinct(F.concat(tokens, text.bigrams(text.keyword_tokens(parts[0])))), 1, limit)


def attribute_gaps(have: Column, required: list[str], recommended: list[str]) -> tuple[Column, Column]:
    """(present, missing) of the required and recommended attributes."""
    want = F.array(*(F.lit(x) for x in dict.fromkeys([*required, *recommended])))
    return F.array_intersect(want, have), F.array_except(want, have)
