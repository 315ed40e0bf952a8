"""Text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Function words that keywords leave out: a short list of our own.
STOPWORDS = ("a", "an", "and", "by", "for", "from", "in", "of", "on", "or", "the", "to", "with")


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"[ \t\n\r\f]+", " "))


def normalize_text(c: Column) -> Column:
    """Lower case, single spaces."""
    return collapse(F.lower(c))


def strip_tags(c: Column) -> Column:
    """Tags removed where both brackets occur."""
    return F.when(c.contains("<") & c.contains(">"), collapse(F.regexp_replace(c, r"<[^>]*>", " "))).otherwise(c)


def slug_tokens(c: Column) -> Column:
    """Lower-case runs of a-z0-9, in order."""
    return F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda t: t != "")


def token_set(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda t: F.length(t) > 1))


def keyword_tokens(c: Column, stopwords=STOPWORDS) -> Column:
    """Tokens of three letters or more that aren't stop words; repeats stay."""
    return F.filter(slug_tokens(c), lambda t: (F.length(t) >= 3) & ~t.isin(*stopwords))


def bigrams(tokens: Column) -> Column:
    """Distinct pairs of neighbours."""
    pairs = F.zip_with(F.slice(tokens, 1, F.greatest(F.size(tokens) - 1, F.lit(0))), F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.array_distinct(pairs)


def term_present(c: Column, term: str) -> Column:
    """A whole term, not inside a longer run of letters or digits; ``term`` is plain."""
    return F.lower(c).rlike(f"(^|[^a-z0-9]){term}([^a-z0-9]|$)")


def split_values(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, r"[,/|]"), lambda v: F.trim(v)), lambda v: v != "")


def split_rows(c: Column) -> Column:
    """Lines and bullets as separate values."""
    return F.filter(F.transform(F.split(c, "[\n\r•]+"), lambda v: F.trim(v)), lambda v: v != "")


def normalize_brand(c: Column, aliases: dict[str, str] | None = None) -> Column:
    base = F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))
    if not aliases:
        return base
    table = F.create_map(*(F.lit(x) for kv in aliases.items() for x in kv))
    return F.coalesce(F.element_at(table, base), base)


def title_slug(c: Column, limit: int = 6) -> Column:
    return F.array_join(F.slice(F.filter(slug_tokens(c), lambda t: ~t.isin(*STOPWORDS)), 1, limit), "-")


def stem(c: Column) -> Column:
    """ies -> y, es or s dropped; short words stay."""
    cut = lambda n: F.substring(c, F.lit(1), F.length(c) - n)
    return (
        F.when(c.endswith("ies") & (F.length(c) > 4), F.concat(cut(3), F.lit("y")))
        .when(c.endswith("es") & (F.length(c) > 4), cut(2))
        .when(c.endswith("s") & ~c.endswith("ss") & (F.length(c) > 3), cut(1))
        .otherwise(c)
    )


def identity_tokens(c: Column) -> Column:
    """Tokens with a digit: model numbers and codes."""
    return F.array_distinct(F.filter(slug_tokens(c), lambda t: t.rlike("[0-9]")))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct values; 0 if either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(0.0)


def overlap(a: Column, b: Column) -> Column:
    """Shared values over the smaller array."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.least(F.size(a), F.size(b))).otherwise(0.0)


def weighted_overlap(source: Column, category: Column) -> Column:
    """Shared values over the source's."""
    return F.when(F.size(source) > 0, F.size(F.array_intersect(source, category)) / F.size(source)).otherwise(0.0)


def title_case(c: Column) -> Column:
    """Words capitalised; those that are all capitals or digits stay."""
    return F.array_join(F.transform(F.split(c, " "), lambda w: F.when(w.rlike("^[A-Z0-9]{2,}$"), w).otherwise(F.initcap(w))), " ")


def field_key(c: Column) -> Column:
    """camelCase and spaced labels to snake_case keys."""
    x = F.replace(collapse(c), F.lit("&"), F.lit(" "))
    x = F.regexp_replace(x, "([A-Z]+)([A-Z][a-z])", "$1_$2")
    x = F.lower(F.regexp_replace(x, "([a-z0-9])([A-Z])", "$1_$2"))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(x, "[^a-z0-9_.]+", "_"), "_+", "_"), "^[_.]+|[_.]+$", "")


def brand_before_mark(c: Column, words: int = 4) -> Column:
    """Text up to the first trade mark, if it is short."""
    x = F.trim(F.regexp_extract(c, "^([^™®]+)[™®]", 1))
    return F.when((x != "") & (F.size(F.split(x, " +")) <= words), x)


def undouble(c: Column) -> Column:
    """"a b a b" -> "a b"."""
    w = F.split(collapse(c), " ")
    half = (F.size(w) / 2).cast("int")
    twice = (F.size(w) % 2 == 0) & (F.size(w) > 1) & (F.slice(w, 1, F.greatest(half, F.lit(1))) == F.slice(w, half + 1, F.greatest(half, F.lit(1))))
    return F.when(twice, F.array_join(F.slice(w, 1, F.greatest(half, F.lit(1))), " ")).otherwise(c)


def word_count(c: Column) -> Column:
    return F.regexp_count(F.coalesce(c, F.lit("")), F.lit(r"[\p{L}\p{N}_]+"))


def reading_minutes(words: Column, per_minute: int = 200) -> Column:
    return F.ceil(words / per_minute)


def count_before(c: Column, label: str) -> Column:
    """"1,204 replies" -> 1204."""
    return F.replace(F.regexp_extract(F.lower(c), f"([0-9][0-9,]*) *{label}", 1), F.lit(","), F.lit("")).try_cast("bigint")
