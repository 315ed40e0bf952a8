"""Expressions that no other query runs, over titles of documents, names of parts and URLs of pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import price, text
from millrace.functions import url as u

from .registry import query, table

_LOW = "lower(t)"
_SLUG = f"list_filter(string_split_regex({_LOW}, '[^a-z0-9]+'), lambda x: x <> '')"


@query("title_phrases", f"""with d as (select doc_id, substr(coalesce(text, ''), 1, 60) t from documents), k as (select *, list_filter({_SLUG}, lambda x: len(x) >= 3 and x not in ('and', 'for', 'from', 'the', 'with')) w from d),
 s as (select *, list_filter({_SLUG}, lambda x: x not in ('a', 'an', 'and', 'by', 'for', 'from', 'in', 'of', 'on', 'or', 'the', 'to', 'with'))[1:6] z from k)
 select doc_id, case when len(w) > 1 then list_distinct_len else 0 end::int as bigrams, regexp_matches(lower(t), '(^|[^a-z0-9])the([^a-z0-9]|$)') as has_the, trim(regexp_replace(lower(t), '[ \\t\\n\\r\\f]+', ' ', 'g')) as plain, array_to_string(z, '-') as slug,
  list_filter(list_transform(string_split_regex(t, '[,/|]'), lambda x: trim(x)), lambda x: x <> '') as parts from (select *, len(list_distinct(list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1]))) list_distinct_len from s)""")
def title_phrases(spark, d):
    t = F.substring(F.coalesce("text", F.lit("")), 1, 60)
    return table(spark, d, "documents").select(
        "doc_id", F.size(text.bigrams(text.keyword_tokens(t))).alias("bigrams"), text.term_present(t, "the").alias("has_the"), text.normalize_text(t).alias("plain"), text.title_slug(t).alias("slug"), text.split_values(t).alias("parts")
    )


@query("name_forms", """with p as (select *, string_split(p_name, ' ') w, string_split(lower(p_type), ' ') y from part)
 select p_partkey, list_transform(w, lambda x: case when x like '%ies' and len(x) > 4 then x[:-4] || 'y' when x like '%es' and len(x) > 4 then x[:-3] when x like '%s' and x not like '%ss' and len(x) > 3 then x[:-2] else x end) as stems,
  'TV ' || array_to_string(list_transform(w, lambda x: upper(x[1]) || x[2:]), ' ') || ' 4K' as title, case when len(w) <= 4 then p_name end as brand, p_name as once, [p_name, p_brand] as lines,
  round(len(list_intersect(list_distinct(w), y)) / len(list_distinct(w)), 9)::double as weighted from p""")
def name_forms(spark, d):
    name, words = F.col("p_name"), F.split("p_name", " ")
    return table(spark, d, "part").select(
        "p_partkey", F.transform(words, text.stem).alias("stems"), text.title_case(F.concat(F.lit("TV "), name, F.lit(" 4K"))).alias("title"), text.brand_before_mark(F.concat(name, F.lit("™ thing"))).alias("brand"),
        text.undouble(F.concat(name, F.lit(" "), name)).alias("once"), text.split_rows(F.concat(F.lit("• "), name, F.lit("\n\n"), "p_brand")).alias("lines"), F.round(text.weighted_overlap(F.array_distinct(words), F.split(F.lower("p_type"), " ")), 9).alias("weighted"),
    )


_PATH = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
_SEGMENTS = f"list_filter(string_split(lower({_PATH}), '/'), lambda s: s <> '')"


@query("page_urls", f"""with p as (select page_id, url, {_SEGMENTS} s, lower({_PATH}) p, lower(regexp_extract(url, '://([^/?#]*)', 1)) h from pages)
 select page_id, h as host, true as same, trim(regexp_replace(regexp_replace(string_split(regexp_replace({_PATH}, '/+$', ''), '/')[-1], '\\.[A-Za-z0-9]{{2,5}}$', ''), '[-_+]+', ' ', 'g')) as words,
  list_distinct(list_filter(regexp_extract_all(p, '[a-z0-9]{{3,}}'), lambda x: regexp_matches(x, '[0-9]'))) as codes, regexp_matches(p, '/(jobs|careers|openings|vacancies)/?$') as hub, coalesce(s[1], '0') as first_segment, case when len(s) <= 1 then '1' when len(s) <= 3 then '2_3' else '4_plus' end as band from p""")
def page_urls(spark, d):
    link = F.col("url")
    shape = F.split(u.signature(link), r"\|")
    return table(spark, d, "pages").select(
        "page_id", u.host(link).alias("host"), u.same_host(link, F.concat(link, F.lit("?x=1"))).alias("same"), u.last_words(link).alias("words"), u.codes(link).alias("codes"), u.job_hub(link).alias("hub"),
        F.element_at(shape, 1).alias("first_segment"), F.element_at(shape, -1).alias("band"),
    )


@query("number_texts", """select p_partkey, p_partkey + 1000 as whole, (p_size / 10.0)::double as rating, ['$' || p_size, '€ ' || p_size || '.50'] as prices, o_ts + interval (greatest(p_size % 5, 1)) hour as next from part, (select min(o_orderdate) o_ts from orders)""")
def number_texts(spark, d):
    size, key = F.col("p_size").cast("string"), F.col("p_partkey") + 1000
    first = table(spark, d, "orders").agg(F.min("o_orderdate")).scalar()
    return table(spark, d, "part").select(
        "p_partkey", price.first_int(F.concat(F.lit("about "), F.format_number(key, 0), F.lit(" sold, 3 left"))).alias("whole"), price.rating(F.concat((F.col("p_size") / 10).cast("string"), F.lit(" of 5"))).alias("rating"),
        price.price_texts(F.concat(F.lit("was $"), size, F.lit(" or € "), size, F.lit(".50, not "), size)).alias("prices"), price.next_run(first, F.col("p_size") % 5).alias("next"),
    )
