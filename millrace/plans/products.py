"""Text, URL and price expressions, matching, enrichment and record shaping."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.functions import price, text, values
from millrace.functions import url as u
from millrace.operators import matching, shaping

from .registry import query, table
from .relational import DOMAIN_SQL


@query("word_counts", "select doc_id, len(regexp_extract_all(coalesce(text, ''), '[\\p{L}\\p{N}_]+')) as words, ceil(len(regexp_extract_all(coalesce(text, ''), '[\\p{L}\\p{N}_]+')) / 200)::bigint as minutes from documents")
def word_counts(spark, d):
    words = text.word_count(F.col("text")).cast("bigint")
    return table(spark, d, "documents").select("doc_id", words.alias("words"), text.reading_minutes(words).cast("bigint").alias("minutes"))


@query("title_features", """with t as (select p_partkey id, p_name || ' ' || p_brand || ' for the ' || p_type x, p_brand b from part),
  k as (select *, list_filter(regexp_split_to_array(lower(x), '[^a-z0-9]+'), lambda t: t <> '') w from t),
  q as (select *, list_filter(w, lambda t: len(t) >= 3 and t not in ('a','an','and','by','for','from','in','of','on','or','the','to','with')) kw from k)
  select id, array_to_string(w, ' ') as slug, array_to_string(kw, ' ') as keywords, len(kw) as n, trim(regexp_replace(lower(b), '[^a-z0-9]+', ' ', 'g')) as brand,
    array_to_string(list_filter(w, lambda t: regexp_matches(t, '[0-9]')), ' ') as codes, lower(regexp_replace(b, '[^A-Za-z0-9_.]+', '_', 'g')) as field_key from q""")
def title_features(spark, d):
    x = F.concat_ws(" ", "p_name", "p_brand", F.lit("for the"), "p_type")
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("id"), F.array_join(text.slug_tokens(x), " ").alias("slug"), F.array_join(text.keyword_tokens(x), " ").alias("keywords"),
        F.size(text.keyword_tokens(x)).cast("bigint").alias("n"), text.normalize_brand(F.col("p_brand")).alias("brand"), F.array_join(text.identity_tokens(x), " ").alias("codes"),
        text.field_key(F.col("p_brand")).alias("field_key"),
    )


@query("url_features", f"""with p as (select page_id, url, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) path, regexp_extract(url, '^[^?#]*[?]([^#]*)', 1) q,
    {DOMAIN_SQL.format('url')} dom from pages),
  s as (select *, list_filter(regexp_split_to_array(q, '&'), lambda kv: kv <> '' and not starts_with(lower(kv), 'utm_') and split_part(lower(kv), '=', 1) not in ('fbclid','gclid','msclkid','ref','ref_src','mc_cid','mc_eid')) keep from p)
  select page_id, dom as "domain", path, case when q = '' then url else regexp_extract(url, '^([^?#]*)', 1) || case when len(keep) > 0 then '?' || array_to_string(keep, '&') else '' end || regexp_extract(url, '(#.*)$', 1) end as stripped,
    len(list_filter(regexp_split_to_array(path, '/'), lambda x: x <> '')) as depth, split_part(url, '://', 1) || '://' || lower(regexp_extract(url, '://([^/?#]*)', 1)) || case when len(path) > 1 then regexp_replace(path, '/+$', '') else path end as compare_form from s""")
def url_features(spark, d):
    c = F.col("url")
    return table(spark, d, "pages").select(
        "page_id", u.domain(c).alias("domain"), u.path(c).alias("path"), u.strip_tracking(c).alias("stripped"), F.size(u.segments(c)).cast("bigint").alias("depth"), u.compare_form(c).alias("compare_form")
    )


FORMS = """f as (select p_partkey id, p_partkey % 8 k, 100 + p_partkey % 900 v from part),
  t as (select *, case k when 0 then '$' || v when 1 then v || '.50' when 2 then v || ',99 €' when 3 then '€1.' || v when 4 then '-' || v || '.99' when 5 then '1,' || v || '.25 USD' when 6 then 'Rs. ' || v else v::varchar end x from f)"""


def forms(spark, d):
    f = table(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 8).alias("k"), (100 + F.col("p_partkey") % 900).cast("string").alias("v"))
    v, k = F.col("v"), F.col("k")
    x = (
        F.when(k == 0, F.concat(F.lit("$"), v)).when(k == 1, F.concat(v, F.lit(".50"))).when(k == 2, F.concat(v, F.lit(",99 €"))).when(k == 3, F.concat(F.lit("€1."), v))
        .when(k == 4, F.concat(F.lit("-"), v, F.lit(".99"))).when(k == 5, F.concat(F.lit("1,"), v, F.lit(".25 USD"))).when(k == 6, F.concat(F.lit("Rs. "), v)).otherwise(v)
    )
    return f.select("id", x.alias("x"))


@query("price_features", f"""with {FORMS} select id, x as price_text,
   case k when 0 then v::varchar when 1 then v || '.50' when 2 then v || '.99' when 3 then '1' || v when 4 then null when 5 then '1' || v || '.25' when 6 then v::varchar else null end as decimal_price,
   case k when 0 then v when 1 then v + 0.5 when 2 then v + 0.99 when 3 then 1 + v / 1000 when 4 then v + 0.99 when 5 then 1000 + v + 0.25 when 6 then ('0.' || v)::double else v end::double as as_float,
   case k when 0 then 'USD' when 2 then 'EUR' when 3 then 'EUR' when 5 then 'USD' else '' end as currency,
   case k when 4 then -(v + 0.99) when 1 then v + 0.5 when 3 then (1 + v / 1000) when 5 then 1 else v end::double as first_number from t""")
def price_features(spark, d):
    x = F.col("x")
    return forms(spark, d).select(
        "id", x.alias("price_text"), price.decimal_price(x).alias("decimal_price"), price.as_float(x).alias("as_float"), price.currency(x).alias("currency"), price.first_number(x).alias("first_number")
    )


@query("match_scores", """with p as (select p_partkey, p_name, p_brand, p_size::varchar sku, p_retailprice price, row_number() over (partition by p_brand order by p_name, p_partkey) n from part),
  j as (select a.p_partkey s, b.p_partkey c, a.p_name sn, b.p_name cn, a.sku ss, b.sku cs, a.price sp, b.price cp, case b.p_partkey % 3 when 0 then 'retailer' when 1 then 'marketplace' else 'brand_dtc' end st from p a join p b on a.p_brand = b.p_brand and b.n between a.n + 1 and a.n + 3),
  q as (select *, list_distinct(list_filter(string_split(lower(sn), ' '), lambda t: len(t) > 1)) a, list_distinct(list_filter(string_split(lower(cn), ' '), lambda t: len(t) > 1)) b from j),
  r as (select *, len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) ts from q),
  z as (select s, c, ts, round(ts * 0.34 + 0.24 + case when ss = cs then 0.25 else 0 end + case when abs(sp - cp) / sp <= 0.25 then 0.05 else 0 end + case st when 'retailer' then 0.1 when 'marketplace' then 0.06 else 0.12 end, 4) score from r)
  select s as source_id, c as candidate_id, round(ts, 4) as title_similarity, score, case when score >= 0.85 then 'high' when score >= 0.6 then 'medium' when score >= 0.4 then 'low' else 'uncertain' end as label from z""")
def match_scores(spark, d):
    return scored_pairs(spark, d, fuzzy=False)


@query("match_scores_fuzzy")
def match_scores_fuzzy(spark, d):
    """With the sequence ratio of the titles, which SQL has no function for; a test compares it."""
    return scored_pairs(spark, d, fuzzy=True)


def scored_pairs(spark, d, fuzzy):
    # candidates: the next three products of the brand by title, so pairs grow with the table
    w = Window.partitionBy("p_brand").orderBy("p_name", "p_partkey")
    side = F.struct("p_partkey", "p_name", "p_size", "p_retailprice")
    p = table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_size", "p_retailprice", F.array(*(F.lead(side, k).over(w) for k in (1, 2, 3))).alias("next"))
    pairs = p.withColumn("c", F.explode("next")).where("c is not null").select(
        F.col("p_partkey").alias("source_id"), F.col("c.p_partkey").alias("candidate_id"), F.col("p_name").alias("s_title"), F.col("c.p_name").alias("c_title"), F.col("p_brand").alias("s_brand"), F.col("p_brand").alias("c_brand"),
        F.col("p_size").cast("string").alias("s_sku"), F.col("c.p_size").cast("string").alias("c_sku"), F.col("p_retailprice").alias("s_price"), F.col("c.p_retailprice").alias("c_price"),
        F.when(F.col("c.p_partkey") % 3 == 0, "retailer").when(F.col("c.p_partkey") % 3 == 1, "marketplace").otherwise("brand_dtc").alias("source_type"),
    )
    return matching.score_pairs(pairs, fuzzy).select("source_id", "candidate_id", "title_similarity", "score", "label")


@query("taxonomy_candidates", """with c as (select distinct p_type category, w from (select p_type, unnest(string_split(lower(p_name), ' ')) w from part)), i as (select p_partkey item, list_distinct(list_filter(string_split(lower(p_name), ' '), lambda t: t <> '')) t from part),
  h as (select item, len(t) n, category, count(distinct w) k from (select item, t, unnest(t) w from i) join c using (w) group by all),
  s as (select item, category, round(k / n, 4) as overlap from h where k / n >= 0.5), r as (select *, row_number() over (partition by item order by overlap desc, category) as rank from s) select item, category, overlap, rank::int as rank from r where rank <= 3""")
def taxonomy_candidates(spark, d):
    p = table(spark, d, "part")
    categories = p.select(F.col("p_type").alias("category"), F.explode(text.slug_tokens(F.col("p_name"))).alias("token")).distinct()
    return matching.taxonomy_candidates(p.select(F.col("p_partkey").alias("item"), "p_name"), "item", text.slug_tokens(F.col("p_name")), categories)


@query("exact_category", """with c as (select distinct p_type || ' > ' || p_name path, p_name leaf from part), u as (select lower(leaf) l, count(*) n, min(path) m from c group by 1 having count(*) = 1),
  i as (select p_partkey item, case when p_partkey % 5 = 0 then 'no ' || p_name when p_partkey % 2 = 0 then upper(p_name) else p_type || ' > ' || p_name end v from part)
  select item, v as value, coalesce(c.path, u.m) as category, case when c.path is not null then 'path' when u.m is not null then 'leaf' end as matched_by from i left join c on lower(v) = lower(c.path) left join u on lower(v) = l""")
def exact_category(spark, d):
    p = table(spark, d, "part")
    full = F.concat("p_type", F.lit(" > "), "p_name")
    categories = p.select(full.alias("path"), F.col("p_name").alias("leaf")).distinct()
    items = p.select(F.col("p_partkey").alias("item"), F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("no "), F.col("p_name"))).when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(full).alias("value"))
    return matching.exact_category(items, "item", "value", categories)


COLORS = {"red": ("red", "crimson"), "blue": ("blue", "navy"), "green": ("green", "olive"), "neutral": ("small", "large", "tiny")}


@query("enrichment", """with e as (select p_partkey id, p_name n, p_brand b, p_type t, p_partkey % 5 k from part)
  select id, case when regexp_matches(n, '(^|[^a-z0-9])(red|crimson)([^a-z0-9]|$)') then 'red' when regexp_matches(n, '(^|[^a-z0-9])(blue|navy)([^a-z0-9]|$)') then 'blue' when regexp_matches(n, '(^|[^a-z0-9])(green|olive)([^a-z0-9]|$)') then 'green' when regexp_matches(n, '(^|[^a-z0-9])(small|large|tiny)([^a-z0-9]|$)') then 'neutral' end as color_family,
    case k when 0 then 'in_stock' when 1 then 'out_of_stock' when 2 then 'in_stock' when 3 then 'preorder' else 'call us' end as availability,
    array_to_string(list_concat(list_distinct([]::varchar[]), list_filter(['brand', 'price', 'color', 'size'], lambda a: a in ('brand', 'price') or (a = 'color' and k > 1))), ',') as present,
    array_to_string(list_filter(['brand', 'price', 'color', 'size'], lambda a: a = 'size' or (a = 'color' and k <= 1)), ',') as missing from e""")
def enrichment(spark, d):
    k = F.col("p_partkey") % 5
    stock = F.when(k == 0, "https://schema.org/InStock").when(k == 1, "Sold out").when(k == 2, "yes").when(k == 3, "Pre-Order").otherwise("call us")
    have = F.when(k > 1, F.array(F.lit("price"), F.lit("brand"), F.lit("color"))).otherwise(F.array(F.lit("price"), F.lit("brand")))
    present, missing = matching.attribute_gaps(have, ["brand", "price"], ["color", "size"])
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("id"), matching.first_term(F.col("p_name"), COLORS).alias("color_family"), price.availability(stock).alias("availability"), F.array_join(present, ",").alias("present"), F.array_join(missing, ",").alias("missing")
    )


@query("price_ranges", """select p_partkey as id, 10 + p_partkey % 90 as least, case when p_partkey % 2 = 0 then 200 + p_partkey % 90 else 10 + p_partkey % 90 end as most from part""")
def price_ranges(spark, d):
    k = F.col("p_partkey") % 90
    x = F.concat(F.lit("$"), 10 + k, F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(" - $"), 200 + k, F.lit(" each"))).otherwise(" random words"))
    least, most = price.price_range(x)
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), least.cast("bigint").alias("least"), most.cast("bigint").alias("most"))


@query("variant_prices", """with l as (select l_partkey part, list(l_extendedprice / l_quantity) v, min(l_extendedprice / l_quantity) lo from lineitem group by 1), r as (select part, list_distinct(list_transform(list_filter(v, lambda x: x > 0), lambda x: round(x, 2))) u from l)
  select p_partkey as id, round(case when len(u) = 1 then u[1] else p_retailprice end, 2) as price, len(u) as prices from part join r on part = p_partkey""")
def variant_prices(spark, d):
    li = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("part")).agg(F.collect_set(F.col("l_extendedprice") / F.col("l_quantity")).alias("v"))
    j = table(spark, d, "part").join(li, F.col("part") == F.col("p_partkey"))
    one = price.two_places(F.coalesce(price.unanimous(F.col("v")), F.col("p_retailprice")))
    return j.select(F.col("p_partkey").alias("id"), one.alias("price"), F.size(price.positive_prices(F.col("v"))).cast("bigint").alias("prices"))


@query("fingerprints", """select p_partkey as id, sha256('https://x.example.com/' || p_partkey) as identity_key,
   sha256('{"brand":"' || lower(p_brand) || '","title":"' || lower(p_name) || '"}') as fingerprint from part""")
def fingerprints(spark, d):
    link = F.concat(F.lit(" https://x.example.com/"), "p_partkey")
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("id"), values.identity_key(link).alias("identity_key"),
        values.content_fingerprint({"title": F.upper("p_name"), "brand": F.concat("p_brand", F.lit(" ")), "sku": F.lit("")}, link).alias("fingerprint"),
    )


@query("surface_projection", """select p_partkey as id, '{"brand":"' || p_brand || '","price":"' || p_size || '"' || case when p_partkey % 3 = 0 then '' else ',"url":"https://x.example.com/p/' || p_partkey || '"' end || '}' as data,
   case when p_partkey % 3 = 0 then '{"secret":"not a field","title":"empty","url":"unsafe url"}' else '{"secret":"not a field","title":"empty"}' end as rejected from part""")
def surface_projection(spark, d):
    link = F.when(F.col("p_partkey") % 3 == 0, F.lit("javascript:void(0)")).otherwise(F.concat(F.lit("https://x.example.com/p/"), "p_partkey"))
    raw = F.create_map(
        F.lit("brand"), F.col("p_brand"), F.lit("price"), F.col("p_size").cast("string"), F.lit("secret"), F.lit("x"), F.lit("title"), F.lit(" "), F.lit("url"), link, F.lit("_private"), F.lit("y")
    )
    return shaping.project_surface(table(spark, d, "part").select(F.col("p_partkey").alias("id"), raw.alias("raw")), "raw", "ecommerce_detail").select(
        "id", F.to_json("data").alias("data"), F.to_json("rejected").alias("rejected")
    )


@query("export_rows", "select event_id as id, event_type || ',' || coalesce(json_extract_string(props, '$.k'), '') as line from events")
def export_rows(spark, d):
    e = table(spark, d, "events")
    m = F.create_map(F.lit("type"), F.col("event_type"), F.lit("note"), F.lit(""), F.lit("_source"), F.lit("dom"), F.lit("k"), F.get_json_object("props", "$.k"))
    clean = e.select("event_id", values.drop_empty(m).alias("data"))
    return clean.select(F.col("event_id").alias("id"), F.concat_ws(",", F.coalesce(F.col("data")["type"], F.lit("")), F.coalesce(F.col("data")["k"], F.lit(""))).alias("line"))


@query("price_comparison", """select p_brand as brand, count(*) as products, min(p_retailprice) as least, max(p_retailprice) as most, arg_min(p_partkey, (p_retailprice, p_partkey)) as cheapest from part group by 1""")
def price_comparison(spark, d):
    return table(spark, d, "part").groupBy(F.col("p_brand").alias("brand")).agg(
        F.count("*").alias("products"), F.min("p_retailprice").alias("least"), F.max("p_retailprice").alias("most"), F.min_by("p_partkey", F.struct("p_retailprice", "p_partkey")).alias("cheapest")
    )
