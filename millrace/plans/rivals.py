"""Rival payloads, states and record sets, and the repairs of what wins."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import asof, repairs, rivals, terms
from millrace.sources import json_tree, network, payloads

from .registry import parts, query, table

lit, c = F.lit, F.concat


@query("product_choice", """with p as (select *, p_partkey % 3 m, p_partkey % 2 k from part)
 select p_partkey, m > k or m = k and (k = 0 or p_size % 2 = 0) as main, case when m > k or m = k and (k = 0 or p_size % 2 = 0) then p_name else 'related ' || p_brand end as title, greatest(m, k)::int as variants from p""")
def product_choice(spark, d):
    """Two rival products in one state: by variants, then options, choices, axes, identifiers, prices."""
    key = F.col("p_partkey")
    some = lambda n, x: F.array_join(F.array_repeat(x, n.cast("int")), ",")
    own = F.when(F.col("p_size") % 2 == 0, '{"color":"a"}').otherwise('{"sku":"x"}')
    body = c(
        lit('{"menu":[{"title":"Shoes","items":[1,2]}],"x":{"rel":[{"name":"related '), F.col("p_brand"), lit('","id":7,"price":1,"options":[1],"variants":['), some(key % 2, lit('{"size":1}')),
        lit(']}]},"main":{"product":{"title":"'), F.col("p_name"), lit('","sku":"s","price":2,"offers":[1],"options":[2],"variants":['), some(key % 3, own), lit("]}}}"),
    )
    best = payloads.best_product(payloads.products(parts(spark, d).select("p_partkey", body.alias("body")), "p_partkey", "body"), "p_partkey")
    title = F.coalesce(F.get_json_object("payload", "$.title"), F.get_json_object("payload", "$.name"))
    return best.select("p_partkey", (F.get_json_object("payload", "$.sku") == "s").alias("main"), title.alias("title"), "variants").fillna(False, ["main"])


@query("pushed_states", "select p_partkey, p_name as title, p_size::varchar as size, case when p_size % 2 = 0 then p_brand || chr(10) || 'é' end as note from part")
def pushed_states(spark, d):
    """A state cut at a place that differs by row, with references to rows of JSON and of text."""
    brand = c(F.col("p_brand"), lit("\n\u00e9"))
    text = F.when(F.col("p_size") % 2 == 0, c(lit("4:T"), F.lower(F.hex(F.octet_length(brand))), lit(","), brand)).otherwise("")
    state = c(lit('1:["$","div",null,{"product":"$L3"}]\n2:I["chunk",[]]\n'), text, lit('3:{"title":"'), F.col("p_name"), lit('","size":'), F.col("p_size").cast("string"), F.when(F.col("p_size") % 2 == 0, ',"note":"$4"').otherwise(""), lit("}\n"))
    cut = (F.col("p_partkey") % 70 + 1).cast("int")
    js = lambda x: F.replace(F.replace(x, lit('"'), lit('\\"')), lit("\n"), lit("\\n"))
    push = lambda x: c(lit('<script>self.__next_f.push([1,"'), js(x), lit('"])</script>'))
    page = c(lit('<script>self.__next_f.push([0])</script>'), push(F.substring(state, lit(1), cut)), push(F.substring(state, cut + 1, F.length(state))))
    rows = json_tree.page_states(parts(spark, d).select("p_partkey", page.alias("html")), "p_partkey").where("name = '__NEXT_F__'")
    at = lambda k: F.get_json_object("payload", f"$[0][3].product.{k}")
    return rows.select("p_partkey", at("title").alias("title"), at("size").alias("size"), at("note").alias("note"))


def rival_rows(spark, d):
    """Three sources for each order: one knows its first lines by title, one all lines by price, one has no URLs."""
    li = table(spark, d, "lineitem")
    line, part = F.col("l_linenumber"), F.col("l_partkey").cast("string")
    link = c(lit("/p/"), part)
    made = lambda source, place, entries, where: li.where(where).select(
        F.col("l_orderkey").alias("run_id"), lit(source).alias("source"), lit(place).alias("place"), (line * 100 + F.col("l_quantity")).cast("int").alias("ord"), F.create_map(*(x for k, v in entries.items() for x in (lit(k), v))).alias("data")
    )
    stock = F.when(F.col("l_linestatus") != "F", c(lit("b"), line.cast("string")))
    first = made("adapter", 0, {"url": link, "title": c(lit("t"), part), "stock": c(lit("a"), line.cast("string")), "_own": lit("x")}, "l_linenumber <= 3")
    second = made("network", 1, {"url": link, "price": F.col("l_quantity").cast("int").cast("string"), "stock": stock, "title": lit(" ")}, lit(True))
    return first.unionByName(second).unionByName(made("dom", 2, {"title": c(lit("loose "), (F.col("l_partkey") % 3).cast("string"))}, "l_linenumber <= 2"))


@query("rival_sets", """with l as (select l_orderkey o, l_partkey p, l_linenumber n, l_quantity::int q, case when l_linestatus <> 'F' then 'b' || l_linenumber end s from lineitem),
 w as (select o, count(*) filter (n <= 3) = count(*) and 3 * count(*) >= 2 * count(*) + count(s) first from l group by 1),
 g as (select o, p, case when min(n) <= 3 then 't' || p end title, arg_min(q, n * 100 + q)::varchar price, arg_min('a' || n, n * 100 + q) filter (n <= 3) a, arg_min(s, n * 100 + q) filter (s is not null) fb from l group by o, p)
 select o as run_id, '/p/' || p as url, title, price, case when first then coalesce(a, fb) else coalesce(fb, a) end as stock, case when first then 'adapter' else 'network' end as best_source from g join w using (o)
 union all select distinct o, null, 'loose ' || (p % 3), null, null, case when first then 'adapter' else 'network' end from l join w using (o) where n <= 2""")
def rival_sets(spark, d):
    out = rivals.united(rival_rows(spark, d), "run_id")
    return out.select("run_id", "url", *(F.col("data")[k].alias(k) for k in ("title", "price", "stock")), "best_source")


@query("repaired_details", """with k as (select *, p_partkey % 4 k, round(p_retailprice, 2) r from part)
 select p_partkey, case when k = 0 then null else p_name end as title, case when k = 1 then '/own.png' else '/v.png' end as image_url, case k when 0 then 'in_stock' when 1 then 'out_of_stock' when 2 then 'preorder' else 'in_stock' end as availability,
  case when k = 3 then 'GBP' else 'USD' end as currency, r::double as price, case when k = 2 then r + 5 end::double as original_price, case when k = 2 then 5.0::double end as discount_amount,
  list_concat(case when k = 0 then ['placeholder title'] else [] end, case when k = 1 then [] else ['image from variants'] end, case when k in (0, 1) then ['availability from variants'] else [] end, case when k = 3 then ['currency of the site'] else [] end,
   case when k = 0 then ['prices in cents'] when k = 1 then ['price of all variants'] else [] end, case when k in (0, 1) then ['original not above price'] else [] end, case when k <> 2 then ['discount without original'] else [] end) as repairs from k""")
def repaired_details(spark, d):
    """Rules that meet: a parent in cents is mended before its original price is judged, and the discount after it."""
    k, r = F.col("p_partkey") % 4, F.round(F.col("p_retailprice").cast("double"), 2)
    rows = parts(spark, d).select(
        "p_partkey", F.when(k == 3, "https://x.example.co.uk/p").otherwise("https://x.example.com/p").alias("url"), F.when(k == 0, "404").otherwise(F.col("p_name")).alias("title"), F.when(k == 1, "/own.png").when(k == 2, " ").alias("image_url"),
        F.when(k == 2, "preorder").when(k == 3, "in_stock").otherwise(lit("unknown")).alias("availability"), lit("USD").alias("currency"), F.when(k == 0, r * 100).when(k == 1, lit(None)).otherwise(r).cast("double").alias("price"),
        F.when(k.isin(0, 1), r - 1).when(k == 2, r + 5).cast("double").alias("original_price"), lit(5.0).alias("discount_amount"), lit("/v.png").alias("variant_image"),
        F.when(k == 0, F.array(lit("in_stock"), lit("out_of_stock"))).when(k == 1, F.array(lit("out_of_stock"), lit(None))).otherwise(F.array(lit("out_of_stock"), lit("preorder"))).alias("variant_availability"),
        F.when(k == 3, F.array().cast("array<double>")).otherwise(F.array(r, r)).alias("variant_prices"),
    )
    out = repairs.repaired(rows, repairs.detail_rules())
    return out.select("p_partkey", "title", "image_url", "availability", "currency", "price", "original_price", "discount_amount", "repairs")


@query("term_matches", """with p as (select p_partkey, string_split(p_name, ' ') w, lag(p_name, 1, 'no thing') over (order by p_partkey) o, p_brand from part), q as (select p_partkey, w, string_split(o, ' ') v, p_brand from p),
 x as (select p_partkey, 0 place, w[1] || ' ' || w[2] pair, w[2] noun from q union all select p_partkey, 1, v[1] || ' ' || v[2], v[2] from q),
 m as (select p_partkey, place, case when length(pair) % 2 = 0 then pair else noun end as term from x where pair <> 'no thing')
 select p_partkey, 'name' as dimension, (row_number() over (partition by p_partkey order by place) - 1)::int as ord, upper(term) as value, term from m union all select p_partkey, 'brand', 0, 'house', lower(replace(p_brand, '#', ' ')) from q where p_brand like '%1'""")
def term_matches(spark, d):
    """Names of even length and all nouns as terms of one dimension, brands as aliases of another; texts with two names in turn."""
    p = table(spark, d, "part")
    noun, even = F.split_part("p_name", lit(" "), lit(-1)), F.length("p_name") % 2 == 0
    names = p.select(lit("name").alias("dimension"), F.explode(F.array_compact(F.array(F.when(even, F.col("p_name")), noun))).alias("term"))
    brands = p.where(F.col("p_brand").endswith("1")).select(lit("brand").alias("dimension"), F.col("p_brand").alias("term"))
    known = names.withColumn("value", F.upper("term")).unionByName(brands.withColumn("value", lit("house"))).distinct()
    other = p.select((F.col("p_partkey") + 1).alias("p_partkey"), F.col("p_name").alias("other"))
    items = p.join(other, "p_partkey", "left").select("p_partkey", F.concat_ws(" / ", "p_name", "p_brand", F.coalesce("other", lit("no thing"))).alias("text"))
    return terms.term_matches(items, "p_partkey", "text", known)


_KINDS = ("click", "view", "purchase", "error", "signup")


@query("run_recipes", """with e as (select event_id id, ts, user_id % 50 u, event_type k, round(value, 6) v from events), r as (select * from e where id % 3 = 0),
 h as (select distinct on (u, k, ts) u, k, ts, v, id from e where id % 3 <> 0 order by u, k, ts, id desc)
 """ + "select r.id as event_id, " + ", ".join(f"h{i}.id as {k}_id, h{i}.v as {k}_value" for i, k in enumerate(_KINDS)) + " from r " + " ".join(f"asof left join (select * from h where k = '{k}') h{i} on h{i}.u = r.u and h{i}.ts <= r.ts" for i, k in enumerate(_KINDS)))
def run_recipes(spark, d):
    """Every third event is a run; the others are five histories of its user's group."""
    e = table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("at"), (F.col("user_id") % 50).alias("u"), "event_type", F.round("value", 6).alias("v"))
    rest = e.where("id % 3 <> 0")
    histories = {k: (rest.where(F.col("event_type") == k), ["id", "v"]) for k in _KINDS}
    out = asof.as_of(e.where("id % 3 = 0").select("id", "at", "u"), histories, ["u"])
    return out.select(F.col("id").alias("event_id"), *(x for k in _KINDS for x in (F.col(k)["id"].alias(f"{k}_id"), F.col(k)["v"].alias(f"{k}_value"))))


@query("network_rows", """with p as (select *, p_retailprice::decimal(12,2) r, p_partkey % 3 k from part)
 select p_partkey, 0 as ord, p_name as title, 'https://x.example.com/p/' || p_partkey as url, p_partkey::varchar as product_id, r::double as price, case when k = 0 then 'EUR' when k = 1 then 'USD' end as currency, case when k = 2 then 'https://x.example.com/c.png' else 'https://x.example.com/i/' || p_size || '.jpg' end as image_url,
  p_type as description, case when k = 1 then 4.5 end::double as rating, case when k = 1 then p_size end::bigint as review_count from p
 union all select p_partkey, 1, p_brand, 'https://x.example.com/other', null, null, null, null, null, null, null from p where k <> 2""")
def network_rows(spark, d):
    """Rows by link, slug or full slug, with plain or nested prices and images, repeated in a second body beside a row of its own."""
    k, key, amount = F.col("p_partkey") % 3, F.col("p_partkey").cast("string"), F.col("p_retailprice").cast("decimal(12,2)").cast("string")
    way = F.when(k == 0, c(lit('"url":"/p/'), key, lit('"'))).when(k == 1, c(lit('"slug":"p/'), key, lit('"'))).otherwise(c(lit('"handle":"https://x.example.com/p/'), key, lit('"')))
    cost = F.when(k == 0, c(lit('"price":{"value":'), amount, lit('},"currency":"EUR"'))).when(k == 1, c(lit('"salePrice":"$'), amount, lit('","review":{"rating":4.5,"count":'), F.col("p_size").cast("string"), lit("}"))).otherwise(c(lit('"amount":'), amount))
    image = F.when(k == 2, '"colorOptions":[{"thumbnail":"/c.png"}]').otherwise(c(lit('"image":{"src":"/i/'), F.col("p_size").cast("string"), lit('.jpg"}')))
    row = c(lit('{"productName":"'), F.col("p_name"), lit('","id":'), key, lit(',"description":"'), F.col("p_type"), lit('",'), way, lit(","), cost, lit(","), image, lit("}"))
    first = c(lit('{"page":{"title":"x"},"data":[{"edges":[{"node":'), row, lit("}]}]}"))
    second = F.when(k == 2, "not json").otherwise(c(lit("["), row, lit(',{"name":"'), F.col("p_brand"), lit('","link":"/other"},{"name":"no way"}]')))
    p = parts(spark, d)
    bodies = p.select("p_partkey", lit(0).alias("place"), first.alias("body")).unionByName(p.select("p_partkey", lit(1).alias("place"), second.alias("body"))).withColumn("at", lit("https://x.example.com/list?page=1"))
    return network.network_rows(bodies, "p_partkey", "body", "at", "place")
