"""Variants and JSON trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import values
from millrace.operators import variants
from millrace.sources import json_tree

from .registry import RECORDS, parts, query, records, table

c = F.concat


def lit(x):
    return F.lit(x)


@query("nested_lists", """select event_id, 0 as ord, event_type as title from events union all select event_id, 1, 'second' from events where event_id % 2 = 0""")
def nested_lists(spark, d):
    """The best list lies three levels deep, beside a longer list of numbers and one of lesser objects."""
    first = F.to_json(F.struct(F.col("event_type").alias("title"), F.lit("/x").alias("url")))
    more = F.when(F.col("event_id") % 2 == 0, ',{"title":"second"}').otherwise("")
    body = c(lit('{"ids":[1,2,3,4],"page":{"facets":[{"k":1},{"k":2}],"main":{"block":{"rows":['), first, more, lit("]}}}}"))
    rows = json_tree.nested_records(table(spark, d, "events").select("event_id", body.alias("body")), "event_id", "body")
    return rows.select("event_id", "ord", F.get_json_object("record", "$.title").alias("title"))


@query("record_lists", """with b as (select event_id, event_type t, event_id % 5 k from events)
 select event_id, 0 as ord, t as title from b where k <> 4 union all select event_id, 1, case k when 0 then 'second' when 1 then 'edge' when 2 then 'inner' else 'other' end from b where k <> 4""")
def record_lists(spark, d):
    """By turns: a body that is the list, a graph's edges beside a longer list, items hidden by their list's name, a list
    that the surface's fields refuse, and one that they refuse without another."""
    t, k = F.col("event_type"), F.col("event_id") % 5
    pair = lambda x: c(lit('[{"title":"'), t, lit('"},{"title":"'), lit(x), lit('"}]'))
    many = ",".join('{"k":%d}' % i for i in range(12))
    body = (
        F.when(k == 0, pair("second")).when(k == 1, c(lit('{"facets":[%s],"edges":' % many), pair("edge"), lit("}")))
        .when(k == 2, c(lit('{"rows":[{"items":'), pair("inner"), lit('}],"more":[1,2]}'))).when(k == 3, c(lit('{"data":[%s],"x":{"y":' % many), pair("other"), lit("}}")))
        .otherwise(lit('{"products":[%s],"deep":{"a":[{"a":1}]}}' % many))
    )
    rows = json_tree.nested_records(table(spark, d, "events").select("event_id", body.alias("body")), "event_id", "body", ("title", "url", "price"))
    return rows.select("event_id", "ord", F.get_json_object("record", "$.title").alias("title"))


@query("page_states_json", """select p_partkey, '__NEXT_DATA__' as name, p_name as title from part union all select p_partkey, '__STATE__', p_brand || ' } "x"' from part
  union all select p_partkey, '__NUXT_DATA__', p_type from part union all select p_partkey, 'embedded', p_name from part union all select p_partkey, 'embedded', p_brand || ' } "x"' from part union all select p_partkey, 'embedded', null from part""")
def page_states_json(spark, d):
    page = c(
        lit('<script id="__NEXT_DATA__" type="application/json">{"props":{"title":"'), F.col("p_name"), lit('"}}</script><script>window.__STATE__ = {"props":{"title":"'), F.col("p_brand"), lit(' } \\"x\\""}}; go({});</script>'),
        lit('<script type="application/json" id="__NUXT_DATA__">[["Reactive",1],{"props":2},{"title":3,"self":1},"'), F.col("p_type"), lit('"]</script><script>var x = {"broken": </script>'),
    )
    rows = json_tree.page_states(parts(spark, d).select("p_partkey", F.replace(page, lit('"self":1'), lit('"self":9')).alias("html")), "p_partkey")
    return rows.select("p_partkey", "name", F.get_json_object("payload", "$.props.title").alias("title"))


@query("json_leaves", """select p_partkey, [p_name, p_size::varchar, p_brand] as every, [p_brand] as targeted, '{"a":{"x":1,"y":"' || p_name || '"},"b":[1],"c":2}' as merged, p_size % 2 = 0 as offered, sha256('{"task":"' || p_brand || '","user":"' || p_name || '"}') as key from part""")
def json_leaves(spark, d):
    size = F.col("p_size").cast("string")
    tree = c(lit('{"name":"'), F.col("p_name"), lit('","x":[{"size":'), size, lit(',"Brand":["'), F.col("p_brand"), lit('",null,""]}],"deep":{"a":{"b":{"c":{"d":1}}}}}'))
    base, extra = lit('{"a":{"x":1,"y":""},"b":[1]}'), c(lit('{"a":{"x":5,"y":"'), F.col("p_name"), lit('"},"b":[2],"c":2}'))
    offers = c(lit('{"hasVariant":[{"offers":[{"price":""}]},{"offers":{"price":"'), F.when(F.col("p_size") % 2 == 0, "3").otherwise(""), lit('"}}]}'))
    return parts(spark, d).select(
        "p_partkey", json_tree.leaf_texts(tree).alias("every"), json_tree.leaf_texts(tree, only=["brand"]).alias("targeted"), json_tree.merged(base, extra).alias("merged"),
        json_tree.path_present(offers, "offers.price").alias("offered"), json_tree.cache_key({"user": F.col("p_name"), "task": F.col("p_brand")}).alias("key"),
    )


def rows(spark, d):
    """Variants of each part: by colour and size as two sites spell them, one by a sku, one only by colour."""
    p = parts(spark, d).select("p_partkey", "p_name", "p_size", F.col("p_retailprice").cast("string").alias("price"))
    one = lambda o, vid, sku, options, price, available, url: F.struct(lit(o).alias("ord"), vid.alias("variant_id"), sku.alias("sku"), options.alias("options"), price.alias("price"), available.alias("available"), url.alias("url"))
    none, true, size = lit(None).cast("string"), lit(True), F.col("p_size").cast("string")
    options = lambda **kv: F.create_map(*(x for k, v in kv.items() for x in (lit(k), v)))
    each = F.array(
        one(0, none, none, options(Colour=lit("Red"), Size=c(size, lit(" Regular"))), F.col("price"), lit(False), none),
        one(1, none, none, options(color=lit("Red"), size=size), none, true, c(lit("/v/"), size)),
        one(2, none, c(lit("S-"), size), options(color=lit("Blue")), lit("7"), F.col("p_size") % 2 == 0, none),
        one(3, c(lit("v"), size), none, options(color=lit("Blue (+$5.00)"), size=size), lit("8"), true, none),
        one(4, none, none, options(color=lit("Select color")), none, true, none),
        one(5, none, none, options(color=lit("red")), none, true, none),
    )
    return p.select("p_partkey", F.inline(each))


@query("variant_identities", """select p_partkey, 0 as ord, 'options:Colour=Red|Size=' || p_size || ' Regular' as identity, 'semantic:color=Red|size=' || p_size as semantic from part union all select p_partkey, 1, 'options:color=Red|size=' || p_size, 'semantic:color=Red|size=' || p_size from part
  union all select p_partkey, 2, 'sku:S-' || p_size, 'semantic:color=Blue' from part union all select p_partkey, 3, 'id:v' || p_size, 'semantic:color=Blue|size=' || p_size from part union all select p_partkey, 5, 'options:color=red', 'semantic:color=red' from part""")
def variant_identities(spark, d):
    clean = variants.sanitize(rows(spark, d))
    return clean.select("p_partkey", "ord", variants.identity(F.col("variant_id"), F.col("sku"), F.col("options")).alias("identity"), variants.semantic_identity(F.col("options")).alias("semantic"))


@query("merged_variants", """select p_partkey, 'semantic:color=Red|size=' || p_size as identity, p_retailprice::varchar as price, '/v/' || p_size as url from part union all select p_partkey, 'semantic:color=Blue', '7', null from part
  union all select p_partkey, 'semantic:color=Blue|size=' || p_size, '8', null from part union all select p_partkey, 'semantic:color=red', null, null from part""")
def merged_variants(spark, d):
    return variants.merged(variants.sanitize(rows(spark, d)), "p_partkey", variants.semantic_identity(F.col("options")), ["price", "url"])


@query("whole_variants", """select p_partkey, unnest(case p_partkey % 3 when 0 then [0, 1, 3, 5] when 1 then [0, 1, 2, 3, 5] else [0, 1, 3, 5, 7] end) as ord from part""")
def whole_variants(spark, d):
    """The bare blue variant goes where blue in a size exists, and stays where it has a fit of its own; so does a
    further size, while "red" is another value than "Red"."""
    k = F.col("p_partkey") % 3
    own = F.when((F.col("ord") == 2) & (k == 1), F.map_concat("options", F.create_map(lit("fit"), F.col("p_partkey").cast("string")))).otherwise(F.col("options"))
    made = rows(spark, d).withColumn("options", own)
    more = made.where((F.col("ord") == 3) & (k == 2)).withColumn("ord", lit(7)).withColumn("options", F.create_map(lit("color"), lit("Blue"), lit("size"), lit("other")))
    return variants.without_subsets(variants.sanitize(made.unionByName(more)), "p_partkey").select("p_partkey", "ord")


@query("variant_choices", """select p_partkey, 'Red|Blue' as colors, case when p_size % 2 = 0 then p_size || '|' || p_size + 1 else p_size::varchar end as sizes, 1 + (p_size % 2 = 0)::int as groups from part""")
def variant_choices(spark, d):
    """A size and the same with "Regular" are one choice; every other part has a second size."""
    more = parts(spark, d).where("p_size % 2 = 0").select("p_partkey", lit(9).alias("ord"), F.create_map(lit("Sizes"), c((F.col("p_size") + 1).cast("string"), lit(" standard"))).alias("options"))
    found = variants.axes(variants.sanitize(rows(spark, d)).unionByName(more, allowMissingColumns=True), "p_partkey")
    split = variants.split_axes(found, "p_partkey", always=("size",))
    groups = variants.valid_groups(found).groupBy("p_partkey").agg(F.count("*").cast("int").alias("groups"))
    return split.join(groups, "p_partkey").select("p_partkey", F.col("selectable")["color"].alias("colors"), F.col("selectable")["size"].alias("sizes"), "groups")


@query("flat_variants", "select p_partkey, 'Red' as color, p_size::varchar || ' Regular' as size, p_retailprice::varchar as price from part")
def flat_variants(spark, d):
    return variants.flat(rows(spark, d).where("ord = 0"), ["color", "size"]).select("p_partkey", "color", "size", "price")


@query("selected_variants", """select p_partkey, case when p_size % 3 = 0 then 'v' || p_size when p_size % 2 = 0 then 'b' else 'c' end as variant_id from part""")
def selected_variants(spark, d):
    size = F.col("p_size").cast("string")
    body = c(lit('{"hasVariant":[{"productID":"a","offers":{"price":1,"availability":"https://schema.org/OutOfStock"}},{"id":"b","price":2,"availability":"'), F.when(F.col("p_size") % 2 == 0, "InStock").otherwise("SoldOut"), lit('"},{"productID":"c","color":"x"},{"productID":"v'), size, lit('"}]}'))
    page = F.when(F.col("p_size") % 3 == 0, c(lit("https://x.example.com/p?a=1&variant=v"), size)).otherwise("https://x.example.com/p?variant=gone")
    made = variants.from_products(parts(spark, d).select("p_partkey", body.alias("body")), "p_partkey", "body")
    pages = parts(spark, d).select("p_partkey", page.alias("page"))
    return variants.selected(made.join(pages, "p_partkey"), "p_partkey", F.col("page"))


@query("product_images", """with p as (select *, 'https://i.example.com/' || p_partkey i, p_partkey % 3 k from part)
 select p_partkey, case k when 0 then [i || '_100x200.jpg', 'https://i.example.com/b.jpg'] when 1 then ['https://i.example.com/s' || p_size || '.png', i || '.jpg?w=3'] else [i || '-2.jpg', i || '_400x.jpg', 'https://i.example.com/s' || p_size || '.jpg'] end as images from p""")
def product_images(spark, d):
    """Copies in other sizes, with queries and in other case, by turns; a number in a name is no size."""
    at, k = c(lit("https://i.example.com/"), F.col("p_partkey").cast("string")), F.col("p_partkey") % 3
    own = c(lit("https://i.example.com/s"), F.col("p_size").cast("string"))
    urls = (
        F.when(k == 0, F.array(c(at, lit("_100x200.jpg")), c(at, lit("_400x.jpg")), c(at, lit(".jpg?w=3")), lit("https://i.example.com/b.jpg"), lit("https://I.example.com/b.jpg#x")))
        .when(k == 1, F.array(c(own, lit(".png")), c(at, lit(".jpg?w=3")), c(own, lit("-90x90.PNG")), c(F.upper(own), lit(".png?v=1"))))
        .otherwise(F.array(c(at, lit("-2.jpg")), c(at, lit("_400x.jpg")), c(at, lit(".jpg")), c(own, lit(".jpg"))))
    )
    return parts(spark, d).select("p_partkey", variants.distinct_images(urls).alias("images"))


@query("richest_products", f"""with {RECORDS}, r as (select *, (case when flag <> 'N' then 1 else 0 end) + (case when line_status = 'F' then 1 else 0 end) rich from records)
  select part, arg_max(record_id, (rich, -record_id, price)) as record_id from r group by 1""")
def richest_products(spark, d):
    r = records(spark, d).withColumn("a", F.when(F.col("flag") != "N", F.col("flag"))).withColumn("b", F.when(F.col("line_status") == "F", "F"))
    rank = F.struct(values.count_present("a", "b"), -F.col("record_id"), "price")
    return r.groupBy("part").agg(F.max_by("record_id", rank).alias("record_id"))
