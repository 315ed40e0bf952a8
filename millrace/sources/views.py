"""What a page tells agents and what it shows to people; its images.  All over page trees."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import coerce
from millrace.functions import url as u
from millrace.functions.bind import once
from millrace.operators import variants

from . import html as pages_html
from .json_safe import dumps
from .tree import SEAM

#: How many elements around the heading are weighed, what speaks for one, and the lines it may have (fixed values).
AROUND, PRICE, CART, OPTIONS, LINES = 7, 3, 4, 2, 220
#: Lines after the name in which its price is looked for (fixed value).
NEAR = 70
#: Where images are furniture, and where they show the product: short lists of our own.
FURNITURE = r"(^|[\s_-])(nav|menu|header|footer|logo|icons?|badges?|related|recommend(ed|ations)?|similar|also|carousel-products|upsell|cross-sell|reviews?|payment)($|[\s_-])"
GALLERY = r"(^|[\s_-])(gallery|product-?(image|media|photo)s?|hero|zoom|main-image|pdp)($|[\s_-])"
NOT_PHOTOS = r"(?i)^data:|\.svg([?#]|$)|(sprite|placeholder|spacer|pixel|logo|icon)[^/]*$"


def lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, f"[\n{SEAM}]"), lambda x: F.trim(F.regexp_replace(x, r"[\s\xA0]+", " "))), lambda x: x != "")


def _first_price(ls: Column) -> Column:
    """The first number of the first line that holds one and a dollar sign."""
    found = F.transform(F.filter(ls, lambda x: F.contains(x, F.lit("$"))), lambda x: F.regexp_extract(x, r"\$?\s*([0-9]+(?:\.[0-9]{2})?)", 1))
    return F.get(F.filter(found, lambda x: x != ""), 0)


def product_scope(trees: DataFrame, key: str, *keep: str) -> DataFrame:
    """(key, kept columns, name, scope, page): the lines of the part that sells the product, and of the page.

    Of the elements around the first h1, from the inside, the one that holds most of a price, a
    cart and options, weighed; the innermost of equals.  Without a heading the page is the scope.
    """
    sub = lambda n: F.substring("text", n["start"] + 1, n["end"] - n["start"])
    work = trees.select(key, *keep, "text", F.transform("nodes", lambda n, i: n.withField("node", i.cast("int"))).alias("nodes"))
    work = work.select(key, *keep, "text", "nodes", F.get(F.filter("nodes", lambda n: n["tag"] == "h1"), 0).alias("h1"))
    around = F.slice(F.reverse(F.filter("nodes", lambda n: (n["node"] < F.col("h1.node")) & (n["last"] >= F.col("h1.node")))), 1, AROUND)
    work = work.select(key, *keep, lines(F.col("text")).alias("page"), F.array_join(lines(sub(F.col("h1"))), " ").alias("name"), F.transform(around, lambda n: lines(sub(n))).alias("parts"))

    def score(ls: Column) -> Column:
        has = lambda joined: ((_first_price(ls).isNotNull(), PRICE), (joined.rlike("(?i)add to (cart|bag)"), CART), (joined.rlike("(?i)select size|\ncolor|color:"), OPTIONS))
        return once(F.array_join(ls, "\n"), lambda joined: sum((F.when(c, n).otherwise(0) for c, n in has(joined)), F.lit(0)))

    judged = F.transform(F.coalesce("parts", F.array().cast("array<array<string>>")), lambda ls, i: F.struct(F.when(F.size(ls) <= LINES, score(ls)).otherwise(-1).alias("score"), (-i).alias("place"), ls.alias("lines")))
    best = F.array_max(F.filter(judged, lambda j: j["score"] >= 0))
    return work.select(key, *keep, F.nullif("name", F.lit("")).alias("name"), F.coalesce(best["lines"], F.col("page")).alias("scope"), "page")


def human_view(scoped: DataFrame, key: str, *keep: str) -> DataFrame:
    """(key, kept columns, human): name, price and sale message that people see, as a map of what there is.

    The price is the first near the name in the scope, else the first there, else likewise in the page."""
    named = scoped.select(key, *keep, "name", F.lower("name").alias("_low"), "scope", "page")
    first = lambda ls: F.array_position(F.transform(ls, lambda x: F.contains(F.lower(x), F.col("_low"))), F.lit(True)).cast("int")
    priced = lambda ls: F.exists(ls, lambda x: F.contains(x, F.lit("$")))
    near = lambda ls: F.when(priced(ls), once(first(ls), lambda at: F.when(at > 0, _first_price(F.slice(ls, F.greatest(at, F.lit(1)), NEAR)))))
    amount = F.coalesce(near(F.col("scope")), _first_price(F.col("scope")), near(F.col("page")), _first_price(F.col("page")))
    message = lambda ls: F.get(F.filter(ls, lambda x: x.rlike("(?i)in cart") & x.rlike("(?i)off|discount")), 0)
    found = F.create_map(F.lit("name"), F.col("name"), F.lit("price"), amount, F.lit("sale_messaging"), F.coalesce(message(F.col("scope")), message(F.col("page"))))
    return named.select(key, *keep, F.map_filter(found, lambda k, v: v.isNotNull()).alias("human"))


def agent_view(trees: DataFrame, key: str, *keep: str) -> DataFrame:
    """(key, kept columns, agent): what the richest JSON-LD product says, as a map of what there is."""
    bodies = F.transform(F.filter("scripts", lambda s: F.lower(F.element_at(F.get("nodes", s["node"])["attrs"], F.lit("type"))) == "application/ld+json"), lambda s: s["body"])
    nodes = F.pandas_udf(lambda s: pd.Series([[dumps(n) for n in pages_html.ld_nodes(list(x))] for x in s], dtype=object), "array<string>")
    kinds = lambda x: F.coalesce(F.get_json_object(x, "$['@type']"), F.lit(""))
    own = F.filter("ld", lambda x: kinds(x).rlike(r"(^|\")(Product|ProductGroup)(\"|$)"))
    rich = lambda x: F.size(F.filter(F.map_values(F.from_json(x, "map<string,string>")), lambda v: F.coalesce(v, F.lit("")) != ""))
    found = trees.select(key, *keep, nodes(bodies).alias("ld")).select(key, *keep, F.transform(own, lambda x: F.struct(rich(x).alias("n"), x.alias("x"))).alias("own"))
    best = F.aggregate("own", F.struct(F.lit(-1).alias("n"), F.lit(None).cast("string").alias("x")), lambda a, b: F.when(b["n"] > a["n"], b).otherwise(a))["x"]
    get = lambda *paths: F.coalesce(*(coerce.text_or_none(F.get_json_object("p", f"$.{p}")) for p in paths))
    offer = lambda k: get(f"offers.{k}", f"offers[0].{k}")
    values = {
        "name": get("name"), "price": offer("price"), "currency": offer("priceCurrency"), "availability": F.nullif(F.regexp_replace(offer("availability"), r"^.*/", ""), F.lit("")), "brand": get("brand.name", "brand"), "description": get("description"),
        "sku": F.coalesce(offer("sku"), get("sku")), "gtin": F.coalesce(offer("gtin"), offer("gtin13"), get("gtin", "gtin13")),
    }
    out = found.select(key, *keep, best.alias("p"))
    return out.select(key, *keep, F.map_filter(F.create_map(*(x for k, v in values.items() for x in (F.lit(k), v))), lambda k, v: v.isNotNull()).alias("agent"))


def both_views(trees: DataFrame, key: str) -> DataFrame:
    """(key, agent, human) of each page: both views go along its row, so a page is parsed once and nothing is joined."""
    agent = agent_view(trees, key, "text", "nodes")
    return human_view(product_scope(agent, key, "agent"), key, "agent")


def view_deltas(both: DataFrame, key: str, *keep: str) -> DataFrame:
    """(key, kept columns, fidelity, only_agents, only_people, differ): the share of what people see that
    agents get, and the names of the values that one side lacks or that differ."""
    a, h = F.map_keys("agent"), F.map_keys("human")
    shared = F.array_intersect(a, h)
    differ = F.filter(shared, lambda k: F.lower(F.element_at("agent", k)) != F.lower(F.element_at("human", k)))
    share = F.when(F.size(h) == 0, 1.0).otherwise(F.round(F.size(shared) / F.size(h), 4))
    return both.select(key, *keep, share.alias("fidelity"), F.array_sort(F.array_except(a, h)).alias("only_agents"), F.array_sort(F.array_except(h, a)).alias("only_people"), F.array_sort(differ).alias("differ"))


def page_images(trees: DataFrame, key: str, url: str = "url") -> DataFrame:
    """(key, ord, image_url, points): the images of a page's own product, best first.

    Images inside links to other details are others' and go, as do furniture's and what is no
    photograph; those in galleries come first, then those in page order.  An image in two sizes counts once.
    """
    work = trees.select(key, url, F.transform("nodes", lambda n, i: n.withField("node", i.cast("int"))).alias("nodes"))
    a = lambda n, k: F.nullif(F.trim(F.element_at(n["attrs"], F.lit(k))), F.lit(""))
    mark = lambda n: F.lower(F.concat_ws(" ", a(n, "class"), a(n, "id")))
    src = lambda n: F.coalesce(F.split_part(F.split_part(a(n, "srcset"), F.lit(","), F.lit(1)), F.lit(" "), F.lit(1)), a(n, "src"), a(n, "data-src"), a(n, "data-original"))
    work = work.select(
        key, url, F.filter("nodes", lambda n: n["tag"].isin("img", "source") & src(n).isNotNull()).alias("images"), F.filter("nodes", lambda n: (n["tag"] == "a") & a(n, "href").isNotNull()).alias("links"),
        F.filter("nodes", lambda n: n["tag"].isin("nav", "header", "footer", "aside") | mark(n).rlike(FURNITURE)).alias("furniture"), F.filter("nodes", lambda n: mark(n).rlike(GALLERY)).alias("galleries"),
    )
    holds = lambda z, n: (z["node"] <= n["node"]) & (z["last"] >= n["node"])
    link = lambda n: a(F.element_at(F.filter("links", lambda x: holds(x, n)), -1), "href")
    each = F.transform("images", lambda n: F.struct(
        n["node"].alias("at"), src(n).alias("src"), F.when(F.exists("links", lambda x: holds(x, n)), link(n)).alias("href"), F.exists("furniture", lambda z: holds(z, n)).alias("apart"),
        F.exists("galleries", lambda z: holds(z, n)).alias("shown"), F.coalesce(a(n, "width").try_cast("int"), F.lit(1000)).alias("width"),
    ))
    rows = work.select(key, url, F.inline(each))
    to, image = u.absolute(F.col(url), F.col("href")), u.absolute(F.col(url), F.col("src"))
    other = F.col("href").isNotNull() & u.detail_like(to) & ~to.rlike(r"(?i)\.(jpe?g|png|webp|gif|avif)([?#]|$)") & (u.compare_form(to) != u.compare_form(F.coalesce(F.col(url), F.lit(""))))
    rows = rows.where(~F.coalesce(other, F.lit(False)) & ~F.col("apart") & (F.col("width") >= 50) & ~F.col("src").rlike(NOT_PHOTOS)).select(key, "at", image.alias("image_url"), F.when(F.col("shown"), 2).otherwise(1).alias("points"))
    listed = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct((-F.col("points")).alias("p"), "at", "image_url"))).alias("l"))  # of one page
    urls = variants.distinct_images(F.transform("l", lambda x: x["image_url"]))
    one = listed.select(key, "l", F.posexplode(urls).alias("ord", "image_url"))
    return one.select(key, "ord", "image_url", (-F.get(F.filter("l", lambda x: x["image_url"] == F.col("image_url")), 0)["p"]).alias("points"))


def shown_values(trees: DataFrame, key: str) -> DataFrame:
    """(key, field, value): what a page shows of a product, for records that lack it: title and price from the
    selling scope, brand, sku and the like from its labelled lines ("Brand: Acme")."""
    scoped = product_scope(trees, key)
    human = human_view(scoped, key).select(key, F.explode("human").alias("field", "value"))
    named = human.select(key, F.when(F.col("field") == "name", "title").otherwise(F.col("field")).alias("field"), "value")
    label, value = F.regexp_extract("line", r"^([\p{L} ]{2,30}?)\s*:\s*(\S.*)$", 1), F.regexp_extract("line", r"^([\p{L} ]{2,30}?)\s*:\s*(\S.*)$", 2)
    lined = scoped.select(key, F.explode("scope").alias("line")).select(key, F.lower(F.replace(label, F.lit(" "), F.lit("_"))).alias("field"), value.alias("value")).where("field <> ''")
    return named.unionByName(lined)
