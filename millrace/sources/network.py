"""Listing rows in the JSON bodies that a page loads, whatever lists hold them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import price
from millrace.functions import url as u

from .json_safe import loads

#: How deep rows are looked for.
DEPTH = 12
#: Keys of titles, links, slugs, identifiers, descriptions, images and prices, in order of preference.
TITLES = ("title", "name", "productName", "productTitle", "displayName")
LINKS = ("url", "link", "href", "permalink")
SLUGS = ("slug", "handle")
IDS = ("productId", "product_id", "id")
TEXTS = ("shortDescription", "description")
IMAGES = ("image", "image_url", "imageUrl", "thumbnail", "hoverImage")
PRICES = ("price", "salePrice", "currentPrice", "finalPrice", "amount")


#: What is read of an object: keys, and keys inside where the value is an object.
RAW = {
    "title": (TITLES, ()), "link": (LINKS, ()), "slug": (SLUGS, ()), "product_id": (IDS, ()), "image": (IMAGES, ("url", "src", "href")), "amount": (PRICES, ("amount", "value", "current")), "code": (("currency", "currencyCode", "priceCurrency"), ()), "description": (TEXTS, ()),
}


def _first(x: dict, keys: tuple[str, ...], inner: tuple[str, ...]) -> str | None:
    """The first of some values that is a text or a number, those inside objects before others."""
    values = [x[k].get(i) for k in keys if isinstance(x.get(k), dict) for i in inner] + [x.get(k) for k in keys]
    return next((t for v in values if isinstance(v, (str, int, float)) and not isinstance(v, bool) and (t := str(v).strip())), None)


def _objects(body: str | None) -> list[dict]:
    """RAW, rating and review_count of the objects that have a title and a way to a page, in page order."""
    out, todo = [], [(loads(body), 0)]
    while todo:
        x, depth = todo.pop()
        if isinstance(x, dict):
            raw = {n: _first(x, *how) for n, how in RAW.items()}
            if raw["title"] and (raw["link"] or raw["slug"]):
                options = next((x[k] for k in ("colourOptions", "colorOptions") if isinstance(x.get(k), list)), [])
                raw["image"] = raw["image"] or next((v for o in options if isinstance(o, dict) and (v := _first(o, ("image", "thumbnail", "hoverImage"), ()))), None)
                review = x["review"] if isinstance(x.get("review"), dict) else {}
                out.append(raw | {"rating": _first(review, ("rating",), ()), "review_count": _first(review, ("count",), ())})
        inside = list(x.values()) if isinstance(x, dict) else x if isinstance(x, list) else []
        todo += [(y, depth + 1) for y in reversed(inside) if depth < DEPTH and isinstance(y, (dict, list))]
    return out


def network_rows(bodies: DataFrame, page: str, body: str, page_url: str, place: str) -> DataFrame:
    """(page, ord, title, url, product_id, price, currency, image_url, description, rating, review_count), one row a URL.

    ``bodies`` are a page's payloads in order of ``place``.  A row's URL is its link, else its slug
    below the site's root; the first row of a URL stays.  A body that is no JSON gives nothing.
    """
    kind = "array<struct<" + ",".join(f"{n}:string" for n in (*RAW, "rating", "review_count")) + ">>"
    find = F.pandas_udf(lambda s: pd.Series([_objects(x) for x in s], dtype=object), kind)
    read = bodies.select(page, F.col(page_url).alias("_page"), F.col(place).alias("_place"), F.posexplode(find(F.col(body))).alias("_i", "_x")).select(page, "_page", "_place", "_i", "_x.*")
    at, slug = F.col("_page"), F.col("slug")
    root = F.concat(u.scheme(at), F.lit("://"), u.host(at), F.lit("/"))
    link = F.coalesce(F.nullif(u.absolute(at, F.col("link")), F.lit("")), F.when(slug.rlike("(?i)^https?://"), slug).otherwise(F.concat(root, F.regexp_replace(slug, "^/+", ""))))
    code = F.coalesce("code", F.nullif(price.currency(F.coalesce("amount", F.lit(""))), F.lit("")))
    rows = read.select(
        page, "_place", "_i", "title", link.alias("url"), "product_id", price.as_float(F.col("amount")).alias("price"), code.alias("currency"), F.nullif(u.absolute(at, F.col("image")), F.lit("")).alias("image_url"), "description",
        F.col("rating").try_cast("double").alias("rating"), F.col("review_count").try_cast("bigint").alias("review_count"),
    )
    one = F.row_number().over(Window.partitionBy(page, "url").orderBy("_place", "_i"))
    rows = rows.withColumn("_n", one).where("_n = 1")
    order = F.row_number().over(Window.partitionBy(page).orderBy("_place", "_i"))  # the rows of one page
    return rows.select(page, (order - 1).alias("ord"), "title", "url", "product_id", "price", "currency", "image_url", "description", "rating", "review_count")
