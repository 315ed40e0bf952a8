"""The product of a JSON body: objects that look like products, weighed by what they hold."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .json_safe import dumps, loads

#: How deep products are looked for and how many items of a list are entered (fixed values).
DEPTH, WIDTH = 24, 25
#: Keys of titles, of lists of variants, of variant axes, of identifiers, of prices, of images, and
#: keys that speak for a product (fixed values).
TITLES = frozenset("title name productTitle productName nameByLanguage pn copyProductTitle".split())
VARIANTS = ("variants", "availableSizes", "variation_hierarchy")
AXES = frozenset("color size style material flavor scent capacity length width condition grade storage memory finish model".split())
IDENTIFIERS = ("productId", "product_id", "id", "sku", "handle")
PRICES = ("price", "prices", "offers")
IMAGES = ("images", "image")
STRONG = frozenset(
    "variants options variation_hierarchy coreProducts colors sizes prices representative product_type productType vendor brand handle price sku availability category type productId product_id id pid legacyStyleGroupId mrp Img offers images image".split()
)
#: Of the strong keys, those that only name an object, and further keys that products have (fixed values).
WEAK = frozenset("productId product_id id pid legacyStyleGroupId".split())
MORE = frozenset("availableSizes media featuredImage featuredMedia description body_html onlineStoreUrl webPathAlias".split())
#: Types that are no products: a short list of our own.
OTHER_TYPES = frozenset("article blogposting breadcrumblist collection organization person review video webpage website".split())
#: What an object is weighed by, first things first.
FACTS = "variants options choices axes identifiers prices image strong keys".split()


def product_like(x: dict) -> bool:
    """Something names it, something else speaks for a product, and its type for nothing else."""
    kind = next((str(x[k]).strip().casefold() for k in ("type", "product_type", "productType", "@type") if x.get(k)), "")
    return kind not in OTHER_TYPES and bool(TITLES & x.keys()) and bool((STRONG - WEAK | MORE) & x.keys())


def weigh(x: dict) -> list[int]:
    """FACTS of an object."""
    items = lambda k: x[k] if isinstance(x.get(k), list) else []
    rows = [v for k in VARIANTS for v in items(k) if isinstance(v, dict)]
    held = lambda keys: sum(x.get(k) not in (None, "", [], {}) for k in keys)
    return [len(rows), len(items("options")), len(items("colors")) + len(items("sizes")), sum(bool(AXES & v.keys()) for v in rows), held(IDENTIFIERS), held(PRICES), min(1, held(IMAGES)), len(STRONG & x.keys()), len(x)]


def _products(text: str | None) -> list[dict]:
    out, todo = [], [(loads(text), 0)]
    while todo:
        x, depth = todo.pop()
        if isinstance(x, dict) and product_like(x):
            out.append(dict(zip(FACTS, weigh(x), strict=True)) | {"ord": len(out), "payload": dumps(x)})
        inside = list(x.values()) if isinstance(x, dict) else x[:WIDTH] if isinstance(x, list) else []
        todo += [(y, depth + 1) for y in reversed(inside) if depth < DEPTH and isinstance(y, (dict, list))]
    return out


def products(bodies: DataFrame, key: str, body: str) -> DataFrame:
    """(key, FACTS, ord, payload): every object of a body that looks like a product, in page order."""
    kind = "array<struct<" + ",".join(f"{f}:int" for f in (*FACTS, "ord")) + ",payload:string>>"
    find = F.pandas_udf(lambda s: pd.Series([_products(x) for x in s], dtype=object), kind)
    return bodies.select(key, F.inline(find(F.col(body))))


def best_product(found: DataFrame, key: str) -> DataFrame:
    """(key, payload, FACTS): the object that is first by FACTS in their order, then by place."""
    best = F.max_by(F.struct("payload", *FACTS), F.struct(*FACTS, -F.col("ord")))
    return found.groupBy(key).agg(best.alias("b")).select(key, "b.*")
