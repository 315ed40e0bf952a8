"""Pages to records: listing cards, tables, articles, threads and product details."""

from __future__ import annotations

import bisect
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import coerce, price
from millrace.functions import url as u
from millrace.functions.bind import once

from . import html as pages_html
from .json_safe import dumps
from .selectors import Nodes
from .tree import SEAM, Tree

#: Elements that may be a card, those whose links only navigate, and those that name a card.
CARD_TAGS = frozenset("a article div li section td tr".split())
CHROME = frozenset("nav footer header aside".split())
NAMES = frozenset("h1 h2 h3 h4".split())
#: How far up from its link a card is looked for.
CLIMB = 40
ENTRY = "source string, ord int, href string, title string, image string, text string, shape string, item string"
#: Where a field's value comes from, best first: our order.
TIERS = ("json_ld", "microdata", "opengraph", "table", "dom")


def card_nodes(n: Nodes) -> list[tuple[int, int]]:
    """(card, its first link) of a page.

    A link's card is the nearest element around it that repeats: a sibling of the same tag and
    classes holds a link too.  A link is a card itself only if it holds a heading or an image.
    Where nothing repeats, it is the widest element without another address.  Of cards in cards the inner
    ones count; links of navigation, headers and footers make none.
    """
    size = len(n.tag)
    chrome, links = [False] * size, []
    for i in range(size):
        chrome[i] = n.tag[i] in CHROME or n.parent[i] >= 0 and chrome[n.parent[i]]
        if n.tag[i] == "a" and n.attrs[i].get("href") and not chrome[i]:
            links.append(i)
    holds = lambda i: bisect.bisect_right(links, n.last[i]) > bisect.bisect_left(links, i)
    sign = lambda i: (n.parent[i], n.tag[i], n.attrs[i].get("class", ""))
    alike = Counter(sign(i) for i in range(size) if n.tag[i] in CARD_TAGS and holds(i))
    rich = lambda i: any(n.tag[k] in NAMES or n.tag[k] == "img" for k in range(i + 1, n.last[i] + 1))
    cards: dict[int, int] = {}
    for link in links:
        at, card = link, None
        for _ in range(CLIMB):
            if n.tag[at] in CARD_TAGS and alike[sign(at)] > 1 and (at != link or rich(link)):
                card = at
                break
            at = n.parent[at]
            if at < 0:
                break
        if card is None:
            card, at, own = link, n.parent[link], n.attrs[link]["href"]
            for _ in range(CLIMB):
                inside = links[bisect.bisect_left(links, at) : bisect.bisect_right(links, n.last[at])] if at >= 0 else []
                if not inside or any(n.attrs[k]["href"] != own for k in (inside[0], inside[-1])) or n.tag[at] in ("body", "html", "main"):
                    break
                card, at = at if n.tag[at] in CARD_TAGS else card, n.parent[at]
        cards.setdefault(card, link)
    order = sorted(cards)
    return [(c, cards[c]) for k, c in enumerate(order) if k + 1 == len(order) or order[k + 1] > n.last[c]]


def _entries(page: str) -> list[tuple]:
    """ENTRY of a page, from one parse: its cards, and its JSON-LD nodes in their order."""
    row = Tree(page).row()
    n = Nodes(row["text"], *([x[k] for x in row["nodes"]] for k in ("parent", "last", "nth", "of_type", "tag", "attrs", "start", "end")))
    clean = lambda i: " ".join(n.within(i).replace(SEAM, " ").split())
    out = []
    for k, (card, link) in enumerate(card_nodes(n)):
        inside = range(card, n.last[card] + 1)
        named = next((t for i in inside if n.tag[i] in NAMES and (t := clean(i))), None)
        title = named or next((t for i in inside if n.tag[i] == "a" and n.attrs[i].get("href") == n.attrs[link]["href"] and (t := clean(i))), "")
        image = next((v for i in inside if n.tag[i] == "img" and (v := n.attrs[i].get("src") or n.attrs[i].get("data-src"))), "")
        shape = [n.tag[card], *sorted(n.attrs[card].get("class", "").split()), *(n.tag[i] for i in inside[1:])]
        out.append(("cards", k, n.attrs[link]["href"], title, image, clean(card), " ".join(shape[:12]), None))
    scripts = [x["body"] for x in row["scripts"] if n.attrs[x["node"]].get("type") == "application/ld+json"]
    return out + [("structured", k, *[None] * 5, dumps(x)) for k, x in enumerate(pages_html.ld_nodes(scripts))]


def entries(pages: DataFrame, key: str, html: str = "html", url: str = "url") -> DataFrame:
    """(key, page_url, ENTRY): the cards and JSON-LD nodes of each page, each page parsed once."""
    picked = pages.select(key, F.col(url).cast("string").alias("page_url"), F.coalesce(F.col(html).cast("string"), F.lit("")).alias("_page"))
    types = [pa.string(), pa.int32(), *[pa.string()] * 6]

    def run(batches):
        for batch in batches:
            rows, owners = [], []
            for k, page in enumerate(batch.column("_page")):
                got = _entries(page.as_py())
                rows += got
                owners += [k] * len(got)
            at = pa.array(owners, pa.int32())
            columns = zip(*rows, strict=True) if rows else [()] * len(types)
            names = [c.split()[0] for c in ENTRY.split(", ")]
            yield pa.RecordBatch.from_arrays([batch.column(key).take(at), batch.column("page_url").take(at), *(pa.array(list(c), t) for c, t in zip(columns, types, strict=True))], [key, "page_url", *names])

    return picked.mapInArrow(run, f"{key} {pages.select(key).schema[0].dataType.simpleString()}, page_url string, {ENTRY}")


def noise_record(title: Column, link: Column, page: Column) -> Column:
    """A row that names nothing or leads nowhere: shells, service pages, the page itself."""
    return coerce.title_noise(title) | ~u.safe(link) | u.structural(link, page) | (u.utility(link) & ~u.detail_like(link)) | (link == page)


def supported(title: Column, link: Column, amount: Column, image: Column, job: bool = False) -> Column:
    """Something speaks for the row: a detail-like URL, a price, an image or, of jobs, a posting."""
    signs = u.detail_like(link, job) | amount.isNotNull() | (F.coalesce(image, F.lit("")) != "")
    return F.coalesce(signs | u.job_posting(link) if job else signs, F.lit(False))


def quality(title: Column, link: Column, amount: Column, image: Column) -> Column:
    """Points of a row: what it has, and how it looks."""
    points = [(u.detail_like(link), 8), (amount.isNotNull(), 6), (F.coalesce(image, F.lit("")) != "", 3), (F.length(title) >= 12, 2), (u.utility(link), -12), (F.length(title) < 4, -4)]
    return sum((F.when(F.coalesce(c, F.lit(False)), n).otherwise(0) for c, n in points), F.lit(0))


def dedupe_key(link: Column, title: Column) -> Column:
    """The URL as compared, else the title."""
    return F.coalesce(F.nullif(u.compare_form(link), F.lit("")), F.lower(F.trim(title)))


def records(found: DataFrame, key: str) -> DataFrame:
    """Entries as rows (key, page_url, source, ord, title, url, price, currency, image_url, shape): cards,
    typed items, and the items of lists that are on the page's own site."""
    page, none = F.col("page_url"), F.array().cast("array<string>")
    listed = F.coalesce(F.from_json(F.get_json_object("item", "$.itemListElement"), "array<variant>"), F.array().cast("array<variant>"))
    inner = F.transform(listed, lambda v: F.coalesce(F.get_json_object(F.to_json(v), "$.item"), F.to_json(v)))
    own = F.when(F.get_json_object("item", "$['@type']").isin("Product", "JobPosting", "Article"), F.array("item")).otherwise(none)
    get = lambda x, *paths: F.coalesce(*(coerce.text_or_none(F.get_json_object(x, f"$.{p}")) for p in paths))

    def row(at, title, link, amount, currency, image):
        made = once(u.absolute(page, image), lambda i: F.nullif(i, F.lit("")))
        named = zip(("ord", "title", "url", "price", "currency", "image_url"), (at, title, u.absolute(page, link), price.as_float(amount), currency, made), strict=True)
        return F.struct(*(v.alias(n) for n, v in named))

    card = once(F.get(price.price_texts(F.col("text")), F.lit(0)), lambda amount: row(F.col("ord"), F.trim("title"), F.col("href"), amount, F.nullif(price.currency(F.coalesce(amount, F.lit(""))), F.lit("")), F.col("image")))
    item = lambda x, i: row((F.col("ord") * 1000 + i).cast("int"), get(x, "name", "title"), get(x, "url", "['@id']"), get(x, "offers.price", "price"), get(x, "offers.priceCurrency", "priceCurrency"), get(x, "image", "image.url"))
    # resolved before the rows are made: a filter on rows is not pushed into what makes them, which would be computed again
    rows = found.select(key, "page_url", "source", F.coalesce("shape", F.lit("")).alias("shape"), F.inline(F.when(F.col("source") == "cards", F.array(card)).otherwise(F.transform(F.concat(inner, own), item))))
    rows = rows.select(key, "page_url", "source", "ord", "title", "url", "price", "currency", "image_url", "shape")
    return rows.where((F.col("source") == "cards") | F.expr("title is not null and url <> '' and url <> page_url") & u.same_host(page, F.col("url")))


def listing_records(pages: DataFrame, key: str, html: str = "html", url: str = "url", least: int = 2) -> DataFrame:
    """(key, ord, title, url, price, currency, image_url, source): the best candidate set of each page.

    Sets are the structured items and, by shape, the cards without noise that something
    supports.  A set needs ``least`` rows; the one of most points wins, structured ones first.  URLs are
    distinct within a page.  A page is parsed once and its rows are shuffled once, by ``key``.
    """
    args = (F.col("title"), F.col("url"), F.col("price"), F.col("image_url"))
    rows = records(entries(pages, key, html, url), key).withColumn("points", quality(*args))
    fit = ~F.coalesce(noise_record(F.col("title"), F.col("url"), F.col("page_url")), F.lit(True)) & supported(*args) & (F.col("points") >= 0)
    rows = rows.where((F.col("source") == "structured") | fit).withColumn("same", dedupe_key(F.col("url"), F.col("title"))).repartition(key)
    one = F.row_number().over(Window.partitionBy(key, "source", "shape", "same").orderBy(F.desc("points"), "ord"))
    whole = Window.partitionBy(key, "source", "shape")
    rows = rows.withColumn("n", one).where("n = 1").withColumn("total", F.sum("points").over(whole)).withColumn("size", F.count("*").over(whole)).where(F.col("size") >= least)
    rank = F.struct("total", "source", "size", "shape")
    rows = rows.withColumn("best", F.max(rank).over(Window.partitionBy(key))).where(rank == F.col("best"))
    return rows.select(key, "ord", "title", "url", "price", "currency", "image_url", "source")


def meaningful_tables(parsed: DataFrame, key: str) -> DataFrame:
    """(key, table_no, headers, rows) of tables that hold data: headers of two columns, two rows, no calendar."""
    t = parsed.select(key, F.posexplode("tables").alias("table_no", "t")).select(key, "table_no", "t.headers", "t.rows")
    words = F.lower(F.array_join(F.flatten("rows"), " "))
    calendar = words.rlike(r"\b(sun|mon|tue|wed|thu|fri|sat)\b") & words.rlike(r"\b(next|prev|today)\b")
    return t.where((F.size("headers") >= 2) & (F.size("rows") >= 2) & ~calendar)


def table_records(parsed: DataFrame, key: str, least: int = 3) -> DataFrame:
    """(key, ord, record map) of the rows of the largest meaningful table of at least ``least`` rows."""
    size = F.size("rows") * F.size("headers")
    t = meaningful_tables(parsed, key).where(F.size("rows") >= least)
    best = t.groupBy(key).agg(F.max_by(F.struct("headers", "rows"), F.struct(size, -F.col("table_no"))).alias("t"))
    rows = best.select(key, "t.headers", F.posexplode("t.rows").alias("ord", "cells"))
    pairs = F.filter(F.arrays_zip(F.col("headers").alias("k"), F.col("cells").alias("v")), lambda p: p["k"].isNotNull() & (p["k"] != "") & (F.coalesce(p["v"], F.lit("")) != ""))
    return rows.select(key, "ord", F.map_from_entries(F.filter(pairs, lambda p, i: F.array_position(F.transform(pairs, lambda x: x["k"]), p["k"]) == i + 1)).alias("record"))


#: Columns of parsed pages that ``articles`` reads.
ARTICLE = ("title", "h1", "text", "meta")


def articles(parsed: DataFrame, key: str) -> DataFrame:
    """Title, author, date, tags, category, words and minutes of an article."""
    m = F.col("meta")
    value = lambda *names: F.coalesce(*(coerce.text_or_none(m[n]) for n in names))
    words = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    tags = coerce.string_list(F.split(F.coalesce(value("article:tag", "keywords"), F.lit("")), ","), 20, 80)
    return parsed.select(
        key, F.coalesce(coerce.text_or_none(F.col("h1")), coerce.text_or_none(F.col("title"))).alias("title"), value("author", "article:author").alias("author"),
        F.to_date(F.substring(value("article:published_time", "date"), 1, 10)).alias("published"), tags.alias("tags"), value("article:section").alias("category"), words.cast("bigint").alias("words"),
        F.greatest(F.ceil(words / 200), F.lit(1)).cast("bigint").alias("minutes"),
    )


def threads(parsed: DataFrame, key: str) -> DataFrame:
    """Title, replies and views of a forum page."""
    count = lambda what: price.first_int(F.nullif(F.regexp_extract(F.lower(F.col("text")), rf"([0-9][0-9,]*)\s+{what}", 1), F.lit("")))
    return parsed.select(key, F.coalesce(coerce.text_or_none(F.col("h1")), coerce.text_or_none(F.col("title"))).alias("title"), count("(?:replies|comments)").alias("replies"), count("views").alias("views"))


#: Fields of a product detail and the payload paths that may hold them: our table.
DETAIL = {
    "title": ("name", "['og:title']"), "brand": ("brand.name", "brand", "['product:brand']"), "price": ("offers.price", "offers[0].price", "['product:price:amount']"),
    "currency": ("offers.priceCurrency", "offers[0].priceCurrency", "['product:price:currency']"), "sku": ("sku",), "image_url": ("image", "image[0]", "['og:image']"), "description": ("description", "['og:description']"),
}


def detail_candidates(pages: DataFrame, key: str, html: str = "html", url: str = "url") -> DataFrame:
    """(key, field, value, tier, ord): every value that a page's sources offer for a field.

    Microdata names end in their place in the page; the first of a name counts.  Each page is parsed once.
    """
    rows = pages_html.structured_rows(pages, key, html, url, shown=True)
    some = lambda v: once(F.trim(F.regexp_replace(v, r"\s+", " ")), lambda x: F.nullif(x, F.lit("")))  # noqa: E731  as text_or_none, computed once
    item = lambda micro, names: some(F.get(F.map_values(F.map_filter(micro, lambda k, v: F.split_part(k, F.lit("."), F.lit(-2)).isin(*names))), F.lit(0)))
    at = lambda paths: F.coalesce(*(some(F.get_json_object("payload", f"$.{p}")) for p in paths))
    plain = {"title": ("name",), "image_url": ("image",), "currency": ("priceCurrency",)}
    offer = lambda f, v: F.struct(f.alias("field"), v.alias("value"))
    marked = once(F.from_json("payload", "map<string,string>"), lambda m: F.array(*(offer(F.lit(f), item(m, plain.get(f, (f,)))) for f in DETAIL)))
    label = F.create_map(*(F.lit(x) for f in ("brand", "sku") for x in (f, f)), F.lit("item"), F.lit("title"), F.lit("price"), F.lit("price"))
    of = (
        F.when(F.col("source") == "table", F.array(offer(F.element_at(label, F.lower(at(("label",)))), at(("value",)))))
        .when(F.col("source") == "dom", F.array(offer(F.lit("title"), at(("h1",)))))
        .when(F.col("source") == "microdata", marked)
        .otherwise(F.array(*(offer(F.lit(f), at(paths)) for f, paths in DETAIL.items())))
    )
    found = rows.select(key, F.col("source").alias("tier"), "ord", F.explode(of).alias("p"))
    return found.select(key, "p.field", "p.value", "tier", "ord").where("field is not null and value is not null")


def detail_records(candidates: DataFrame, key: str) -> DataFrame:
    """One record a page: each field from its best tier, with the tier it came from.

    A title that names nothing gives way to the next.
    """
    tier = F.array_position(F.array(*(F.lit(t) for t in TIERS)), F.col("tier"))
    rank = F.struct((F.col("field") == "title") & coerce.title_noise(F.col("value")), tier, "ord", "value")
    best = candidates.groupBy(key, "field").agg(F.min_by(F.struct("value", "tier"), rank).alias("b"))
    entries = F.collect_list(F.struct("field", "b.value", "b.tier"))  # at most a row a field
    got = best.groupBy(key).agg(F.array_sort(entries).alias("e"))
    as_map = lambda n: F.map_from_entries(F.transform("e", lambda x: F.struct(x["field"], x[n])))
    fields, sources = as_map("value"), as_map("tier")
    return got.select(key, *(fields[f].alias(f) for f in DETAIL), sources.alias("sources"))


def sections(parsed: DataFrame, key: str) -> DataFrame:
    """(key, heading, body): the text between each heading and the next, of headings below the first level.

    A heading is found in the text as a line of its own; of equal lines the one after the last heading found.
    """
    heads = F.transform("headings", lambda h: h["text"])
    lines = F.split("text", "\n")
    numbered = F.transform(lines, lambda x, i: F.struct(i.alias("i"), x.alias("x")))
    starts = F.filter(numbered, lambda n: F.array_contains(heads, n["x"]))
    upto = lambda j: F.coalesce(F.get(starts, j + 1)["i"], F.size(lines))
    body = F.transform(starts, lambda s, j: F.struct(s["x"].alias("heading"), F.array_join(F.slice(lines, s["i"] + 2, F.greatest(upto(j) - s["i"] - 1, F.lit(0))), "\n").alias("body")))
    return parsed.select(key, F.inline(body)).where("body <> ''")


def own_links(rows: Column, fields: list[str], page: Column) -> Column:
    """The first link field of each row, distinct, on the page's own site."""
    first = F.transform(rows, lambda r: F.coalesce(*(F.when(F.trim(r[f]) != "", F.trim(r[f])) for f in fields)))
    return F.array_distinct(F.filter(first, lambda x: x.isNotNull() & u.same_site(page, x)))
