"""Nested microdata, posts of threads and bodies of articles, over page trees."""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .html import slices
from .json_safe import dumps, within
from .selectors import Nodes
from .tree import SEAM, Tree, spaced

#: Where an element's value stands (fixed values).
VALUES = {
    "meta": "content", "a": "href", "area": "href", "link": "href", "img": "src", "audio": "src", "video": "src", "source": "src", "embed": "src", "iframe": "src", "track": "src", "object": "data", "data": "value", "meter": "value", "time": "datetime",
}
#: Classes of posts, of who wrote them, and of article bodies: short lists of our own.
POST = r"(^|\s)(post|comment|reply|message|forum-post|thread-post)(\s|$)"
AUTHOR = r"(^|[\s_-])(author|username|user-name|byline|poster)($|[\s_-])"
BODY = r"(^|\s)(article-body|article-content|entry-content|post-content|story-body)(\s|$)"
POST_BODY = r"(^|\s)(body|content|text|post-body|comment-body|message-body)(\s|$)"


def items_of(n: Nodes) -> list[dict]:
    """The top items of a page, items within items, properties of one name as a list.

    A property belongs to the nearest item around it; one outside all items is none.  References
    between items (itemref) are not followed.
    """
    scope: list[int] = []
    made: dict[int, dict] = {}
    top = []
    for i, (tag, a, p) in enumerate(zip(n.tag, n.attrs, n.parent, strict=True)):
        holder = scope[p] if p >= 0 else -1
        if "itemscope" in a:
            made[i] = {"@type": a.get("itemtype", "").rstrip("/").split("/")[-1]}
        scope.append(i if i in made else holder)
        names = a.get("itemprop", "").split()
        if i in made and (not names or holder < 0):
            top.append(made[i])
        elif names and holder >= 0:
            text = " ".join(n.within(i).replace(SEAM, " ").split())
            value = made.get(i) or a.get("content") or a.get(VALUES.get(tag, ""), "") or text
            for name in names:
                had = made[holder].get(name)
                made[holder][name] = value if had is None else [*had, value] if isinstance(had, list) else [had, value]
    return top


_FIELDS = ("parent", "last", "nth", "of_type", "tag", "attrs", "start", "end")


def _item_rows(keys: pa.Array, key: str, pages: Iterable[Nodes]) -> pa.RecordBatch:
    owners, rows = [], []
    for k, nodes in enumerate(pages):
        got = [x for x in items_of(nodes) if within(x)]
        rows += [(i, x["@type"], dumps(x)) for i, x in enumerate(got)]
        owners += [k] * len(got)
    columns = zip(*rows, strict=True) if rows else [()] * 3
    made = [pa.array(list(c), t) for c, t in zip(columns, (pa.int32(), pa.string(), pa.string()), strict=True)]
    return pa.RecordBatch.from_arrays([keys.take(pa.array(owners, pa.int32())), *made], [key, "ord", "type", "payload"])


def _item_schema(df: DataFrame, key: str) -> str:
    return f"{key} {df.schema[key].dataType.simpleString()}, ord int, type string, payload string"


def microdata(trees: DataFrame, key: str) -> DataFrame:
    """(key, ord, type, payload): the top items of each page as JSON.  Items nested too deep to write are left out."""

    def nodes(text, tree) -> Nodes:
        fields = [tree.values.field(x).to_pylist() for x in _FIELDS] if tree.is_valid else [[] for _ in _FIELDS]
        return Nodes(text.as_py() or "", *fields)

    def run(batches):
        for batch in batches:
            yield _item_rows(batch.column(key), key, map(nodes, batch.column("text"), batch.column("nodes")))

    return trees.select(key, "text", "nodes").mapInArrow(run, _item_schema(trees, key))


def page_microdata(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """``microdata`` of pages whose trees nothing else needs: each is walked where it is parsed."""

    def nodes(page) -> Nodes:
        row = Tree(page.as_py() or "").row()
        return Nodes(row["text"], *([x[f] for x in row["nodes"]] for f in _FIELDS))

    def run(batches):
        for batch in (some for whole in batches for some in slices(whole)):
            yield _item_rows(batch.column(0), key, map(nodes, batch.column(1)))

    return pages.select(key, F.col(html).cast("string").alias("_html")).mapInArrow(run, _item_schema(pages, key))


def _attr(n: Column, k: str) -> Column:
    return F.coalesce(F.element_at(n["attrs"], F.lit(k)), F.lit(""))


def _text(n: Column) -> Column:
    return F.nullif(spaced(F.substring("text", n["start"] + 1, n["end"] - n["start"])), F.lit(""))


def _first(nodes: str, inside: Column) -> Column:
    """The first of some nodes strictly inside another, as a struct or null."""
    return F.get(F.filter(nodes, lambda x: (x["node"] > inside["node"]) & (x["node"] <= inside["last"])), 0)


def posts(trees: DataFrame, key: str) -> DataFrame:
    """(key, ord, author, published, body): the posts of a thread in page order.

    A post is an element classed or marked up as one that lies in no other post; its author, time and
    body are the first such elements inside it, the body else its whole text.  Posts without text go.
    """
    numbered = trees.select(key, "text", F.transform("nodes", lambda n, i: n.withField("node", i.cast("int"))).alias("nodes"))
    prop = lambda n: F.lower(_attr(n, "itemprop"))
    post = lambda n: F.lower(_attr(n, "class")).rlike(POST) | prop(n).isin("comment", "suggestedanswer", "acceptedanswer")
    work = numbered.select(
        key, "text", F.filter("nodes", post).alias("posts"), F.filter("nodes", lambda n: F.lower(_attr(n, "class")).rlike(AUTHOR) | (prop(n) == "author") | (F.lower(_attr(n, "rel")) == "author")).alias("authors"),
        F.filter("nodes", lambda n: (n["tag"] == "time") | prop(n).isin("datepublished", "datecreated")).alias("times"), F.filter("nodes", lambda n: F.lower(_attr(n, "class")).rlike(POST_BODY) | (prop(n) == "text")).alias("bodies"),
    )
    outer = F.aggregate("posts", F.struct(F.lit(-1).alias("last"), F.array().cast("array<int>").alias("kept")), lambda s, p: F.when(p["node"] > s["last"], F.struct(p["last"].alias("last"), F.concat(s["kept"], F.array(p["node"])).alias("kept"))).otherwise(s))["kept"]
    work = work.withColumn("outer", outer)
    when = lambda p: F.coalesce(F.nullif(_attr(_first("times", p), "datetime"), F.lit("")), F.nullif(_attr(_first("times", p), "content"), F.lit("")), _text(_first("times", p)))
    made = F.transform(
        F.filter("posts", lambda p: F.array_contains("outer", p["node"])),
        lambda p: F.struct(_text(_first("authors", p)).alias("author"), when(p).alias("published"), F.coalesce(_text(_first("bodies", p)), _text(p)).alias("body")),
    )
    return work.select(key, F.posexplode(F.filter(made, lambda m: m["body"].isNotNull())).alias("ord", "p")).select(key, "ord", "p.author", "p.published", "p.body")


def article_bodies(trees: DataFrame, key: str) -> DataFrame:
    """(key, author, body, paragraphs): the longest text among a page's article, main and body elements.

    Paragraphs begin at those inside it and hold what follows up to the next, else they are its lines; the author is the page's first meta tag that names one, else the first
    byline with text, without "By".  A page without text in such an element gives its whole text, and no paragraphs.
    """
    numbered = trees.select(key, "text", F.transform("nodes", lambda n, i: n.withField("node", i.cast("int"))).alias("nodes"))
    part = lambda n: n["tag"].isin("article", "main") | (F.lower(_attr(n, "itemprop")) == "articlebody") | F.lower(_attr(n, "class")).rlike(BODY)
    by = lambda n: F.lower(_attr(n, "class")).rlike(AUTHOR) | (F.lower(_attr(n, "rel")) == "author") | (F.lower(_attr(n, "itemprop")) == "author")
    names = lambda n: (n["tag"] == "meta") & F.lower(F.concat(_attr(n, "name"), _attr(n, "property"))).isin("author", "article:author")
    content = lambda n: F.nullif(spaced(_attr(n, "content")), F.lit(""))
    first = lambda which, value: F.get(F.array_compact(F.transform(F.filter("nodes", which), value)), 0)
    author = F.coalesce(first(names, content), F.regexp_replace(first(by, lambda n: F.coalesce(_text(n), content(n))), r"(?i)^by\s+", ""))
    said = F.transform(F.filter("nodes", part), lambda n: F.struct(n["node"].alias("node"), n["last"].alias("last"), n["start"].alias("start"), n["end"].alias("end"), _text(n).alias("body")))
    sized = F.transform(said, lambda n: F.struct(F.length(n["body"]).alias("size"), (-n["node"]).alias("place"), n.alias("n")))
    work = numbered.select(key, "text", "nodes", F.array_max(F.filter(sized, lambda n: n["size"].isNotNull()))["n"].alias("best"), author.alias("author"))
    inside = F.filter("nodes", lambda n: (n["tag"] == "p") & (n["node"] > F.col("best.node")) & (n["node"] <= F.col("best.last")))
    work = work.withColumn("starts", F.transform(inside, lambda n: n["start"]))
    reach = lambda at, i: F.struct(at.alias("start"), F.coalesce(F.get("starts", i + 1), F.col("best.end")).alias("end"))
    work = work.withColumn("paragraphs", F.array_compact(F.transform(F.transform("starts", reach), _text)))
    lines = F.filter(F.transform(F.split(F.substring("text", F.col("best.start") + 1, F.col("best.end") - F.col("best.start")), "\n"), spaced), lambda x: x != "")
    body = F.coalesce(F.col("best.body"), F.nullif(spaced(F.col("text")), F.lit("")))
    return work.select(key, "author", body.alias("body"), F.when((F.size("paragraphs") > 0) | F.col("best").isNull(), F.col("paragraphs")).otherwise(lines).alias("paragraphs"))
