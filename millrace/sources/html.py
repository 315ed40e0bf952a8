"""Page extraction: whole pages in, rows out.

One pass of the standard parser over a page gives its title, headings, links, text, meta
tags, scripts, tables, label pairs and microdata.  ``parse_pages`` runs it in Arrow batches;
the functions below select from its columns.  A task's Python is no plan that Spark could prune:
a query names the columns that it reads (``only``), and no others are made.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .json_safe import dumps, loads

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCK = frozenset("address article aside blockquote br dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul".split())
HIDDEN = frozenset("script style noscript template".split())
#: Elements inside which tags may not be tags, and tags without attributes.
RAW = frozenset("script style textarea title iframe noembed noframes noscript xmp plaintext".split())
_OPENS, _CLOSES = re.compile("<([a-zA-Z][a-zA-Z0-9]*)>").match, re.compile("</([a-zA-Z][a-zA-Z0-9]*)>").match

PARSED = (
    "title string, h1 string, lang string, text string, headings array<struct<level:int,text:string>>, links array<struct<href:string,text:string>>, "
    "images array<struct<src:string,alt:string>>, meta map<string,string>, json_ld array<string>, embedded array<string>, "
    "tables array<struct<headers:array<string>,rows:array<array<string>>>>, pairs array<struct<label:string,value:string>>, items array<struct<type:string,name:string,value:string>>"
)


def slices(batch: pa.RecordBatch, size: int = 64) -> Iterator[pa.RecordBatch]:
    """Some pages at a time: what is made of a page is larger than the page, so a whole batch of them is never held."""
    return (batch.slice(at, size) for at in range(0, batch.num_rows, size))


class Reader(HTMLParser):
    """The standard parser with a short way for tags without attributes, which are most of a page's tags.

    Elements whose content is read otherwise go the long way, as all does while such an element is open.
    """

    def updatepos(self, i, j):
        return j  # nobody asks for line numbers

    def parse_starttag(self, i):
        m = _OPENS(self.rawdata, i)
        tag = m and m[1].lower()
        if not m or tag in RAW:
            return super().parse_starttag(i)
        self.handle_starttag(tag, [])
        return m.end()

    def parse_endtag(self, i):
        m = None if self.cdata_elem else _CLOSES(self.rawdata, i)
        if not m:
            return super().parse_endtag(i)
        self.handle_endtag(m[1].lower())
        return m.end()

    def parse_marked_section(self, i, report=1):
        try:
            return super().parse_marked_section(i, report)
        except AssertionError:  # a kind that the parser refuses: a comment up to its ">", as in HTML, and the page goes on
            return self.parse_bogus_comment(i, report)


class Page(Reader):
    """Collects what the columns of PARSED need; unclosed and stray tags do no harm."""

    def __init__(self, html: str, base: str = ""):
        super().__init__(convert_charrefs=True)
        self.base = base
        self.title = self.h1 = self.lang = ""
        self.parts, self.headings, self.links, self.images, self.meta = [], [], [], [], {}
        self.json_ld, self.embedded, self.tables, self.pairs, self.items = [], [], [], [], []
        self.labels: set[str] = set()
        self.open, self.sinks, self.script, self.table, self.term, self.scopes = [], [], None, [], None, []
        self.feed(html)
        self.close()
        while self.sinks:  # what the page left open
            self._end(self.sinks[-1][0])
        while self.table:
            self._finish_table(self.table.pop())

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs} if attrs else {}
        if tag == "html":
            self.lang = a.get("lang", "")
        if tag in BLOCK:
            self.parts.append("\n")
        if tag == "meta" and (a.get("property") or a.get("name")):
            self.meta.setdefault((a.get("property") or a["name"]).lower(), a.get("content", ""))
        if tag == "img" and a.get("src"):
            self.images.append({"src": urljoin(self.base, a["src"]), "alt": a.get("alt", "")})
        if tag == "script":
            self.script = [a.get("type", ""), []]
        if "itemscope" in a:
            self.scopes.append((tag, a.get("itemtype", "").rstrip("/").split("/")[-1]))
        if "itemprop" in a:
            kind = self.scopes[-1][1] if self.scopes else ""
            value = next((a[k] for k in ("content", "href", "src", "datetime") if a.get(k)), None)
            if value is not None:
                self.items.append({"type": kind, "name": a["itemprop"], "value": value})
            elif tag not in VOID:
                self.sinks.append((tag, "item", (kind, a["itemprop"]), []))
        if tag in ("title", "h1", "h2", "h3", "h4", "h5", "h6", "a", "td", "th", "dt", "dd"):
            if tag in ("td", "th", "dt", "dd"):
                self._end_cells()
            if tag == "a":  # links don't nest: a new one closes the last
                self._end("a")
            self.sinks.append((tag, tag, a.get("href", ""), []))
        if tag == "table":
            self.table.append([])
        if tag == "tr" and self.table:
            self._end_cells()
            self.table[-1].append([])
        if tag not in VOID:
            self.open.append(tag)

    def handle_endtag(self, tag):
        if tag in BLOCK:
            self.parts.append("\n")
        if tag == "script" and self.script is not None:
            kind, body = self.script[0], "".join(self.script[1]).strip()
            if kind == "application/ld+json":
                self.json_ld.append(body)
            elif kind in ("application/json", "") and (body[:1] in "{[" or "={" in body.replace(" ", "")) and body:
                self.embedded.append(body)
            self.script = None
        if tag in ("tr", "table"):
            self._end_cells()
        if tag == "table" and self.table:
            self._finish_table(self.table.pop())
        if self.scopes and self.scopes[-1][0] == tag and self.open.count(tag) <= 1:
            self.scopes.pop()
        if tag in self.open:
            while self.open and self.open.pop() != tag:
                pass
        self._end(tag)

    def handle_data(self, data):
        if self.script is not None:
            self.script[1].append(data)
        elif not HIDDEN.intersection(self.open[-3:]):
            if "title" not in self.open:
                self.parts.append(data)
            for s in self.sinks:
                s[3].append(data)

    def _end_cells(self):
        if not self.sinks:
            return
        for tag in ("td", "th", "dd", "dt"):
            if any(s[0] == tag for s in self.sinks):
                self._end(tag)

    def _end(self, tag):
        for k in range(len(self.sinks) - 1, -1, -1):
            if self.sinks[k][0] == tag:
                _, kind, extra, data = self.sinks.pop(k)
                text = " ".join("".join(data).split())
                if kind == "title":
                    self.title = self.title or text
                elif kind == "a":
                    if extra:
                        self.links.append({"href": urljoin(self.base, extra), "text": text})
                elif kind in ("td", "th"):
                    if self.table and self.table[-1]:
                        self.table[-1][-1].append((kind, text))
                elif kind == "dt":
                    self.term = text
                elif kind == "dd":
                    self._pair(self.term, text)
                elif kind == "item":
                    self.items.append({"type": extra[0], "name": extra[1], "value": text})
                else:
                    self.h1 = self.h1 or (text if kind == "h1" else "")
                    self.headings.append({"level": int(kind[1]), "text": text})
                return

    def _pair(self, label, value):
        if label and value and len(label) <= 40 and len(value) <= 250:
            label = label.rstrip(":").strip()
            if label.lower() not in self.labels:
                self.labels.add(label.lower())
                self.pairs.append({"label": label, "value": value})

    def _finish_table(self, rows):
        rows = [r for r in rows if r]
        if not rows:
            return
        if all(len(r) == 2 and r[0][0] == "th" and r[1][0] == "td" for r in rows):
            for r in rows:
                self._pair(r[0][1], r[1][1])
        heads = [t for k, t in rows[0]] if all(k == "th" for k, _ in rows[0]) else []
        self.tables.append({"headers": heads, "rows": [[t for _, t in r] for r in (rows[1:] if heads else rows)]})

    @property
    def text(self) -> str:
        lines = (" ".join(x.split()) for x in "".join(self.parts).split("\n"))
        return "\n".join(x for x in lines if x)

    def row(self, names: list[str]) -> dict:
        """Some of the columns of PARSED."""
        return {x: list(self.meta.items()) if x == "meta" else getattr(self, x) for x in names}


def only_entities(html: Column, *names: str) -> Column:
    """A page in which only the named references, closed by ";", are read as such; other ampersands stand for themselves.

    The parser reads "&amp" without its end, and all that HTML names, as browsers do.  Scripts are changed too.
    """
    return F.regexp_replace(html, f"&(?!(?:{'|'.join(names)});)", "&amp;")


def parse_pages(pages: DataFrame, key: str, html: str = "html", url: str | None = "url", only: tuple[str, ...] = ()) -> DataFrame:
    """(key, columns of PARSED, those of ``only`` if any are named), one row a page; null pages are empty pages."""
    from pyspark.sql.pandas.types import to_arrow_schema

    base = F.col(url) if url else F.lit("")
    picked = pages.select(key, F.col(html).cast("string").alias("_html"), base.alias("_base"))
    every = picked.sparkSession.createDataFrame([], PARSED)
    out = every.select(*only).schema if only else every.schema
    arrow = to_arrow_schema(out)

    def run(batches):
        for batch in (some for whole in batches for some in slices(whole)):
            rows = [Page(h or "", b or "").row(arrow.names) for h, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            parsed = pa.RecordBatch.from_pylist(rows, schema=arrow)
            yield pa.RecordBatch.from_arrays([batch.column(0), *parsed.columns], [key, *arrow.names])

    return picked.mapInArrow(run, T.StructType([T.StructField(key, picked.schema[0].dataType), *out.fields]))


def content(parsed: DataFrame, key: str) -> DataFrame:
    """title, content, summary, words, minutes, image, language of each page."""
    from millrace.functions.text import reading_minutes, word_count

    words = word_count(F.col("text")).cast("bigint")
    return parsed.select(
        key, F.coalesce(F.nullif("h1", F.lit("")), "title").alias("title"), F.col("text").alias("content"), F.coalesce(F.col("meta")["description"], F.split_part("text", F.lit("\n"), F.lit(1))).alias("summary"),
        words.alias("words"), reading_minutes(words).cast("bigint").alias("minutes"), F.coalesce(F.col("meta")["og:image"], F.get("images", F.lit(0))["src"]).alias("image"), "lang",
    )


def link_rows(parsed: DataFrame, key: str) -> DataFrame:
    return parsed.select(key, F.posexplode("links").alias("ord", "l")).select(key, "ord", "l.href", "l.text")


def table_rows(parsed: DataFrame, key: str) -> DataFrame:
    """A row a table row: maps of header to cell; tables without headers number them."""
    rows = parsed.select(key, F.posexplode("tables").alias("table_no", "t")).select(key, "table_no", "t.headers", F.posexplode("t.rows").alias("row_no", "cells"))
    names = F.transform("cells", lambda c, i: F.coalesce(F.nullif(F.get("headers", i), F.lit("")), F.concat(F.lit("col_"), i + 1)))
    pairs = F.zip_with(names, F.col("cells"), lambda n, c: F.struct(n.alias("n"), c.alias("c")))
    first = F.filter(pairs, lambda p, i: F.array_position(names, p["n"]) == i + 1)
    return rows.select(key, "table_no", "row_no", F.map_from_entries(first).alias("row"))


def ld_nodes(json_ld: list[str]) -> list[dict]:
    """Nodes of JSON-LD scripts: graphs and lists flattened, @id references resolved once,
    products first."""
    nodes = []
    for text in json_ld:
        data = loads(text)
        for x in data if isinstance(data, list) else [data]:
            if isinstance(x, dict):
                nodes += [y for y in x.get("@graph", [x]) if isinstance(y, dict)] if isinstance(x.get("@graph", [x]), list) else [x]
    by_id = {n["@id"]: n for n in nodes if isinstance(n.get("@id"), str)}

    def resolve(v, seen):
        if isinstance(v, list):
            return [resolve(x, seen) for x in v]
        if not isinstance(v, dict):
            return v
        at = v.get("@id") if isinstance(v.get("@id"), str) else None
        if set(v) == {"@id"} and at in by_id and at not in seen:
            return resolve(by_id[at], seen | {at})
        return {k: resolve(x, seen | ({at} if at else set())) for k, x in v.items()}

    kind = lambda n: next((t for t in (n["@type"] if isinstance(n.get("@type"), list) else [n.get("@type")]) if isinstance(t, str)), "")
    order = {"Product": 0, "ProductGroup": 1, "JobPosting": 2, "Article": 3, "NewsArticle": 3}
    return sorted((resolve(n, frozenset()) for n in nodes), key=lambda n: (order.get(kind(n), 9), str(n.get("@id", ""))))


def _payloads(row: dict) -> list[tuple[str, int, str]]:
    """(source, ord, JSON) of one page's structured data."""
    dump = lambda x: dumps(x, compact=False)
    out = [("json_ld", i, dump(n)) for i, n in enumerate(ld_nodes(row["json_ld"]))]
    named = {".".join(filter(None, (x["type"], x["name"], str(i)))): x["value"] for i, x in enumerate(row["items"])}
    graph = {k: v for k, v in row["meta"] if k.startswith(("og:", "product:"))}
    return out + [(name, 0, dump(x)) for name, x in (("microdata", named), ("opengraph", graph)) if x]


def _shown(row: dict) -> list[tuple[str, int, str]]:
    """(source, ord, JSON) of what one page shows: its labelled values and its first heading."""
    pairs = [("table", i, dumps({"label": p["label"], "value": p["value"]}, compact=False)) for i, p in enumerate(row["pairs"])]
    return pairs + [("dom", 0, dumps({"h1": row["h1"]}, compact=False))] * bool(row["h1"])


def structured_rows(pages: DataFrame, key: str, html: str = "html", url: str | None = "url", shown: bool = False) -> DataFrame:
    """(key, source, ord, payload): JSON-LD nodes, microdata and Open Graph, in that order; where
    ``shown``, labelled values and the heading (sources table and dom) after them.

    Each page is parsed once and gives its rows.
    """
    kind = pages.select(key).schema[0].dataType.simpleString()
    picked = pages.select(key, F.col(html).cast("string").alias("_html"), (F.col(url) if url else F.lit("")).alias("_base"))
    names = ["json_ld", "items", "meta", *(["pairs", "h1"] if shown else [])]

    def found(page: str, base: str) -> list[tuple[str, int, str]]:
        row = Page(page, base).row(names)
        return _payloads(row) + (_shown(row) if shown else [])

    def run(batches):
        for batch in (some for whole in batches for some in slices(whole)):
            of = [found(h or "", b or "") for h, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            owners = pa.array([k for k, rows in enumerate(of) for _ in rows], pa.int32())
            columns = list(zip(*(x for rows in of for x in rows), strict=True)) or [()] * 3
            made = [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(owners), *made], [key, "source", "ord", "payload"])

    return picked.mapInArrow(run, f"{key} {kind}, source string, ord int, payload string")
