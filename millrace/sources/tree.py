"""Pages as trees of flat arrays: one lenient parse a page, kept as a table for all that walks pages.

A node has its parent, the last node of its subtree (nodes are numbered in page order, so
``node < x <= last`` says that x lies inside), its place among its siblings and among those of
its tag, its attributes and its span of the page's text.  ``node_rows`` turns trees into rows.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .html import BLOCK, HIDDEN, VOID, Reader, slices

#: Stands in the text between the texts of inline elements; a block's edge is a line break.
SEAM = "\x1f"
#: What a start tag ends if it is still open, and where the search for it stops.
_CELLS, _TABLE = {"td", "th"}, {"table"}
_ROWS = {"tr", "caption", "colgroup", *_CELLS}
_PARTS = ("thead", "tbody", "tfoot")
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": (_ROWS, _TABLE), "td": (_CELLS, {"tr", "table"}), "th": (_CELLS, {"tr", "table"}),
    **{t: ({*_PARTS, *_ROWS}, _TABLE) for t in _PARTS}, "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}), "a": ({"a"}, {"td", "th", "table"}), "body": ({"head"}, set()),
}
#: A paragraph ends where a block begins, but not across these; a line break is none.
_BLOCKS, _FENCE = BLOCK - {"br"}, {"table", "td", "th", "caption", "button", "object", "template"}

NODE = "parent:int,last:int,nth:int,of_type:int,tag:string,attrs:map<string,string>,start:int,end:int"
TREE = f"text string, nodes array<struct<{NODE}>>, scripts array<struct<node:int,body:string>>"


class Tree(Reader):
    """Builds the arrays; unclosed, stray and misnested tags give the nearest tree."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.nodes: list[dict] = []
        self.parts: list[str] = []
        self.scripts: list[dict] = []
        self.size, self.open, self.quiet = 0, [], 0
        self.kids: list[dict[str, int]] = [{}]  # tags of the children seen, for the page and each open node
        self.feed(html)
        self.close()
        self._pop(0)

    def _say(self, text: str) -> None:
        self.parts.append(text)
        self.size += len(text)

    def _pop(self, upto: int) -> None:
        while len(self.open) > upto:
            node = self.nodes[self.open.pop()]
            self.kids.pop()
            node["last"], node["end"] = len(self.nodes) - 1, self.size
            self.quiet -= node["tag"] in HIDDEN
            self._say("\n" if node["tag"] in BLOCK else SEAM)

    def _end(self, tags, fence) -> None:
        """Closes the outermost open element of ``tags`` before the fence, and all in it."""
        at = None
        for k in range(len(self.open) - 1, -1, -1):
            tag = self.nodes[self.open[k]]["tag"]
            if tag in tags:
                at = k
            elif tag in fence:
                break
        if at is not None:
            self._pop(at)

    def handle_starttag(self, tag, attrs):
        if tag in _BLOCKS:
            self._end({"p"}, _FENCE)
        if tag in IMPLIED:
            self._end(*IMPLIED[tag])
        kids = self.kids[-1]
        kids[tag], kids[""] = kids.get(tag, 0) + 1, kids.get("", 0) + 1
        self._say("\n" if tag in BLOCK else SEAM)
        found: dict[str, str] = {}
        for k, v in attrs:
            found.setdefault(k, v or "")
        self.nodes.append({"parent": self.open[-1] if self.open else -1, "last": len(self.nodes), "nth": kids[""], "of_type": kids[tag], "tag": tag, "attrs": list(found.items()), "start": self.size, "end": self.size})
        if tag not in VOID:
            self.open.append(len(self.nodes) - 1)
            self.kids.append({})
            self.quiet += tag in HIDDEN

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        fence = set() if tag in ("html", "body", "table") else {"table"} if tag in ("tr", *_CELLS, *_PARTS) else {"table", *_CELLS}
        for k in range(len(self.open) - 1, -1, -1):
            own = self.nodes[self.open[k]]["tag"]
            if own == tag:
                self._pop(k)
                return
            if own in fence:
                return

    def handle_data(self, data):
        if self.quiet:
            self.scripts.append({"node": self.open[-1], "body": data})
        else:
            self._say(data)

    def row(self) -> dict:
        return {"text": "".join(self.parts), "nodes": self.nodes, "scripts": self.scripts}


def page_trees(pages: DataFrame, key: str, html: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """(key, kept columns, text, nodes, scripts), one row a page; null pages are empty.

    A page that nothing else parses again: write the result and read it wherever a tree is needed.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    held = [key, *(c for c in keep if c != key)]
    picked = pages.select(*held, F.coalesce(F.col(html).cast("string"), F.lit("")).alias("_page"))
    arrow = to_arrow_schema(picked.sparkSession.createDataFrame([], TREE).schema)
    schema = picked.select(*held, *(F.lit(None).cast(f.dataType).alias(f.name) for f in picked.sparkSession.createDataFrame([], TREE).schema)).schema

    def run(batches):
        for batch in batches:
            for some in slices(batch):
                trees = pa.RecordBatch.from_pylist([Tree(p.as_py()).row() for p in some.column("_page")], schema=arrow)
                yield pa.RecordBatch.from_arrays([*(some.column(c) for c in held), *trees.columns], [*held, *arrow.names])

    return picked.mapInArrow(run, schema)


def spaced(text: Column) -> Column:
    """A node's text with a space between the texts inside it, white space joined."""
    return F.trim(F.regexp_replace(text, rf"[\s{SEAM}\xA0]+", " "))


def joined(text: Column) -> Column:
    """A node's text as it stands, without seams, white space joined."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, SEAM, ""), r"[\s\xA0]+", " "))


def node_rows(trees: DataFrame, key: str, *keep: str, tags: tuple[str, ...] = ()) -> DataFrame:
    """(key, kept columns, node, its fields, value), a row a node; of some tags only, if named."""
    numbered = F.transform("nodes", lambda n, i: n.withField("node", i.cast("int")))
    wanted = F.filter(numbered, lambda n: n["tag"].isin(*tags)) if tags else numbered
    rows = trees.select(key, *keep, "text", F.explode(wanted).alias("n"))
    return rows.select(key, *keep, "n.*", spaced(F.substring("text", F.col("n.start") + 1, F.col("n.end") - F.col("n.start"))).alias("value"))
