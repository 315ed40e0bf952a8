"""Faults of the fourth round."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from millrace.plans import catalog
from millrace.sources import bodies, html, tree


def rows_of(spark, name, made):
    """The rows of a query and of its SQL over tables in a folder; one thread, so that the first of tied rows is the first stored."""
    con = duckdb.connect()
    con.execute("set threads = 1")
    for t in made.iterdir():
        con.execute(f"create view {t.stem} as select * from '{t}/*.parquet'")
    got, cur = catalog.QUERIES[name](spark, str(made)), con.execute(catalog.ORACLE[name])
    head = [x[0] for x in cur.description]
    return sorted(repr([r[c] for c in head]) for r in got.collect()), sorted(repr(list(r)) for r in cur.fetchall())


LINE = pa.schema([("l_orderkey", pa.int64()), ("l_partkey", pa.int64()), ("l_suppkey", pa.int64()), ("l_linenumber", pa.int32()), ("l_quantity", pa.float64()), ("l_extendedprice", pa.float64()), ("l_discount", pa.float64()), ("l_tax", pa.float64()), ("l_returnflag", pa.string()), ("l_linestatus", pa.string()), ("l_shipdate", pa.timestamp("us"))])


def lines(folder, *files):
    """A table of line items in files of their own: (order, part, line, quantity, flag)."""
    at = folder / "lineitem.parquet"
    at.mkdir()
    for k, rows in enumerate(files):
        whole = [dict(zip(("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_returnflag"), r, strict=True)) for r in rows]
        pq.write_table(pa.Table.from_pylist(whole, schema=LINE), at / f"part-{k}.parquet")


def test_tied_lines(spark, tmp_path):
    """of lines with one number in an order the first stored stands; the second file is larger and read first."""
    tied = lambda q: [(o, part, 1, q * o, "A") for part in range(30) for o in (2, 3)]
    lines(tmp_path, tied(1.0), tied(10.0) + [(1, n, 1, float(n), "N") for n in range(20_000)] + tied(100.0))
    got, wanted = rows_of(spark, "snapshot_diff", tmp_path)
    assert got == wanted and sorted(got) == sorted(repr([part, "field_changed", "price", "$2", "3 USD"]) for part in range(30))


@pytest.mark.parametrize(
    "rows, count",
    [
        ([(2, 1, None, 1.0, "A"), (2, 1, 5, 2.0, "A"), (3, 1, None, 4.0, "A"), (3, 1, 5, 2.0, "R")], 1),
        ([(2, None, 1, 1.0, "A"), (3, None, 1, 1.0, "A"), (2, 1, 1, 1.0, "A")], 5),
        ([(2, 1, 1, 1e15, "A"), (3, 1, 1, 1e15, "A"), (2, 2, 1, 3e15, "A"), (3, 2, 1, 1e15, "A")], 1),
        ([(2, 1, 1, 1.0, ""), (3, 1, 1, 1.0, None), (2, 2, 1, 1.0, " "), (3, 2, 1, 1.0, ""), (2, 3, 1, 1.0, "a  b"), (3, 3, 1, 1.0, "A B"), (2, 4, 1, None, None), (3, 4, 1, None, None)], 3),
    ],
    ids=["lines without number", "lines without part", "large quantities", "empty flags"],
)
def test_odd_lines(spark, tmp_path, rows, count):
    """odd lines are compared as the SQL compares them."""
    lines(tmp_path, rows)
    got, wanted = rows_of(spark, "snapshot_diff", tmp_path)
    assert got == wanted and len(got) == count


PAGES = [
    "<nav>n</nav><article><h1>Head</h1><div>first <b>line</b></div><ul><li>one<li>two</ul>tail &amp; end</article><footer>f</footer>",
    "<article><p>a</p><![foo bar]><p>b</p></article>",
    "<nav>n</nav><article><p>short</p></article><article class=big><p class=lead>the longer one<p>of two</article>",
    "<nav><b>n</b></nav><script>var x = '<article>no</article>';</script><!-- <main>no</main> --><p>no <i>article</i> at all</p>",
    "<main>some <article>small</article> and more<br>of it</main>",
    "<nav>n</nav><article> </article><p>outside</p>",
    "<article><p> </p>only a line</article>",
    "<article>before<p>a</p>loose<ul><li>item</ul><div><p>b</div><h2>c</h2></article>",
    "",
    None,
    None,
]


def test_whole_articles(spark, tmp_path):
    """an article without paragraphs gives its lines, the longest of several is taken, a page without one is read whole, as is what follows a refused declaration."""
    (tmp_path / "pages.parquet").mkdir()
    pq.write_table(pa.table({"page_id": pa.array(range(len(PAGES)), pa.int64()), "url": ["u"] * len(PAGES), "html": PAGES}), tmp_path / "pages.parquet" / "part-0.parquet")
    got, wanted = rows_of(spark, "article_bodies", tmp_path)
    assert got == wanted
    rows = {r.page_id: (r.body, r.paragraphs) for r in catalog.QUERIES["article_bodies"](spark, str(tmp_path)).collect()}
    assert rows[0] == ("Head first line one two tail & end", ["Head", "first line", "one", "two", "tail & end"])
    assert rows[1] == ("a b", ["a", "b"]) and rows[2] == ("the longer one of two", ["the longer one", "of two"])
    assert rows[3] == ("n no article at all", []) and rows[4] == ("some small and more of it", ["some", "small", "and more", "of it"])
    assert rows[5] == ("n outside", []) and rows[6] == ("only a line", ["only a line"]) and rows[8] == rows[9] == rows[10] == (None, [])
    assert rows[7] == ("before a loose item b c", ["a loose item", "b c"])


def test_authors_of_articles(spark):
    """empty marks of an author are passed over, and itemprop marks one too."""
    made = [(1, "<meta name=author content=' '><meta property=article:author content='Meta  Name'><i class=author>x</i>"), (2, "<i class=byline> </i><p class=author>By Ann</p>"), (3, "<b itemprop=author>Bo</b>"), (4, "<span itemprop=author itemscope><meta itemprop=author content=Cy></span>"), (5, "x")]
    trees = tree.page_trees(spark.createDataFrame(made, "id long, html string"), "id", keep=())
    assert {r.id: r.author for r in bodies.article_bodies(trees, "id").collect()} == {1: "Meta Name", 2: "Ann", 3: "Bo", 4: "Cy", 5: None}


@pytest.mark.parametrize("page", ["a<![foo bar]>b", "a<![ x>b", "a<![if !IE]>b", "a<![CDATA[x]]>b"])
def test_refused_declarations(page):
    """a page is read on behind a declaration that the parser refuses."""
    assert tree.Tree(page).row()["text"] == html.Page(page).text == "ab"
