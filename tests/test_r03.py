"""Faults of the third round: sizes of expressions and steps, results as the SQL has them."""

import decimal
import random
from html.parser import HTMLParser

import duckdb
import pytest
from pyspark.sql import functions as F

from millrace.functions import coerce
from millrace.operators import variants
from millrace.plans import catalog, registry
from millrace.sources import bodies, html, tree

SF = "/root/testdata/sf0.001"


def test_coerced_fields_add_up(spark):
    """a field's expression names its value a bounded number of times, and parts are spread over the cluster."""
    text = spark.range(1).select(coerce.field("price", F.concat(F.lit("mark"), F.col("id")), F.lit("https://x.example.com/")))._jdf.queryExecution().analyzed().toString()
    assert text.count("mark") < 5 and len(text) < 20_000
    assert registry.parts(spark, SF).rdd.getNumPartitions() == 3 * spark.sparkContext.defaultParallelism


def test_subsets_without_a_join(spark):
    """no table of all products' options is joined, which a planner may broadcast; equal rows stay, parts of others go."""
    plan = catalog.QUERIES["whole_variants"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
    made = [(1, 0, {"color": "Red"}), (1, 1, {"Colour": "Red", "size": "5"}), (1, 2, {"color": "Red", "size": "5 Regular"}), (2, 0, {"color": "Red"}), (2, 1, {})]
    rows = spark.createDataFrame(made, "product int, ord int, options map<string,string>")
    assert sorted((r["product"], r["ord"]) for r in variants.without_subsets(rows, "product").collect()) == [(1, 1), (1, 2), (2, 0), (2, 1)]


def rows_of(spark, name, made):
    """The rows of a query and of its SQL over tables in a folder, those that it lacks from sf0.001."""
    plain = lambda v: round(v, 9) if isinstance(v, float) else float(v) if isinstance(v, decimal.Decimal) else v
    con = duckdb.connect()
    for t in ("pages", "part", "lineitem"):
        if not (made / f"{t}.parquet").exists():
            spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(str(made / f"{t}.parquet"))
        con.execute(f"create view {t} as select * from '{made}/{t}.parquet/*.parquet'")
    got, cur = catalog.QUERIES[name](spark, str(made)), con.execute(catalog.ORACLE[name])
    head = [x[0] for x in cur.description]
    return tuple(sorted(repr([plain(r[head.index(c)] if isinstance(r, tuple) and not hasattr(r, "asDict") else r[c]) for c in sorted(head)]) for r in rows) for rows in (got.collect(), cur.fetchall()))


@pytest.mark.parametrize("name", ["article_bodies", "articles", "page_titles", "page_content", "page_headings", "page_headings_text", "selector_rules"])
def test_broken_references(spark, tmp_path, name):
    """Pages that break off inside a reference are read as the SQL reads them."""
    html = F.regexp_replace("html", "<(h1|title|p)>", "<$1>cut&amp &quot &am &#38; &lt; &amp; ")
    spark.read.parquet(f"{SF}/pages.parquet").limit(20).withColumn("html", html).write.parquet(str(tmp_path / "pages.parquet"))
    got, wanted = rows_of(spark, name, tmp_path)
    assert got == wanted and got


def test_halves_of_doubles(spark, tmp_path):
    """77710.15 / 14 is 5550.724999999999, whose hundredths are the double 555072.5; values round after the filter."""
    items = spark.createDataFrame([(1, 77710.15, 14.0), (1, 5550.73, 1.0), (2, 0.001, 1.0), (3, -1.0, 1.0), (3, 2.0, 1.0)], "l_partkey long, l_extendedprice double, l_quantity double")
    items.write.parquet(str(tmp_path / "lineitem.parquet"))
    got, wanted = rows_of(spark, "variant_prices", tmp_path)
    assert got == wanted and len(got) == 3


def plan_of(spark, name):
    return catalog.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()


def test_two_views_in_one_pass(spark, tmp_path):
    """a page is parsed once and its views are not joined; stored pages are spread over the cluster."""
    plan = plan_of(spark, "two_views")
    assert plan.count("MapInArrow") == 1 and "Join" not in plan
    assert registry.stored_pages(spark, SF).rdd.getNumPartitions() == 3 * spark.sparkContext.defaultParallelism
    got, wanted = rows_of(spark, "two_views", tmp_path)
    assert got == wanted and got


def test_fractional_quantities(spark, tmp_path):
    """a fractional quantity is rounded, halves to even, as the SQL's cast does, not cut."""
    made = [(2, 1, 1, 1.5, "A"), (3, 1, 1, 2.0, "A"), (4, 2, 1, 2.5, "A"), (9, 2, 1, 2.0, "A"), (8, 3, 1, 1.7, "R"), (9, 3, 2, 1.0, "R")]
    items = spark.createDataFrame(made, "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double, l_returnflag string")
    more = {"l_suppkey": F.lit(1).cast("long"), "l_extendedprice": F.lit(1.0), "l_discount": F.lit(0.0), "l_tax": F.lit(0.0), "l_linestatus": F.lit("F"), "l_shipdate": F.lit("2024-01-01").cast("timestamp")}
    items.withColumns(more).write.parquet(str(tmp_path / "lineitem.parquet"))
    got, wanted = rows_of(spark, "snapshot_diff", tmp_path)
    assert got == wanted and len(got) == 1


def test_rival_sets_meet_once(spark):
    """rows are joined once, by page, with the standings of its sets."""
    assert plan_of(spark, "rival_sets").count("Join ") == 1


def test_filters_name_made_values(spark):
    """rows of listings are filtered by values already made, not by the expressions that make them."""
    assert max(len(x) for x in plan_of(spark, "listing_records").split("\n") if "Filter" in x) < 20_000


@pytest.mark.parametrize("name, made", [("product_pairs", {"pairs"}), ("table_export", {"tables"}), ("article_meta", {"title", "h1", "text", "meta"})])
def test_only_columns_that_are_read(spark, name, made):
    """a page's parse makes the columns that the query reads, no others."""
    step = next(x for x in plan_of(spark, name).split("\n") if "MapInArrow" in x)
    assert {x.split("#")[0].strip() for x in step[step.rindex("[") + 1 : step.rindex("]")].split(",")} == {"p_partkey"} | made


def test_payloads_are_rows(spark):
    """a task's rows are the payloads, not lists of them that another step takes apart."""
    plan = plan_of(spark, "structured_sources")
    assert "MapInArrow" in plan and "Generate" not in plan


def test_microdata_in_one_pass(spark):
    """items are found where a page is parsed; its tree is not sent to the JVM and back."""
    assert plan_of(spark, "nested_microdata").count("MapInArrow") == 1
    pages = spark.createDataFrame([(1, "<div itemscope itemtype=x/A><b itemprop=n>one<i itemprop=m>two"), (2, None), (3, "<p>none"), (4, "<p itemscope><p itemscope itemtype=B>")], "id long, html string")
    rows = [sorted(map(repr, f.collect())) for f in (bodies.page_microdata(pages, "id"), bodies.microdata(tree.page_trees(pages, "id", keep=()), "id"))]
    assert rows[0] == rows[1] and len(rows[0]) == 3


def test_short_way_for_plain_tags():
    """The short way reads made pages as the standard parser does."""

    def events(kind, page):
        out = []

        class Own(kind):
            handle_starttag = lambda self, tag, attrs: out.append(("<", tag, attrs))
            handle_startendtag = lambda self, tag, attrs: out.append(("/", tag, attrs))
            handle_endtag = lambda self, tag: out.append((">", tag))
            handle_data = lambda self, data: out.append(("", data))
            handle_comment = lambda self, data: out.append(("!", data))

        parser = Own(convert_charrefs=True)
        parser.feed(page)
        parser.close()
        return out

    rng = random.Random(3)
    bits = ["<p>", "</p>", "<P>", "</H1>", "<h1>", "<br>", "<br/>", "<b >", "</b >", "</b x>", "<a href='x>y'>", "</a", "<i", "<", ">", "</>", "<script>", "</script>", "<SCRIPT>", "if (a<b>c)", "<style>", "</style>", "<title>", "</title>", "<textarea>", "</textarea>", "<!--", "-->", "<x-y>", "</x-y>", "<é>", "&amp", "&lt;", " text ", "\n", "<td>1", "<?p>", "<!D>", "<b\x00>", "<1>"]
    for _ in range(3000):
        page = "".join(rng.choice(bits) for _ in range(rng.randrange(1, 14)))
        assert events(html.Reader, page) == events(HTMLParser, page), page
