"""Literal cases of the expressions and extractors, and properties of the operators."""

import datetime as dt
import json
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.functions import price, text, values
from millrace.functions import url as u
from millrace.operators import diff, matching, ranking, rollup, shaping
from millrace.sources import html, readers, sinks
from millrace.streaming import monitor


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first()[0]


def many(spark, column, cases):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, x string")
    got = {r.i: r.y for r in df.select("i", column(F.col("x")).alias("y")).collect()}
    assert [got[i] for i in range(len(cases))] == [c[1] for c in cases]


def test_decimal_price(spark):
    cases = [("126", None), ("$126", "126"), ("Rs. 499", "499"), ("59.99", "59.99"), ("62,99 €", "62.99"), ("€17.000", "17000"), ("-9.99", None), ("1.234,56", "1234.56"), ("1,234.50 USD", "1234.50"), ("", None), (None, None), ("free", None)]
    many(spark, price.decimal_price, cases)
    assert one(spark, lambda c: price.decimal_price(c, cents=True), "12345") == "123.45"


def test_floats(spark):
    many(spark, price.as_float, [("1,234", 1.234), ("1.234,56", 1234.56), ("1,234.56", 1234.56), ("$5", 5.0), ("x", None), (None, None)])
    many(spark, price.first_number, [("$1,299", 1.0), ("a -3.5 b", -3.5), ("none", None)])


def test_availability_and_currency(spark):
    many(spark, price.availability, [("https://schema.org/InStock", "in_stock"), ("Sold out", "out_of_stock"), ("Pre-Order", "preorder"), ("0", "out_of_stock"), ("call", "call")])
    many(spark, price.currency, [("$5", "USD"), ("5 €", "EUR"), ("5 gbp", "GBP"), ("5", "")])
    assert spark.range(1).select(price.within_band(F.lit(0.0), F.lit(5.0))).first()[0] is False


def test_domains(spark):
    cases = [("https://www.example.com/a", "example.com"), ("http://example.com:80/b", "example.com"), ("https://shop.Example.com", "shop.example.com"), ("http://localhost:3000", "localhost:3000"), ("example.com/x", "example.com"), ("", "")]
    many(spark, u.domain, cases)
    many(spark, u.special_use, [("http://localhost:3000", True), ("https://a.test/x", True), ("https://a.com", False)])


def test_urls(spark):
    many(spark, u.strip_tracking, [("https://a.b/x?utm_source=q&id=3#t", "https://a.b/x?id=3#t"), ("https://a.b/x?utm_source=q", "https://a.b/x"), ("https://a.b/x", "https://a.b/x")])
    many(spark, u.compare_form, [("HTTPS://A.b/X/?q=1#f", "https://a.b/X"), ("https://a.b/", "https://a.b/"), ("plain", "plain")])
    many(spark, u.detail_like, [("https://a.b/p/x", True), ("https://a.b/shoe-12345", True), ("https://a.b/about", False)])
    many(spark, u.surface, [("https://a.b/jobs/123456", "job_detail"), ("https://a.b/careers/", "job_listing"), ("https://a.b/dp/1", "ecommerce_detail"), ("https://a.b/c", "ecommerce_listing")])
    many(spark, u.safe, [("https://a.b/x", True), ("javascript:alert(1)", False), ("mailto:x@y.z", False), (None, False)])
    many(spark, u.target, [(" https://a.b/x?utm_id=1 ", "https://a.b/x"), ("https://a.b https://c.d", "")])


def test_text(spark):
    many(spark, text.field_key, [("productName", "product_name"), ("SKU & Size", "sku_size"), ("  Price (USD) ", "price_usd")])
    many(spark, text.undouble, [("a b a b", "a b"), ("a b c", "a b c"), ("x", "x")])
    many(spark, text.brand_before_mark, [("Acme® Pro tool", "Acme"), ("plain", None)])
    many(spark, text.stem, [("bodies", "body"), ("boxes", "box"), ("cats", "cat"), ("glass", "glass")])
    many(spark, lambda c: text.count_before(c, "replies"), [("1,204 replies", 1204), ("none", None)])
    many(spark, text.title_case, [("usb cable NASA", "Usb Cable NASA")])
    assert one(spark, lambda c: text.bigrams(text.slug_tokens(c)), "a b c a b") == ["a b", "b c", "c a"]


def test_records(spark):
    df = spark.createDataFrame([({"Name": "Shoe", "price": "5", "_x": "1", "junk": "1", "url": "javascript:x", "title": "Later"},)], "raw map<string,string>")
    r = shaping.project_surface(shaping.resolve_aliases(df, "raw", "ecommerce_detail"), "raw", "ecommerce_detail").first()
    assert r.data == {"title": "Later", "price": "5"} and r.rejected == {"junk": "not a field", "url": "unsafe url"}
    assert shaping.canonical_field("Hiring Organization") == "company" and shaping.canonical_field("the product name here") == "title"
    m = spark.range(1).select(values.merge_max(F.create_map(F.lit("a"), F.lit(1)), F.create_map(F.lit("a"), F.lit(3), F.lit("b"), F.lit(2))).alias("m")).first().m
    assert m == {"a": 3, "b": 2}


def test_verdicts(spark):
    rows = [(1, "success"), (1, "success"), (2, "success"), (2, "error"), (3, "blocked"), (3, "error"), (4, ""), (4, None), (5, "odd"), (5, "empty")]
    df = spark.createDataFrame([(r, v, i) for i, (r, v) in enumerate(rows)], "run int, v string, i int")
    got = {r.run: r.verdict for r in rollup.run_verdict(df, "run", "v", "i").collect()}
    assert got == {1: "success", 2: "partial", 3: "error", 4: "empty", 5: "empty"}


PRODUCT = """<!DOCTYPE html><html lang="en"><head><title>T &amp; t</title><meta name="description" content="sum"><script>var t="</p>";</script>
<script type="application/ld+json">{"@graph":[{"@id":"#o","@type":"Offer","price":5},{"@id":"#p","@type":"Product","name":"Shoe","offers":{"@id":"#o"}}]}</script>
<script type="application/ld+json">broken{</script></head><body><h1>Big <b>shoe</b></h1><p>one<br>two<p>three <a href="/x?y=1">go</a>
<table><tr><th>A</th><th>B</th></tr><tr><td>1</td><td>2</td></tr><tr><td>3<td>4</table><dl><dt>Color:</dt><dd>red</dd></dl>
<div itemscope itemtype="https://schema.org/Product"><span itemprop="name">Micro</span><meta itemprop="sku" content="s1"></div><img src="i.png"></body></html>"""


def test_page(spark):
    pages = spark.createDataFrame([(1, "https://a.b/c/d", PRODUCT), (2, None, None), (3, "https://a.b", "<p>unclosed <table><tr><td>x")], "id long, url string, html string")
    parsed = html.parse_pages(pages, "id").cache()
    r = {x.id: x for x in parsed.collect()}
    p = r[1]
    assert (p.title, p.h1, p.lang) == ("T & t", "Big shoe", "en") and p.links[0].href == "https://a.b/x?y=1"
    assert "one\ntwo\nthree go" in p.text and p.images[0].src == "https://a.b/c/i.png" and p.pairs[0] == ("Color", "red")
    assert [(i.type, i["name"], i.value) for i in p["items"]] == [("Product", "name", "Micro"), ("Product", "sku", "s1")]
    rows = html.table_rows(parsed.where("id = 1"), "id").collect()
    assert [x.row for x in rows] == [{"A": "1", "B": "2"}, {"A": "3", "B": "4"}]
    nodes = [json.loads(x.payload) for x in html.structured_rows(pages, "id").where("id = 1 and source = 'json_ld'").orderBy("ord").collect()]
    assert nodes[0]["@type"] == "Product" and nodes[0]["offers"]["price"] == 5
    assert html.content(parsed, "id").where("id = 1").first().summary == "sum"
    assert r[2].text == "" and r[3].tables[0].rows == [["x"]]


def test_readers_and_sinks(spark, tmp_path):
    (tmp_path / "u.csv").write_text('url,note\n https://a.b/1 ,x\nnope,y\n"https://a.b/2",z\n')
    assert [r.url for r in readers.csv_urls(spark, f"{tmp_path}/u.csv").collect()] == ["https://a.b/1", "https://a.b/2"]
    bodies = spark.createDataFrame([(1, '[{"a":1,"b":2},{"a":3,"b":1}]'), (2, '{"a":1}'), (3, "not json"), (4, None)], "id int, body string")
    rows = readers.json_records(bodies, "id", "body")
    assert sorted((r.id, r.ord, r.record) for r in rows.collect()) == [(1, 0, '{"a":1,"b":2}'), (1, 1, '{"a":3,"b":1}'), (2, 0, '{"a":1}')]
    assert {r.id: r.matches for r in readers.field_overlap(rows, "id", "record", ["a", "b"]).collect()} == {1: True, 2: False}
    maps = spark.createDataFrame([({"b": "1", "a": "x"},), ({"c": "2"},)], "data map<string,string>")
    assert sinks.write_csv_union(maps, "data", f"{tmp_path}/out") == ["a", "b", "c"]
    assert sorted(map(tuple, spark.read.option("header", True).csv(f"{tmp_path}/out").fillna("").collect())) == [("", "", "2"), ("x", "1", "")]
    assert sinks.markdown_report("R", spark.createDataFrame([("a|b", 1)], "k string, n int")) == "# R\n\n| k | n |\n| --- | --- |\n| a\\|b | 1 |\n"


def test_matching(spark):
    row = spark.createDataFrame([("Acme shoe red", "ACME red shoe", "Acme", "acme ", "s1", "S1", 100.0, 120.0, "brand_dtc")], "s_title string, c_title string, s_brand string, c_brand string, s_sku string, c_sku string, s_price double, c_price double, source_type string")
    r = matching.score_pairs(row).first()
    assert (r.score, r.label) == (1.0, "high")
    away = (row.withColumn("c_sku", F.lit("")).withColumn("s_sku", F.lit("")).withColumn("c_brand", F.lit("")).withColumn("c_title", F.lit("hat")).withColumn("c_price", F.lit(0.0)).withColumn("source_type", F.lit("unknown")))
    far = matching.score_pairs(away, fuzzy=False).first()
    assert (far.score, far.label) == (0.0, "uncertain")
    assert matching.score_pairs(away).first().score == 0.0425  # 0.34 of one shared letter, 2 / 16


keys = st.dictionaries(st.integers(0, 6), st.tuples(st.sampled_from(["a", "A ", "b", "", None]), st.sampled_from(["$5", "5.0", "7 EUR", None])), max_size=6)


@settings(max_examples=8, deadline=None)
@given(keys, keys)
def test_diff_properties(spark, a, b):
    make = lambda x: spark.createDataFrame([(k, *v) for k, v in x.items()], "k int, name string, price string")
    run = lambda x, y: {tuple(r) for r in diff.snapshot_diff(make(x), make(y), "k", ["name", "price"]).collect()}
    assert run(a, a) == set()
    there, back = run(a, b), run(b, a)
    assert {r[0] for r in there if r[1] == "record_new"} == {r[0] for r in back if r[1] == "record_removed"} == set(b) - set(a)
    assert {(r[0], r[2], r[4], r[3]) for r in there if r[1] == "field_changed"} == {(r[0], r[2], r[3], r[4]) for r in back if r[1] == "field_changed"}


def test_ranking(spark):
    df = spark.createDataFrame([(1, "x", "", 1), (1, "", "b", 2), (2, "y", "c", 3), (None, "z", "d", 4)], "k int, a string, b string, o int")
    assert {tuple(r) for r in ranking.merge_rows(df, ["k"], ["a", "b"], [F.col("o")]).collect()} == {(1, "x", "b", 1), (2, "y", "c", 3), (None, "z", "d", 4)}


def test_streaming_states(spark, tmp_path):
    t = lambda m: dt.datetime(2024, 1, 1, 0, m)
    batches = [[("u", t(0), 1, "a"), ("u", t(1), 2, "a"), ("v", t(1), 3, "x")], [("u", t(2), 4, "a"), ("u", t(3), 5, None), ("v", t(4), 6, "y")], [("u", t(5), 7, "a"), ("u", t(6), 8, "a")]]
    schema = "url string, ts timestamp, event_id long, digest string"
    every = spark.createDataFrame([r for b in batches for r in b], schema)
    want = {r.event_id: (r.changed, r.unchanged_count) for r in diff.page_states(every, "url", "ts", "event_id", "digest").collect()}
    src = f"{tmp_path}/in"
    for i, b in enumerate(batches):
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(src)
        (tmp_path / f"mark{i}").touch()
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = monitor.page_states(stream).writeStream.format("memory").queryName("states").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    assert {r.event_id: (r.changed, r.unchanged_count) for r in spark.table("states").collect()} == want


def test_streaming_changes(spark, tmp_path):
    schema = "k int, price string, o int"
    for i, rows in enumerate([[(1, "$5", 1), (2, "$6", 1)], [(1, "5 USD", 2), (3, "$1", 2)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = stream.writeStream.foreachBatch(monitor.snapshot_changes(f"{tmp_path}/out", "k", ["price"], "o")).option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    got = {(r.batch_id, r.k, r.event_type) for r in spark.read.parquet(f"{tmp_path}/out/events").collect()}
    assert got == {(0, 1, "record_new"), (0, 2, "record_new"), (1, 2, "record_removed"), (1, 3, "record_new")}


@pytest.mark.parametrize("kind", ["null", "empty"])
def test_empty_inputs(spark, kind):
    df = spark.createDataFrame([] if kind == "empty" else [(None, None)], "k string, v string")
    assert rollup.homogeneity(df, "k", "v").count() <= 1
    assert rollup.fill_rates(df, ["k", "v"]).count() == 2
    assert ranking.latest_per_key(df.withColumn("t", F.lit(1)), ["k"], "v", "t").count() <= 1


def test_title_similarity_is_the_larger_of_overlap_and_sequence(spark):
    from difflib import SequenceMatcher

    from millrace.operators import matching

    rows = [("red runing shoe", "red running shoe"), ("shoe red", "red shoe"), ("", "x y"), ("a1 b2 c3", "zz"), (None, "red")]
    got = spark.createDataFrame(rows, "a string, b string").select(matching.title_similarity(F.col("a"), F.col("b")).alias("s")).collect()
    for (a, b), r in zip(rows, got, strict=True):
        x, y = ({t for t in re.split("[^a-z0-9]+", s or "") if len(t) > 1} for s in (a, b))
        want = max(len(x & y) / len(x | y), SequenceMatcher(None, " ".join(sorted(x)), " ".join(sorted(y))).ratio()) if x and y else 0.0
        assert abs(r.s - want) < 1e-9


def test_json_trees():
    from millrace.sources import json_tree as t

    assert t.fragment('x = {"a": "}", "b": [1, {"c": 2}]}; y = {}') == '{"a": "}", "b": [1, {"c": 2}]}' and t.fragment("none") == "" and t.fragment("{[}") == ""
    assert t.revive([["Reactive", 1], {"a": 2, "b": 3, "me": 1}, "x", [2, 9]])["b"] == ["x", None]
    assert t.revive([["Ref", 0]]) is None and t.revive("x") == "x" and t.revive([]) == []
    deep = {"a": {"b": {"c": {"items": [{"title": 1}]}}}, "big": [{"k": 1}] * 3}
    assert t.best_list([{"title": 1}, {"title": 2}]) == [{"title": 1}, {"title": 2}] and t.best_list({"facets": [{"k": i} for i in range(20)], "edges": [{"node": 1}]}) == [{"node": 1}]
    assert t.best_list({"items": [{"list": [{"title": 1}] * 9}]}) == [{"list": [{"title": 1}] * 9}] and t.best_list({"a": [{"x": 1}], "b": [{"x": 1}]}) is not None
    refused, kept = [{"k": 1}] * 9, [{"offer": {"priceText": 1}}] * 2
    assert t.best_list({"data": refused, "b": kept}, frozenset(["price_text"])) == kept and t.best_list({"data": refused}, frozenset(["price_text"])) == [] and t.best_list({"a": kept[:1]}, frozenset(["price_text"])) == []
    assert t.best_list(deep) == [{"title": 1}] and t.best_list({"a": [1, 2]}) == [] and t.best_list(None) == []
    assert t.overlay({"a": "", "b": {"c": 1}}, {"a": 2, "b": {"c": 3, "d": 4}}) == {"a": 2, "b": {"c": 1, "d": 4}}
    assert t.has_path({"hasVariant": [{"offers": [{"price": 0}]}]}, "offers.price") and not t.has_path({"a": [{"b": ""}]}, "a.b")
    assert t.leaves({"a": [1, {"b": {"c": {"d": {"e": 9}}}}], "z": None}, depth=3) == [1]


def test_blank_and_null_values(spark):
    from millrace.functions import coerce, url

    rows = [(None,), ("",), ("  ",), ("\\",), ("http://",), ("[",), ("{}",)]
    df = spark.createDataFrame(rows, "c string")
    c, page = F.col("c"), F.lit("https://a.example.com/x/")
    out = df.select(
        coerce.coerce_text(c).alias("t"), coerce.coerce_long_text(c), coerce.title_noise(c).alias("n"), coerce.location(c), coerce.sanitize_long_text(c, c), coerce.decode_escapes(c), url.found_in(c, page).alias("u"), url.absolute(page, c).alias("a"),
        url.registrable(c), url.currency_hint(c), *(coerce.field(f, c, page).alias(f) for f in coerce.KINDS),
    ).collect()
    assert [r.t for r in out[:3]] == [None] * 3 and all(r.n for r in out[:3]) and [r.a for r in out[:3]] == [""] * 3 and [r.u for r in out[:3]] == [[]] * 3
    assert all(r.price is None and r.url is None for r in out[:3])


HOSTILE = [
    None, "", "null", "NaN", "[" * 200_000, '{"a":' * 3_000 + "1" + "}" * 3_000, '{"@type":{"x":1},"@id":["a"],"name":"t"}', '{"@graph":[{"@id":{"b":1}},{"@id":"x","y":{"@id":"x"}}]}', '{"@type":[1,null],"name":1e400}',
    '{"name":"\\ud83d cut","v":NaN}', '{"name":"\\ud83d\\ude00"}', '{"@graph":3}', '[[["Ref",0]]]', '{"a":"\\u0000"}', "{" + '"k":1,' * 9 + "}",
]


def test_no_page_or_body_kills_a_job(spark):
    import json

    from millrace.sources import html, json_tree, tree

    wrap = lambda x: f"<script type='application/ld+json'>{x}</script><script type='application/json' id='__NUXT_DATA__'>{x}</script><script>window.__STATE__ = {x};</script>"
    pages = spark.createDataFrame([(i, x and wrap(x), x, "http://a.b/") for i, x in enumerate(HOSTILE)], "id int, html string, body string, url string")
    found = {}
    for r in html.structured_rows(pages, "id").collect():
        found.setdefault(r.id, []).append(json.loads(r.payload))
    assert found == {6: [{"@type": {"x": 1}, "@id": ["a"], "name": "t"}], 7: [{"@id": "x", "y": {"@id": "x"}}, {"@id": {"b": 1}}], 8: [{"@type": [1, None], "name": None}], 9: [{"name": "\ufffd cut", "v": None}], 10: [{"name": "\U0001f600"}], 11: [{"@graph": 3}], 13: [{"a": "\0"}]}
    assert json_tree.page_states(pages, "id").count() > 0 and tree.page_trees(pages, "id").count() == len(HOSTILE)
    rows = pages.select("id", json_tree.canonical(F.col("body")).alias("c"), json_tree.merged(F.col("body"), F.col("body")).alias("m"), json_tree.leaf_texts(F.col("body")).alias("l"), json_tree.path_present(F.col("body"), "name").alias("p")).orderBy("id").collect()
    assert [r.c for r in rows[:6]] == [None] * 6 and rows[9].c == '{"name":"\ufffd cut","v":null}' and rows[10].l == ["\U0001f600"] and rows[9].p
    assert json_tree.nested_records(pages, "id", "body").where("id = 7").count() == 2
    assert json_tree.revive([["Ref", i + 1] for i in range(5_000)] + [["x"]]) == ["x"]
