"""Rival payloads and record sets, pushed states, repair chains."""

import json
import random

from pyspark.sql import functions as F

from millrace.operators import repairs, rivals
from millrace.sources import json_tree, payloads


def test_products_by_facts(spark):
    a, b = {"name": "a", "price": 1, "variants": [{"color": "x"}, {"q": 1}]}, {"title": "b", "sku": "s", "variants": [{"size": 1}, {"size": 2}]}
    bodies = [(1, json.dumps({"x": [a, {"deep": {"b": b}}]})), (2, "[]"), (3, None), (4, json.dumps({"@type": "Article", "name": "n", "price": 1})), (5, json.dumps([{"name": "p", "price": 1}, {"name": "q", "price": 1}])), (6, '{"a":' * 3_000)]
    found = payloads.products(spark.createDataFrame(bodies, "id long, body string"), "id", "body")
    best = {r.id: json.loads(r.payload) for r in payloads.best_product(found, "id").collect()}
    assert best == {1: b, 5: {"name": "p", "price": 1}}
    assert payloads.weigh(b) == [2, 0, 0, 2, 1, 0, 0, 2, 3]


def test_united_sets_equal_brute_force(spark):
    rng, rows = random.Random(1), []
    for page in range(15):
        for place, source in enumerate("abc"):
            for i in range(rng.randrange(5)):
                data = {k: rng.choice(["", " ", f"{source}{i}{k}"]) for k in "xyz" if rng.random() < 0.7}
                if rng.random() < 0.7:
                    data["url"] = f"/u{rng.randrange(3)}"
                rows.append((page, source, place, i, data))
    rows += [(99, "a", 0, 0, None), (99, "a", 0, 1, {})]
    out = rivals.united(spark.createDataFrame(rows, "page long, source string, place int, ord int, data map<string,string>"), "page").collect()
    want = {}
    for page in {r[0] for r in rows}:
        own = [(r[1], r[2], r[3], {k: v for k, v in (r[4] or {}).items() if v.strip()}) for r in rows if r[0] == page]
        score = lambda s: (-sum(r[0] == s for r in own), -sum(len(r[3]) for r in own if r[0] == s), min(r[1] for r in own if r[0] == s))
        order = sorted({r[0] for r in own}, key=score)
        merged, loose = {}, set()
        for s in order:
            for r in sorted((r for r in own if r[0] == s), key=lambda r: r[2]):
                if "url" in r[3]:
                    for k, v in r[3].items():
                        merged.setdefault(r[3]["url"], {}).setdefault(k, v)
                else:
                    loose.add(json.dumps(r[3], sort_keys=True))
        want[page] = (order[0], sorted(json.dumps(x, sort_keys=True) for x in merged.values()), sorted(loose))
    got = {}
    for r in out:
        got.setdefault(r.page, (r.best_source, [], []))[1 if r.url else 2].append(json.dumps(r.data, sort_keys=True))
    assert {p: (s, sorted(a), sorted(b)) for p, (s, a, b) in got.items()} == want


def test_pushed_states_however_they_are_cut():
    text = '1:["$","div",null,{"product":"$L3","again":"$3"}]\n2:I["x",[]]\n4:Ta,line\nétoo3:{"name":"Shoe","note":"$4","me":"$1"}\n5:{"a":"$6"}\n6:{"b":"$5"}\n'
    want = [["$", "div", None, {"product": {"name": "Shoe", "note": "line\nétoo", "me": "$1"}, "again": "$3"}], {"a": {"b": "$5"}}]
    for k in range(1, len(text)):
        page = "".join(f"<script>self.__next_f.push([1,{json.dumps(x)}])</script>" for x in (text[:k], text[k:]))
        assert json_tree.pushed(page) == want
    deep = "".join(f'{i:x}:{{"k":"${i - 1:x}"}}\n' for i in range(1_000))
    assert len(json_tree.pushed(f"<script>self.__next_f.push([1,{json.dumps(deep)}])</script>")) == 1_000
    assert json_tree.pushed('self.__next_f.push([1,"\\ud800"])') == [] and list(json_tree.states("self.__next_f.push([1,\"zz\"])")) == []


def test_rules_see_what_the_rules_before_left(spark):
    rules = [repairs.Rule("double", lambda r: {"a": r["a"] * 2}), repairs.Rule("copy", lambda r: {"b": r["a"]}), repairs.Rule("idle", lambda r: {"c": r["c"]}), repairs.Rule("halve", lambda r: {"a": F.when(r["b"] > 5, r["a"] / 2).otherwise(r["a"]).cast("long")})]
    rows = spark.createDataFrame([(1, 0, "x", None), (3, 0, None, None), (None, None, "y", "old")], "a long, b long, c string, repairs string")
    out = [(r.a, r.b, r.c, r.repairs) for r in repairs.repaired(rows, rules).collect()]
    assert out == [(2, 2, "x", ["double", "copy"]), (3, 6, None, ["double", "copy", "halve"]), (None, None, "y", [])]
    many = repairs.repaired(rows, [repairs.Rule(f"r{i}", lambda r: {"a": r["a"] + 1}) for i in range(60)])
    assert many.first().a == 61 and repairs.repaired(rows.limit(0), rules).collect() == []


def test_ten_thousand_terms_equal_a_naive_search(spark, tmp_path):
    from millrace.operators import terms

    rng = random.Random(2)
    words = [f"w{i}" for i in range(60)]
    known = sorted({(f"d{rng.randrange(3)}", " ".join(rng.choice(words) for _ in range(rng.choice((1, 2, 2, 3, 4))))) for _ in range(10_000)})
    known = [(d, t, t.upper()) for d, t in known if rng.random() < 0.5 or " " in t]
    texts = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(30)))) for i in range(60)] + [(90, None), (91, ""), (92, "W1 -- w2!"), (None, "w1")]
    sets = {}
    for d, t, _ in known:
        sets.setdefault(d, set()).add(tuple(t.split()))
    want = []
    for i, t in texts:
        w = [] if t is None or i is None else "".join(c if c.isalnum() else " " for c in t.lower()).split()
        for d, s in sets.items():
            at = n = 0
            while at < len(w):
                size = next((k for k in (4, 3, 2, 1) if at + k <= len(w) and tuple(w[at : at + k]) in s), 0)
                if size:
                    want.append((i, d, n, " ".join(w[at : at + size])))
                    n += 1
                at += size or 1
    out = terms.term_matches(spark.createDataFrame(texts, "id long, text string"), "id", "text", spark.createDataFrame(known, "dimension string, term string, value string"))
    assert sorted((r.id, r.dimension, r.ord, r.term) for r in out.collect()) == sorted(want) and all(r.value == r.term.upper() for r in out.collect())
    assert terms.term_matches(spark.createDataFrame(texts, "id long, text string"), "id", "text", spark.createDataFrame([], "dimension string, term string, value string")).collect() == []
    (tmp_path / "a.json").write_text(json.dumps({"attributes": [{"name": "Color", "values": [{"name": "Navy", "aliases": ["dark blue"]}, {"name": None}]}, {"name": "Fit", "values": [{"name": "Slim"}]}]}, indent=1))
    assert sorted(map(tuple, terms.dimension_terms(spark, f"{tmp_path}/a.json").collect())) == [("Color", "Navy", "Navy"), ("Color", "dark blue", "Navy"), ("Fit", "Slim", "Slim")]


def test_as_of_equals_brute_force(spark):
    from datetime import datetime, timedelta

    from millrace.operators import asof

    rng, start = random.Random(4), datetime(2024, 1, 1)
    when = lambda: start + timedelta(hours=6 * rng.randrange(60))
    runs = [(i, rng.choice("ab"), when(), f"x{i}") for i in range(40)] + [(90, "a", None, "n"), (91, None, when(), "k"), (92, "z", when(), "z")]
    rows = {n: [(i, rng.choice("ab"), when(), i * 10) for i in range(30)] + [(50, "a", None, 1), (51, None, when(), 2)] for n in ("p", "q")}
    rows["p"] += [(60, "a", start - timedelta(days=40), 7), (61, "b", start, 8), (62, "b", start, 9)]
    frame = lambda r: spark.createDataFrame(r, "id long, k string, at timestamp, v long")
    histories = {n: (frame(r).repartition(3), ["v"]) for n, r in rows.items()} | {"none": (frame([]), ["v"])}
    out = asof.as_of(spark.createDataFrame(runs, "id long, k string, at timestamp, p0 string"), histories, ["k"]).collect()
    assert len(out) == len(runs)
    for r in out:
        for n in ("p", "q"):
            past = [(t, i, v) for i, k, t, v in rows[n] if k == r.k and k is not None and t is not None and r["at"] is not None and t <= r["at"]]
            assert (r[n] and (r[n]["at"], r[n].v)) == (max(past) and (max(past)[0], max(past)[2]) if past else None)
        assert r.none is None and r.p0 is not None


def test_brands_before_the_title_in_a_url(spark):
    from millrace.operators import enrich

    rows = [("https://a.b/p/new-balance-red-shoe-12.html", "Red Shoe", "New Balance"), ("https://a.b/p/red-shoe", "Red Shoe", None), ("https://a.b/acme-red-shoe/x", "Red shoe!", "Acme"), ("https://a.b/12-red-shoe", "Red Shoe", None), ("https://a.b/a-b-c-d-e-red-shoe", "Red Shoe", None), ("https://a.b/acme-shoe", "Shoe", None), (None, "Red Shoe", None), ("https://a.b/acme-red-shoe", None, None)]
    out = spark.createDataFrame(rows, "url string, title string, want string").select("want", enrich.brand_from_url(F.col("url"), F.col("title")).alias("got")).collect()
    assert all(r.want == r.got for r in out), out


def test_sitemaps_and_feeds(spark):
    from millrace.sources import readers

    rows = [
        (1, "<urlset><url><loc> https://a.b/x-y?p=1&amp;q=&#39;2&#39; </loc></url><url><image:loc><![CDATA[https://a.b/c&d]]></image:loc></url><url><loc>https://a.b/x-y?p=1&amp;q=&#39;2&#39;</loc></url></urlset>"),
        (2, '<feed xmlns="http://www.w3.org/2005/Atom"><link href="https://a.b/feed" rel="self"/><entry><atom:link rel=\'alternate\' href=\'https://a.b/one\'/><link rel="enclosure" href="https://a.b/f.mp3"/></entry></feed>'),
        (3, "<rss><channel><item><link>https://a.b/item.html</link></item><item><link/></item></channel></rss>"), (4, None), (5, "<loc>ftp://x</loc>"),
    ]
    out = [(r.id, r.ord, r.url) for r in readers.sitemap_links(spark.createDataFrame(rows, "id int, xml string"), "id", "xml").orderBy("id", "ord").collect()]
    assert out == [(1, 0, "https://a.b/x-y?p=1&q='2'"), (1, 1, "https://a.b/c&d"), (2, 0, "https://a.b/one"), (3, 0, "https://a.b/item.html")]


def test_categories_meet_items_by_rare_tokens_only(spark):
    from millrace.operators import matching

    rng = random.Random(7)
    tokens = [f"t{i}" for i in range(12)]
    cats = {f"c{i}": {"t0", *rng.sample(tokens, rng.randrange(1, 5))} for i in range(30)}
    items = {i: rng.sample(tokens, rng.randrange(0, 6)) for i in range(40)}
    want = set()
    for i, t in items.items():
        scored = sorted((-round(len(set(t) & c) / len(t), 4), name) for name, c in cats.items() if t and len(set(t) & c) / len(t) >= 0.5)
        want |= {(i, name, -s) for s, name in scored[:3]}
    c = spark.createDataFrame([(n, t) for n, ts in cats.items() for t in ts] + [("c0", "t0")], "category string, token string")
    d = spark.createDataFrame([(i, t) for i, t in items.items()], "i long, t array<string>")
    assert {(r.i, r.category, r.overlap) for r in matching.taxonomy_candidates(d, "i", F.col("t"), c).collect()} == want


def test_snapshots_may_start_anywhere(spark, tmp_path):
    from millrace.streaming import monitor

    run = monitor.snapshot_changes(f"{tmp_path}/out", "k", ["price"], "o")
    rows = lambda *r: spark.createDataFrame(list(r), "k string, price long, o long")
    run(rows(("a", 1, 1)), 7)
    run(rows(("a", 2, 1), ("b", 1, 1)), 11)
    assert monitor.last_snapshot(spark, f"{tmp_path}/out", 11) == 7 and monitor.last_snapshot(spark, f"{tmp_path}/none", 3) is None
    events = spark.read.parquet(f"{tmp_path}/out/events")
    assert {r.batch_id for r in events.collect()} == {7, 11} and events.where("batch_id = 11").count() == 2


def test_only_incomplete_pages_are_walked(spark):
    from millrace.operators import tiers

    records = spark.createDataFrame([(1, "a", 1.0, "x"), (2, " ", None, "y"), (3, None, 2.0, None), (4, None, None, "no page"), (None, None, None, "no key")], "id long, title string, price double, other string")
    pages = spark.createDataFrame([(1, "never"), (2, "page"), (3, "page"), (9, "never")], "id long, html string")
    seen = []

    def walk(some):
        seen.extend(r.html for r in some.collect())
        found = [("title", "new"), ("price", "7.5"), ("price", " "), ("color", "red")]
        return some.select("id").crossJoin(spark.createDataFrame(found, "field string, value string"))

    out = {r.other: (r.id, r.title, r.price, r.filled) for r in tiers.completed(records, pages, "id", ("title", "price"), walk).collect()}
    assert out == {"x": (1, "a", 1.0, []), "y": (2, "new", 7.5, ["title", "price"]), None: (3, "new", 2.0, ["title"]), "no page": (4, None, None, []), "no key": (None, None, None, [])}
    assert seen == ["page", "page"]


def test_network_rows(spark):
    from millrace.sources import network

    bodies = [
        (1, 0, "http://s.com/a/list", '[{"title":" T ","url":"x.html","price":{"value":"5"}},{"name":"n","slug":"/q","price":"\\u20ac7"},{"title":true,"url":"/b"},{"title":"z","url":{"a":1}}]'),
        (1, 1, "http://s.com/a/list", '{"l":{"name":"again","href":"/q"},"m":{"name":"own","permalink":"//c.com/d","image":["x"],"review":{"rating":"x","count":3}}}'),
        (2, 0, "http://s.com/", "[" * 5_000), (3, 0, None, '{"title":"t","url":"/x"}'), (4, 0, "http://s.com/", None),
    ]
    rows = network.network_rows(spark.createDataFrame(bodies, "id long, place int, at string, body string"), "id", "body", "at", "place").where("id = 1").orderBy("ord").collect()
    assert [(r.title, r.url, r.price, r.currency, r.review_count, r.rating) for r in rows] == [("T", "http://s.com/a/x.html", 5.0, None, None, None), ("n", "http://s.com/q", 7.0, "EUR", None, None), ("own", "http://c.com/d", None, None, 3, None)]


def test_brands_by_their_rarest_word(spark):
    from millrace.operators import enrich

    brands = spark.createDataFrame([("The Co",), ("The North Face",), ("North",), ("Face Co",), ("!!",), (None,)], "b string")
    titles = spark.createDataFrame([(1, "Jacket by The North Face"), (2, "north jacket"), (3, "the face co. cream"), (4, "the co"), (5, "northface"), (6, None)], "id long, t string")
    assert {r.id: r.brand for r in enrich.known_brand(titles, "id", "t", brands, "b").collect()} == {1: "The North Face", 2: "North", 3: "Face Co", 4: "The Co", 5: None, 6: None}


def test_quality_of_absent_values(spark):
    from millrace.operators import quality

    kinds = "surface string, blocked boolean, required map<string,boolean>, title string, url string, price double, currency string, category string, description string, sku string, barcode string, gender string, product_type string, listing_rows array<struct<title:string,url:string>>, variants array<struct<options:map<string,string>,price:double,currency:string>>, repairs array<string>, verdict string"
    none = [None] * 17
    rows = [none, ["ecommerce_detail", *none[1:]], ["ecommerce_listing", None, {}, *none[3:]], ["job_detail", True, *none[2:]], ["x", None, {"price_sane_ok": True}, "T", None, 50_000.0, "jpy", *none[7:]], ["x", None, {"price_sane_ok": True}, "T", None, 50_000.0, "usd", *none[7:]], ["ecommerce_detail", None, {"identity_ok": False}, *none[3:13], [], [({"color": None}, None, None)], [], "old"]]
    out = quality.checked(spark.createDataFrame(rows, kinds)).collect()
    assert [(r.failure, r.verdict) for r in out] == [("none", "good"), ("detail_identity_mismatch", "bad_output"), ("listing_chrome_noise", "bad_output"), ("blocked", "blocked"), ("none", "good"), ("price_magnitude_anomaly", "bad_output"), ("none", "good")]
    assert all(len(r.checks) == 14 for r in out)
