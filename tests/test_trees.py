"""Page trees and selectors: lenient pages, a naive matcher, malformed rules, hostile input."""

import random

import pytest

from millrace.sources import selectors as s
from millrace.sources import tree


def nodes(html):
    row = tree.Tree(html).row()
    return s.Nodes(row["text"], *([n[k] for n in row["nodes"]] for k in ("parent", "last", "nth", "of_type", "tag", "attrs", "start", "end")))


def shape(html):
    n = nodes(html)
    depth = {-1: -1}
    for i, p in enumerate(n.parent):
        depth[i] = depth[p] + 1
    return " ".join(f"{depth[i]}{t}" for i, t in enumerate(n.tag))


def found(html, selector, make=s.css):
    n = nodes(html)
    ends = s.Automaton([steps for steps, _ in make(selector)]).run(n)
    return sorted({i for e in ends for i in e})


def texts(html, selector, make=s.css):
    n = nodes(html)
    return [" ".join(n.within(i).replace(tree.SEAM, " ").split()) for i in found(html, selector, make)]


def test_lenient_trees():
    assert shape("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>") == "0ul 1li 1li 2ul 3li 1li"
    assert shape("<p>a<div>b</div><p>c<p>d") == "0p 0div 0p 0p"
    assert shape("<table><tr><td>1<td>2<tr><th>3<table><tr><td>4</table></table>") == "0table 1tr 2td 2td 1tr 2th 3table 4tr 5td"
    assert shape("<dl><dt>a<dd>b<dt>c</dl><select><option>1<option>2</select>") == "0dl 1dt 1dd 1dt 0select 1option 1option"
    assert shape("<div><b><p>x</b>y</div></span><i>z") == "0div 1b 2p 0i" and shape("<a href=1>x<a href=2>y") == "0a 0a"
    assert shape("<td>loose</td></table></p><br><img><div/><span>") == "0td 0br 0img 0div 1span"
    assert shape("<p><b>a<br>c<p>d") == "0p 1b 2br 0p"
    assert shape("") == shape("no tags") == "" and shape("<![foo[ <p>x") in ("", "0p")
    n = nodes("<div>a<b>b</b>c<script>var x='<p>'</script></div>")
    assert n.within(0).replace(tree.SEAM, "|") == "a|b|c||" and [x.strip(tree.SEAM) for x in n.own(0)] == ["a", "c", ""]
    deep = nodes("<div>" * 20_000 + "x")
    assert len(deep.tag) == 20_000 and deep.last[0] == 19_999 and len(s.Automaton([c for c, _ in s.css("div div > div")]).run(deep)[0]) == 19_998


def test_selectors():
    page = '<ul class="a b"><li id=x><a href=/1>One</a><li lang=en-gb><b>Two</b> &amp; more<li>Three</ul><p>p</p><table><tr><td>1<td>2<tr><td>3</table>'
    assert texts(page, "li") == ["One", "Two & more", "Three"] and texts(page, "ul > li:nth-child(2)") == ["Two & more"] and texts(page, "UL.a.b LI#x a[href^='/']") == ["One"]
    assert texts(page, "li + li") == ["Two & more", "Three"] and texts(page, ".a li:not(#x)") == ["Two & more", "Three"] and texts(page, "td:last-child, p") == ["p", "2", "3"]
    assert texts(page, "[lang|=en]") == ["Two & more"] and texts(page, "li:nth-child(2n+1)") == ["One", "Three"] and texts(page, "li:nth-child(-n+2)") == ["One", "Two & more"] and texts(page, "td:nth-of-type(2)") == ["2"]
    assert texts(page, "//tr[2]/td[1]", s.xpath) == ["3"] and texts(page, "//ul[contains(@class,'b')]/li[last()]", s.xpath) == ["Three"] and texts(page, "/p | //li[contains(., 'Tw')]", s.xpath) == ["Two & more", "p"]
    assert texts(page, "//li[@id='x' and @id]//a[text()='One']", s.xpath) == ["One"] and texts(page, "//*[contains(concat(' ', normalize-space(@class), ' '), ' a ')]/li[1]", s.xpath) == ["One"]
    assert texts(page, "/li", s.xpath) == [] and s.xpath("//a/@href")[0][1] == "@href" and s.xpath("//a/text()")[0][1] == "own"
    assert texts('<i a="x y" b="">1</i>', "[a~=y][b]") == ["1"] and texts('<i a="x y">1</i>', "[a*='']") == []
    for bad in ("", ">", "a >", "a b,", "p:hover", "a[", "..x", "li:nth-child(x)", "a:not(b c)"):
        with pytest.raises(ValueError):
            s.css(bad)
    for bad in ("", "p", "//p[", "//p[foo()]", "//a/@href/b", "//li[@a][2]", "/"):
        with pytest.raises(ValueError):
            s.xpath(bad)


def naive(n, steps):
    """Nodes where a chain ends, by trying every way up."""

    def reaches(i, k):
        if not n.passes(i, steps[k]):
            return False
        axis, p = steps[k].axis, n.parent[i]
        if k == 0:
            return axis == " " or p < 0
        elder = [j for j in range(i) if n.parent[j] == p]
        up = [p] if p >= 0 else []
        while up and n.parent[up[-1]] >= 0:
            up.append(n.parent[up[-1]])
        from_ = {" ": up, ">": up[:1], "+": elder[-1:], "~": elder}[axis]
        return any(reaches(j, k - 1) for j in from_)

    return [i for i in range(len(n.tag)) if reaches(i, len(steps) - 1)]


def test_one_pass_equals_a_naive_matcher():
    rng = random.Random(3)
    tags = "div p ul li a b".split()
    for _ in range(60):
        page = "".join(rng.choice([f'<{rng.choice(tags)} class="{rng.choice("xyz")}">', f"</{rng.choice(tags)}>", "t"]) for _ in range(60))
        n = nodes(page)
        step = lambda: rng.choice([*tags, "*", ".x", ".y", "li.z", "a:first-child", "b:last-child", "p:nth-child(2n)"])
        rules = ["".join([step(), *(rng.choice([" ", " > ", " + ", " ~ "]) + step() for _ in range(rng.randrange(4)))]) for _ in range(8)]
        chains = [s.css(r)[0][0] for r in rules]
        assert s.Automaton(chains).run(n) == [naive(n, chain) for chain in chains]


RULE = "domain string, rule long, field string, xpath string, css string, regex string, is_active boolean"


def test_rules_of_a_domain(spark):
    page = "<h1>Big <b>Shoe</b></h1><div class=price>now $12.50</div><a class=buy href='/buy'>Buy</a><ul>" + "".join(f"<li>item {i % 30}</li>" for i in range(40)) + "</ul>"
    pages = spark.createDataFrame([(1, "a.com", page), (2, "b.com", page), (3, None, page), (4, "a.com", None), (5, "a.com", "<h1>"), (1, "a.com", page)], "id long, domain string, html string")
    rules = spark.createDataFrame([
        ("a.com", 1, "title", "//h2", "h1", None, True), ("a.com", 2, "price", "//div[@class='price']", "h1", r"\$([0-9.]+)", None), ("a.com", 3, "url", None, "a.buy", None, True), ("a.com", 4, "x", "//p[", "p:hover", "(", True),
        ("a.com", 5, "any", None, "li", None, True), ("a.com", 6, "raw", None, None, r"class=(\w+)", True), ("a.com", 7, "off", None, "h1", None, False), ("c.com", 8, "title", None, "h1", None, True), ("a.com", 9, "bad", None, None, "(", True), ("a.com", 10, "slow", None, "h1", "(?:a+)+$", True),
    ], RULE)
    trees = tree.page_trees(pages, "id", keep=("domain", "html"))
    out = s.apply_rules(trees, rules, "id").collect()
    one = {}
    for r in out:
        if r.id == 1 and r.value is not None:
            one.setdefault((r.rule, r.kind), []).append(r.value)
    twice = lambda v: v * 2  # noqa: E731  (the page stands in the table twice)
    assert one[1, "css"] == twice(["Big Shoe"]) and one[2, "xpath"] == twice(["12.50"]) and one[3, "css"] == twice(["/buy"]) and one[6, "regex"] == twice(["price", "buy"])
    assert one[5, "css"] == twice([f"item {i}" for i in range(12)]) and {r.id for r in out} == {1, 4, 5}
    assert {(r.rule, r.problem) for r in out if r.problem} == {(4, "malformed xpath"), (4, "malformed css"), (9, "malformed regex")}
    first = {(r.id, r.field): (r["values"], r.rules) for r in s.first_values(s.apply_rules(trees, rules, "id"), "id").collect()}
    assert first[1, "title"] == (["Big Shoe"], [1]) and (5, "title") not in first
    assert s.apply_rules(trees, spark.createDataFrame([], RULE), "id").collect() == []


def test_node_rows(spark):
    pages = spark.createDataFrame([("k", "<p>a<b>b</b></p><p>c"), (None, None)], "id string, html string")
    rows = tree.node_rows(tree.page_trees(pages, "id", keep=()), "id").collect()
    assert [(r.node, r.parent, r.last, r.tag, r.value) for r in rows] == [(0, -1, 1, "p", "a b"), (1, 0, 1, "b", "b"), (2, -1, 2, "p", "c")]


def test_option_groups_and_existing_combinations(spark):
    """Existing variants against brute force over the product of the axes."""
    import itertools

    from millrace.sources import options

    rng, pages, known, want = random.Random(9), [], [], set()
    axes = {"color": ["Red", "Blue", "Teal"], "size": ["5", "6", "7"], "fit": ["Slim", "Wide"]}
    for page in range(12):
        shown = {a: rng.sample(v, rng.randrange(2, len(v) + 1)) for a, v in axes.items() if rng.random() < 0.8}
        gone = {(a, v) for a, vs in shown.items() for v in vs if rng.random() < 0.2}
        html = "".join(f"<select name='{a}'><option value=''>Choose {a}" + "".join(f"<option{' disabled' * ((a, v) in gone)}>{v}{' Regular' * (a == 'size')}" for v in vs) + "</select>" for a, vs in shown.items())
        pages.append((page, html))
        real = [c for c in itertools.product(*axes.values()) if rng.random() < 0.4]
        for ord_, combo in enumerate(real):
            o = dict(zip(axes, combo, strict=True))
            known.append((page, ord_, {k.upper(): v.lower() for k, v in o.items()}, rng.random() < 0.9))
            if all(o[a] in vs for a, vs in shown.items()):
                want.add((page, ord_, known[-1][3] and not any((a, o[a]) in gone for a in shown)))
    p = spark.createDataFrame([*pages, (90, "<ul role=listbox aria-label=Color><li role=option>A<li role=option aria-disabled=true>B</ul>"), (91, ""), (92, None), (93, "<select name=size><option>1<option>2</select><select name=color><option>1<option>2</select>")], "id long, html string")
    found = options.option_rows(tree.page_trees(p, "id", keep=()), "id")
    out = options.existing_variants(found, spark.createDataFrame(known, "id long, ord int, options map<string,string>, available boolean"), "id").collect()
    assert {(r.id, r.ord, r.available) for r in out if r.id < 90} == want
    assert sorted((r.options["color"], r.available) for r in out if r.id == 90) == [("A", True), ("B", False)] and {r.id for r in out if r.id > 90} == set()


def test_sizes_with_and_without_suffix_are_one_choice(spark):
    from millrace.operators import variants

    rows = spark.createDataFrame([(1, 0, {"Size": "5 Regular"}), (1, 1, {"sizes": "5"}), (1, 2, {"size": "6"})], "p int, ord int, options map<string,string>")
    assert [(r.axis, r["values"]) for r in variants.axes(rows, "p").collect()] == [("size", ["5", "6"])]


def test_cards(spark):
    from millrace.sources import listing

    def cards(html):
        return [(e[2], e[3], e[5]) for e in listing._entries(html) if e[0] == "cards"]

    assert cards("<ul>" + "".join(f"<li><div><a href=/{i}>One {i}</a></div><div>${i}</div></li>" for i in (1, 2)) + "</ul>") == [("/1", "One 1", "One 1 $1"), ("/2", "One 2", "One 2 $2")]
    assert cards("<main>" + "".join(f"<a href=/{i}><div><h3>T{i}</h3></div></a>" for i in (1, 2)) + "</main>") == [("/1", "T1", "T1"), ("/2", "T2", "T2")]
    assert cards("<ul><li><a href=/1>a<li><a href=/2>b</ul>") == [("/1", "a", "a"), ("/2", "b", "b")]
    swatches = "".join(f"<div class=card><a href=/p/{i}><img src=i.png></a><h3>Shoe {i}</h3><div class=sw><a href=/p/{i}?c=1>r</a><a href=/p/{i}?c=2>b</a></div><b>$5</b></div>" for i in (1, 2))
    assert [c[:2] for c in cards(f"<div class=grid>{swatches}</div>")] == [("/p/1", "Shoe 1"), ("/p/2", "Shoe 2")]
    assert cards("<nav><li><a href=/n>n</a><li><a href=/m>m</a></nav><div><p><a href=/x>only</a> $3</p></div>") == [("/x", "only", "only $3")]
    pages = spark.createDataFrame([(1, "http://s.com/l", "<ul>" + "".join(f"<li><div><a href=/p/{i}000>Thing no {i}</a></div><div>$ {i}.50</div></li>" for i in (1, 2)) + "</ul>"), (2, "http://s.com/", None), (3, None, "<a href=/p/1>x</a>")], "id long, url string, html string")
    assert sorted((r.id, r.title, r.price) for r in listing.listing_records(pages, "id").collect()) == [(1, "Thing no 1", 1.5), (1, "Thing no 2", 2.5)]


def test_scope_views_and_images(spark):
    from millrace.sources import views

    page = "<h1>Red Shoe</h1><p>only $5"
    nested = "<body><div id=a><div id=b><h2>x</h2><h1>Shoe</h1></div><p>$7.50</div><p>add to bag"
    many = "<body><div><h1>Shoe</h1><p>$3</p></div>" + "<p>l</p>" * 300 + "add to cart"
    pages = spark.createDataFrame([(1, page, "u"), (2, nested, "u"), (3, many, "u"), (4, "no heading $9", None), (5, None, None), (6, "<script type='application/ld+json'>{</script><h1></h1>", "u")], "id long, html string, url string")
    trees = tree.page_trees(pages, "id")
    scope = {r.id: r for r in views.product_scope(trees, "id").collect()}
    assert scope[1].scope == ["Red Shoe", "only $5"] and scope[2].scope == ["x", "Shoe", "$7.50", "add to bag"] and scope[3].scope == ["Shoe", "$3"] and scope[4].scope == ["no heading $9"] and scope[5].scope == []
    human = {r.id: r.human for r in views.human_view(views.product_scope(trees, "id"), "id").collect()}
    assert human == {1: {"name": "Red Shoe", "price": "5"}, 2: {"name": "Shoe", "price": "7.50"}, 3: {"name": "Shoe", "price": "3"}, 4: {"price": "9"}, 5: {}, 6: {}}
    assert {r.id: r.agent for r in views.agent_view(trees, "id").collect()} == {i: {} for i in range(1, 7)}
    assert views.page_images(trees, "id").collect() == []


def test_microdata_posts_and_bodies(spark):
    import json

    from millrace.sources import bodies

    deep = "<div itemscope itemprop=x>" * 3_000
    pages = spark.createDataFrame([
        (1, "<div itemscope itemtype=http://schema.org/Product><a itemprop='url name' href=/u>t</a><img itemprop=image src=1.png><img itemprop=image src=2.png><time itemprop=d datetime=2024>x</time><div itemprop=o itemscope><meta itemprop=p content=5></div></div><p itemprop=lost>y</p>"),
        (2, deep), (3, None), (4, "<div class=post><div class=comment>inner <span class=author>a</span></div></div><div class=Post></div><div class=post-list><div class='message x'>m"),
        (5, "<meta name=author content='Meta Name'><main>short</main><article><p>long enough text<p>more</article>"), (6, "plain <b>text</b>"),
    ], "id long, html string")
    trees = tree.page_trees(pages, "id", keep=())
    found = {r.id: json.loads(r.payload) for r in bodies.microdata(trees, "id").collect()}
    assert found == {1: {"@type": "Product", "url": "/u", "name": "/u", "image": ["1.png", "2.png"], "d": "2024", "o": {"@type": "", "p": "5"}}}
    assert [(r.id, r.ord, r.author, r.body) for r in bodies.posts(trees, "id").orderBy("id", "ord").collect()] == [(4, 0, "a", "inner a"), (4, 1, None, "m")]
    got = {r.id: (r.author, r.body, r.paragraphs) for r in bodies.article_bodies(trees, "id").collect()}
    assert got[5] == ("Meta Name", "long enough text more", ["long enough text", "more"]) and got[6] == (None, "plain text", []) and got[3] == (None, None, [])
