"""Page classes, robots rules, enrichment and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import url as u
from millrace.operators import classify, enrich
from millrace.sources import html, listing

from .registry import parts, query, table

c = F.concat


def lit(x):
    return F.lit(x)


@query("page_classes", """select p_partkey, case p_partkey % 7 when 0 then 'auth' when 1 then 'blocked' when 2 then 'blocked' when 3 then 'blocked' when 4 then 'suspect' when 5 then 'open' else 'open' end as state,
  case p_partkey % 9 when 0 then 'cloudflare' when 2 then 'datadome' when 3 then 'datadome' when 5 then 'sucuri' when 6 then 'akamai' when 7 then 'perimeterx' when 8 then 'datadome' end as guard, case p_partkey % 4 when 0 then 'shopify' when 1 then 'woocommerce' when 2 then 'generic_jobs' else 'generic_commerce' end as family from part""")
def page_classes(spark, d):
    k, g = F.col("p_partkey") % 7, F.col("p_partkey") % 4
    status = F.when(k == 0, 401).when(k == 1, 429).otherwise(200)
    body = F.when(k == 2, "<p>Are you a robot?</p>").when(k.isin(3, 4), "<p>Please wait</p>").when(k == 5, c(lit("captcha "), F.repeat(lit("word "), 200))).otherwise("<p>shoes</p>")
    # by turns: a challenge, the same header without one, a server, a header of its own, another server, ...
    each = [("cf-mitigated", "Challenge"), ("cf-mitigated", "none"), ("server", "DataDome"), ("x-datadome-cid", "1"), ("server", "Cloudflare"), ("x-sucuri-cache", ""), ("akamai-grn", "0.1"), ("x-px-block", "1"), ("x-datadome", "")]
    headers = F.element_at(F.array(*(F.create_map(lit(n), lit(v), lit("date"), lit("now")) for n, v in each)), (F.col("p_partkey") % 9 + 1).cast("int"))
    link = F.when(g == 0, "https://a.myshopify.com/p").when(g == 2, "https://x.example.com/jobs/1234").otherwise("https://x.example.com/")
    page = F.when(g == 1, "<link href='/wp/WooCommerce.css'>").otherwise("")
    return table(spark, d, "part").select("p_partkey", classify.blocked(body, status, F.when(k == 3, "Just a moment..."), F.size(F.split(body, " "))).alias("state"), classify.guard(headers).alias("guard"), classify.platform(link, page).alias("family"))


@query("open_pages", r"""with p as (select page_id, contains(html, '</body>') m, regexp_replace(regexp_replace(html, '(?s)<(script|style|title)>.*?</(script|style|title)>|<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g') x from pages),
 n as (select page_id, len(regexp_extract_all(x, '[^\s]+')) + case when not m or page_id % 4 = 0 then 0 when page_id % 4 = 3 then 2 else 3 end n, m, page_id % 4 k from p)
 select page_id, case when n >= 150 or k = 0 or k < 3 and not m then 'open' when k = 2 or not m then 'suspect' else 'blocked' end as state from n""")
def open_pages(spark, d):
    """The stored pages as they are, or with a strong mark, a weak one, or a weak one under such a title:
    marks count on short pages only."""
    k = F.col("page_id") % 4
    mark = F.when(k == 1, "<p>unusual traffic here</p>").when(k == 2, "<p>Please wait here</p>").when(k == 3, "<p>Please wait</p>").otherwise("")
    made = F.replace("html", lit("</body>"), c(mark, lit("</body>")))
    pages = table(spark, d, "pages").select("page_id", "url", F.when(k == 3, F.regexp_replace(made, "<title>", "<title>Just a moment ")).otherwise(made).alias("html"))
    p = html.parse_pages(pages, "page_id").join(pages.select("page_id", "html"), "page_id")
    words = F.size(F.split(F.trim("text"), r"\s+"))
    return p.select("page_id", classify.blocked(F.col("html"), F.lit(200), F.col("title"), words).alias("state"))


@query("crawlable_urls", """select p_partkey, case when p_partkey % 3 = 0 then p_partkey % 5 in (0, 3) when p_partkey % 3 = 1 then p_partkey % 5 <> 2 else true end as allowed from part""")
def crawlable_urls(spark, d):
    """Two hosts have rules, one names this agent; the third has none."""
    files = spark.createDataFrame(
        [("h0.example.com", "# all\nUser-agent: *\nDisallow: /\n\nUser-agent: Mill\nUser-agent: other\nDisallow: /p/\nAllow: /p/0\nDisallow: /*.pdf$\nDisallow:\n"), ("h1.example.com", "User-agent: *\r\nDisallow: /p/2\r\nAllow: /p/2x\r\n\r\nUser-agent: bad\r\nDisallow: /")],
        "host string, body string",
    )
    k = F.col("p_partkey") % 5
    at = c(lit("https://h"), (F.col("p_partkey") % 3).cast("string"), F.when(k == 3, ".example.com/q?x=1").when(k == 4, ".example.com/a.pdf").otherwise(c(lit(".example.com/p/"), k.cast("string"))))
    urls = parts(spark, d).select("p_partkey", at.alias("url"))
    return classify.crawlable(urls, "p_partkey", "url", classify.robots_rules(files, "host", "body"), "host", "Mill")


@query("host_policies", """with e as (select 'm' || (user_id % 20) host, event_type = 'error' b, ts from events), f as (select host, max(ts) filter (not b) t from e group by 1), p as (select e.host, count(*) n, max(ts) l from e join f using (host) where b and (t is null or ts > t) group by 1), m as (select max(ts) now from events)
  select f.host, coalesce(n, 0)::bigint as failures, coalesce(l >= now - interval 6 hour, false) as protected, coalesce(case when l >= now - interval 6 hour then pow(2, least(n, 6) - 1) end, 0)::bigint as wait_minutes from f left join p using (host), m""")
def host_policies(spark, d):
    e = table(spark, d, "events")
    o = e.select(c(lit("m"), (F.col("user_id") % 20).cast("string")).alias("host"), (F.col("event_type") == "error").alias("blocked"), "ts")
    return classify.host_policies(o, "host", "ts", e.agg(F.max("ts")).scalar(), ttl_minutes=360)


@query("selector_values", "select page_id, regexp_extract(html, '<h1>([^<]*)', 1) <> '' as named, least(12, len(list_distinct(regexp_extract_all(html, '<a href=\"/([^\"]+)\"', 1))))::int as links from pages")
def selector_values(spark, d):
    p = table(spark, d, "pages")
    links = classify.regex_values(F.col("html"), '<a href="/([^"]+)"')
    return p.select("page_id", (F.size(classify.regex_values(F.col("html"), "<h1>([^<]+)")) > 0).alias("named"), F.size(links).alias("links"))


@query("filtered_values", """select p_partkey, case when p_size % 2 = 0 then [p_size::varchar, p_partkey::varchar] else [p_partkey::varchar] end as kept, case when p_size % 3 = 0 then [p_brand] else [p_name, p_brand] end as nodes from part""")
def filtered_values(spark, d):
    size, key, third = F.col("p_size").cast("string"), F.col("p_partkey").cast("string"), F.col("p_size") % 3 == 0
    xml = c(lit("<r><i> "), F.when(third, " ").otherwise(F.col("p_name")), lit(" </i><i/><j><i>"), F.col("p_brand"), lit("</i></j></r>"))
    found = F.array(c(F.when(F.col("p_size") % 2 == 0, "size ").otherwise("sizes "), size), F.col("p_name"), c(lit("x size "), key, lit(" size 0")))
    return table(spark, d, "part").select("p_partkey", classify.kept_by_regex(found, "size ([0-9]+)").alias("kept"), classify.xpath_values(xml, "//i/text()").alias("nodes"))


@query("size_attributes", """select p_partkey, case when p_size % 2 = 0 then ['L', 'XL', p_size || 'CM'] else [p_size::varchar, p_size || 'US'] end as sizes, case when p_size % 2 = 0 then 'mixed' else 'numeric' end as system,
  p_size % 2 = 0 or p_size > 9 as plausible, case when p_size % 2 = 0 then ['women', 'kids'] when p_size % 3 = 0 then ['men'] end as audience, 'soft ' || p_name || ' shirt, ,' as material, p_size % 3 = 0 and p_size % 5 = 0 as conflict from part""")
def size_attributes(spark, d):
    size, even, third = F.col("p_size").cast("string"), F.col("p_size") % 2 == 0, F.col("p_size") % 3 == 0
    found, system = enrich.sizes(F.when(even, F.array(lit("Size: large"), lit("xl"), lit("L"), F.col("p_name"), c(size, lit(" cm")))).otherwise(F.array(c(lit("SIZE = "), size), F.col("p_brand"), c(size, lit(" us")), size)))
    audience = enrich.allowed_values(F.when(even, F.array(lit("For Women & kids"), lit("women"))).when(third, F.array(lit("womens"), lit("Men's"))).otherwise(F.array(lit("all"), F.col("p_name"))), ["men", "women", "kids"])
    tokens = F.when(third, F.array(lit("pet"), lit("bowl"))).otherwise(F.array(lit("bowl"), F.col("p_brand")))
    return parts(spark, d).select(
        "p_partkey", found.alias("sizes"), system.alias("system"), enrich.plausible_size(F.when(even, c(size, lit(".5 us"))).otherwise(F.when(F.col("p_size") > 9, size).otherwise(c(lit("about "), size)))).alias("plausible"), audience.alias("audience"),
        enrich.without_material_context(c(lit("Soft "), F.col("p_name"), lit(" shirt, feels like silk, without wool"))).alias("material"),
        enrich.context_conflict(tokens, F.when(F.col("p_size") % 5 == 0, "Apparel > Women > Shoes").otherwise("Animals > Bowls")).alias("conflict"),
    )


@query("material_context", "select p_partkey, 'cotton ' || p_name || ' and' as material from part")
def material_context(spark, d):
    return table(spark, d, "part").select("p_partkey", enrich.without_material_context(c(lit("Cotton "), F.col("p_name"), lit(" feels like silk and no wool PVC-free faux fur"))).alias("material"))


@query("known_brands", """with b as (select distinct p_brand, lower(p_brand) l from part) select p_partkey, case when p_partkey % 3 = 0 then null else p_brand end as brand, case p_partkey % 4 when 0 then replace(p_brand, '#', ' ') when 2 then 'New Balance' end as by_url from part""")
def known_brands(spark, d):
    p = table(spark, d, "part")
    titled = p.select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).otherwise(c(F.col("p_name"), lit(" by "), F.upper("p_brand"), lit("!"))).alias("title"))
    found = enrich.known_brand(titled, "p_partkey", "title", p, "p_brand")
    k, slug = F.col("p_partkey") % 4, F.replace("p_name", lit(" "), lit("-"))
    # a brand and a number after it; a brand in an inner part; the title alone; five words before it
    link = (
        F.when(k == 0, c(lit("https://x.example.com/p/"), F.replace(F.lower("p_brand"), lit("#"), lit("-")), lit("-"), slug, lit("-1.html"))).when(k == 2, c(lit("https://x.example.com/new-balance-"), slug, lit("/item-1")))
        .when(k == 1, c(lit("https://x.example.com/p/"), slug)).otherwise(c(lit("https://x.example.com/a-b-c-d-e-"), slug))
    )
    return found.join(p.select("p_partkey", enrich.brand_from_url(link, F.col("p_name")).alias("by_url")), "p_partkey")


@query("record_identities", """select p_partkey, p_partkey % 3 <> 2 as same, p_partkey % 2 = 1 as mismatch, [('"S' || (p_partkey + 1000) || '" -site:x.example.com'), p_brand || ' ' || p_name || ' -site:x.example.com', p_brand || ' ' || p_name] as queries from part""")
def record_identities(spark, d):
    k, key = F.col("p_partkey") % 3, (F.col("p_partkey") + 1000).cast("string")
    page = F.when(k == 0, c(lit("https://x.example.com/p/abc"), key)).otherwise("https://x.example.com/p/very-red-shoe")
    link = F.when(k == 0, c(lit("https://y.example.com/item/abc"), key)).otherwise("https://y.example.com/item")
    title = F.when(k == 1, "Red shoe").otherwise("Blue shoe")
    other = F.when(F.col("p_partkey") % 2 == 0, c(F.col("p_name"), lit(" new"))).otherwise("entirely different words")
    return parts(spark, d).select(
        "p_partkey", enrich.same_identity(page, link, title).alias("same"), enrich.overlap_mismatch(F.col("p_name"), other).alias("mismatch"),
        enrich.search_queries(F.col("p_brand"), F.col("p_name"), c(lit("S"), key), lit("x.example.com")).alias("queries"),
    )


@query("result_scores", """select p_partkey, case p_partkey % 3 when 0 then 1.0 when 1 then round(0.5 * n / (n + 1) + 0.15, 4) else 0.0 end::double as score from (select *, len(list_distinct(string_split(p_name, ' '))) n from part)""")
def result_scores(spark, d):
    k, dollars = F.col("p_partkey") % 3, c(lit("$"), F.col("p_retailprice").cast("decimal(12,2)").cast("string"))
    own = F.struct(*(v.alias(n) for n, v in enrich.snapshot({"title": F.col("p_name"), "brand": F.col("p_brand"), "price": dollars}, lit("https://x.example.com/p/1")).items()))
    link = F.when(k == 0, "https://www.shop.example/p/1234").when(k == 1, "https://shop.example/about").otherwise("https://x.example.com/p/1")
    found = F.struct(*(v.alias(n) for n, v in enrich.snapshot({"title": F.when(k == 1, c(F.col("p_name"), lit(" zz"))).otherwise(F.col("p_name")), "brand": F.when(k == 0, F.lower("p_brand")).otherwise("other"), "price": dollars}, link).items()))
    t = table(spark, d, "part").select("p_partkey", own.alias("a"), found.alias("b"), u.detail_like(link).alias("detail"))
    return t.select("p_partkey", enrich.result_score(F.col("a"), F.col("b"), F.col("detail"), F.col("a.domain") == F.col("b.domain")).alias("score"))


@query("schema_scores", """with k as (select *, p_partkey % 2 = 0 a, p_partkey % 3 = 0 b, p_partkey % 5 = 0 e from part)
 select p_partkey, floor((3 + a::int + b::int - e::int) * 100 / 10)::int as completeness, list_concat(case when e then ['name'] else [] end, case when a then [] else ['image'] end, case when b then [] else ['offers.availability'] end) as missing,
  case when e then [] when p_size < 20 then [] else [p_name] end as only_agents, case when e and p_size < 20 then ['About', p_name] else ['About'] end as only_people from k""")
def schema_scores(spark, d):
    """Products with or without a name, an image and an availability; those of small size show their name to people too."""
    k = F.col("p_partkey")
    offer = F.struct(F.col("p_retailprice").alias("price"), lit("USD").alias("priceCurrency"), F.when(k % 3 == 0, "InStock").alias("availability"))
    ld = F.to_json(F.struct(lit("Product").alias("@type"), F.when(k % 5 != 0, F.col("p_name")).alias("name"), F.when(k % 2 == 0, "/i.png").alias("image"), offer.alias("offers")))
    pages = parts(spark, d).select("p_partkey", "p_name", "p_size", c(lit('<script type="application/ld+json">'), ld, lit("</script>")).alias("html"))
    rows = html.structured_rows(pages, "p_partkey", url=None).join(pages.drop("html"), "p_partkey")
    score, missing = enrich.schema_score(F.col("payload"))
    shown = F.array_compact(F.array(lit("About"), lit("x"), F.when(F.col("p_size") < 20, F.col("p_name"))))
    hidden, visible = enrich.view_delta(F.array_compact(F.array(F.get_json_object("payload", "$.name"), lit("x"))), shown)
    return rows.select("p_partkey", score.alias("completeness"), missing.alias("missing"), hidden.alias("only_agents"), visible.alias("only_people"))


@query("variant_reports", """select l_partkey as part, count(*) as variants, count(*) > 1 and count(distinct l_returnflag) <= 1 as collapsed, count(*) filter (l_linestatus = 'F') as missing_sku, 0::bigint as missing_availability, case when max(l_linenumber) > 3 then 50 else 25 end as readable from lineitem group by 1""")
def variant_reports(spark, d):
    li = table(spark, d, "lineitem")
    rows = li.select(F.col("l_partkey").alias("part"), F.col("l_returnflag").alias("price"), lit("u").alias("url"), F.when(F.col("l_linestatus") != "F", "s").otherwise(" ").alias("sku"), lit("in_stock").alias("availability"))
    signals = li.groupBy(F.col("l_partkey").alias("part")).agg(F.max("l_linenumber").alias("n"))
    readable = enrich.readability(lit(True), F.col("n") > 3, lit(None).cast("boolean"), lit(False))
    return enrich.variant_report(rows, "part").join(signals.select("part", readable.alias("readable")), "part")


@query("job_sections", """select p_partkey, case when p_size % 2 = 0 then 'Duties' else 'About ' || p_brand end as heading, p_name as body from part union all select p_partkey, 'Pay', p_brand || case when p_size % 3 = 0 then chr(10) || p_size else '' end from part where p_size % 5 <> 0""")
def job_sections(spark, d):
    """Headings that vary, bodies of one part or two, a last section that every fifth size lacks."""
    more = F.when(F.col("p_size") % 3 == 0, c(lit("<p>"), F.col("p_size").cast("string"), lit("</p>"))).otherwise("")
    last = F.when(F.col("p_size") % 5 != 0, c(lit("<h3>Pay</h3><p>"), F.col("p_brand"), lit("</p>"), more)).otherwise("")
    page = c(lit("<h1>Job</h1><h2>"), F.when(F.col("p_size") % 2 == 0, "Duties").otherwise(c(lit("About "), F.col("p_brand"))), lit("</h2><p>"), F.col("p_name"), lit("</p>"), last)
    return listing.sections(html.parse_pages(parts(spark, d).select("p_partkey", page.alias("html")), "p_partkey", url=None), "p_partkey")


@query("listing_links", """select p_partkey, ['https://x.example.com/p/' || p_partkey, 'https://x.example.com/q'] as links from part""")
def listing_links(spark, d):
    """Product URLs of listing rows: the first link field, on the own site, in order."""
    key = F.col("p_partkey").cast("string")
    rows = F.array(*(F.struct(a.alias("url"), b.alias("link")) for a, b in ((c(lit("https://x.example.com/p/"), key), lit("z")), (lit(" "), lit("https://x.example.com/q")), (lit("https://other.example/"), lit(None).cast("string")), (lit(None).cast("string"), c(lit("https://x.example.com/p/"), key)))))
    return table(spark, d, "part").select("p_partkey", listing.own_links(rows, ["url", "link"], lit("https://www.x.example.com/list")).alias("links"))
