"""URL resolution and field coercion."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import coerce, price
from millrace.functions import url as u
from millrace.sources import html

from .registry import parts, query, stored_pages, table

PAGE = "https://shop.example.co.uk/a/b/page.html?x=1"


@query("page_link_urls", r"""with l as (select page_id, url, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) h from pages)
  select page_id, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || h as link, true as own_site from l""")
def page_link_urls(spark, d):
    """All links of the stored pages, as found, resolved against their page."""
    p = html.parse_pages(stored_pages(spark, d).select("page_id", "html"), "page_id", url=None)
    rows = html.link_rows(p, "page_id").join(table(spark, d, "pages").select("page_id", "url"), "page_id")
    link = u.absolute(F.col("url"), F.col("href"))
    return rows.select("page_id", link.alias("link"), u.same_site(F.col("url"), link).alias("own_site"))


@query("resolved_urls", f"""with p as (select p_partkey k, p_partkey % 8 m from part) select k as p_partkey, case m when 0 then 'https://shop.example.co.uk/p/' || k when 1 then 'https://shop.example.co.uk/a/p/' || k || '?y=2&z=3'
   when 2 then 'https://cdn.example.org/' || k when 3 then '{PAGE}#' || k when 4 then 'https://shop.example.co.uk/a/b/page.html?p=' || k when 5 then 'https://other.example.com/' || k when 6 then 'mailto:a@b.c' else 'https://shop.example.co.uk/a/b/p' || k || '.html' end as link,
   m in (0, 1, 3, 4, 7) as own_site from p""")
def resolved_urls(spark, d):
    k, key = F.col("p_partkey") % 8, F.col("p_partkey").cast("string")
    link = (
        F.when(k == 0, F.concat(F.lit(" /p/"), key)).when(k == 1, F.concat(F.lit("../p/./"), key, F.lit("?y=2&amp;z=3"))).when(k == 2, F.concat(F.lit("//cdn.example.org/"), key)).when(k == 3, F.concat(F.lit("#"), key))
        .when(k == 4, F.concat(F.lit("?p="), key)).when(k == 5, F.concat(F.lit("other.example.com/"), key)).when(k == 6, "mailto:a@b.c").otherwise(F.concat(F.lit("p"), key, F.lit(".html")))
    )
    t = table(spark, d, "part").select("p_partkey", u.absolute(F.lit(PAGE), link).alias("link"))
    return t.select("p_partkey", "link", u.same_site(F.lit(PAGE), F.col("link")).alias("own_site"))


@query("urls_in_text", """select p_partkey, case p_partkey % 4 when 0 then ['https://a.example.com/' || p_partkey, 'http://b.example.com/x'] when 1 then ['https://shop.example.co.uk/img/' || p_partkey || '.png'] else [] end as urls from part""")
def urls_in_text(spark, d):
    k, key = F.col("p_partkey") % 4, F.col("p_partkey").cast("string")
    t = F.when(k == 0, F.concat(F.lit("see https://a.example.com/"), key, F.lit(". or http://b.example.com/x, HTTPS://a.example.com/"), key, F.lit(" https://a.example.com/"), key)).when(k == 1, F.concat(F.lit("/img/"), key, F.lit(".png"))).when(k == 2, "https://a.bhttps://c.d").otherwise("/img/{{id}}.png")
    return table(spark, d, "part").select("p_partkey", u.found_in(t, F.lit(PAGE)).alias("urls"))


@query("canonical_urls", """select p_partkey, 'https://x.example.com/p/' || p_partkey || case p_partkey % 3 when 0 then '?q=1' when 1 then '' else '#top' end as url, case p_partkey % 4 when 0 then 'GBP' when 1 then 'EUR' when 2 then 'INR' end as hint,
   case p_partkey % 4 when 0 then 'example.co.uk' when 1 then 'example.com' when 2 then 'example.in' else '10.0.0.1' end as site from part""")
def canonical_urls(spark, d):
    k, key = F.col("p_partkey"), F.col("p_partkey").cast("string")
    full = F.concat(F.lit("https://x.example.com/p/"), key, F.when(k % 3 == 0, "?q=1&color=red&utm_source=z").when(k % 3 == 1, "?Size=3").otherwise("#top"))
    page = F.when(k % 4 == 0, "https://www.shop.example.co.uk/p").when(k % 4 == 1, "https://shop.example.com/en-de/p").when(k % 4 == 2, "http://example.in").otherwise("http://10.0.0.1/p")
    return table(spark, d, "part").select("p_partkey", u.canonical_record(full).alias("url"), u.currency_hint(page).alias("hint"), u.registrable(page).alias("site"))


@query("coerced_text", r"""select p_partkey, p_name || chr(10) || p_brand || '/"x"' as decoded, p_name || '; ' || p_brand as joined, p_name || ' ' || p_brand as stripped, p_name || chr(10) || p_brand as blocks,
   p_partkey % 5 < 3 as noise, p_name || '. ' || p_brand || ' is good.' as long_text, case when p_partkey % 2 = 0 then p_type end as option, case when p_partkey % 2 = 0 then p_brand || ', US' else p_brand end as place, [p_name, p_type] as few from part""")
def coerced_text(spark, d):
    n, b, k = F.col("p_name"), F.col("p_brand"), F.col("p_partkey")
    c = F.concat
    noise = F.when(k % 5 == 0, "Read more…").when(k % 5 == 1, "4.5 stars").when(k % 5 == 2, k.cast("string")).otherwise(n)
    return table(spark, d, "part").select(
        "p_partkey", coerce.decode_escapes(c(n, F.lit("\\n"), b, F.lit('\\/\\"x\\u0022'))).alias("decoded"), coerce.coerce_text(c(F.lit('["'), n, F.lit('", "'), b, F.lit('"]'))).alias("joined"),
        coerce.coerce_text(c(F.lit("<p>"), n, F.lit("</p> <b>"), b, F.lit("</b>"))).alias("stripped"), coerce.coerce_long_text(c(F.lit("<p>"), n, F.lit(" </p><p>"), b, F.lit("</p>"))).alias("blocks"), coerce.title_noise(noise).alias("noise"),
        coerce.sanitize_long_text(c(n, F.lit(". Read more now. "), b, F.lit(" is good. "), F.upper(n), F.lit(". "), F.lit("Title\n")), F.lit("title")).alias("long_text"),
        coerce.option_scalar(F.when(k % 2 == 0, c(F.lit(" "), F.col("p_type"), F.lit(" (+$5.00)"))).otherwise("Select size")).alias("option"),
        coerce.location(F.when(k % 2 == 0, c(F.lit('{"addressLocality":"'), b, F.lit('","addressRegion":" ","addressCountry":"US"}'))).otherwise(c(F.lit("Location: "), b))).alias("place"),
        coerce.string_list(F.array(n, F.upper(n), F.lit(" "), F.col("p_type"), F.lit("z")), 2, 60).alias("few"),
    )


@query("coerced_records", """select p_partkey, p_retailprice::decimal(12,2)::varchar as price, 'EUR' as currency, p_brand as brand, 'in_stock' as availability, '4.5' as rating, '1204' as review_count, 'https://shop.example.co.uk/i/' || p_partkey as image_url, 'a; b' as tags, 'x' as kept, null::varchar as dropped from part""")
def coerced_records(spark, d):
    c, key = F.concat, F.col("p_partkey").cast("string")
    amount = F.col("p_retailprice").cast("decimal(12,2)").cast("string")
    raw = {
        "price": c(F.lit('{"value": "'), amount, F.lit('", "unit": "EUR"}')), "currency": F.lit('{"priceCurrency": "eur"}'), "brand": c(F.lit('{"name": " '), F.col("p_brand"), F.lit(' "}')), "availability": F.lit("https://schema.org/InStock"),
        "rating": F.lit('{"ratingValue": "4.5 of 5"}'), "review_count": F.lit("1,204 reviews"), "image_url": c(F.lit("/i/"), key), "tags": F.lit("a, b; A"), "location": F.lit(" "), "other": F.lit("x"),
    }
    m = F.create_map(*(x for k, v in raw.items() for x in (F.lit(k), v)))
    out = parts(spark, d).select("p_partkey", coerce.record(m, [k for k in raw if k != "other"], F.lit(PAGE)).alias("r"))
    return out.select("p_partkey", *(F.col("r")[k].alias(k) for k in raw if k not in ("other", "location")), F.col("r")["other"].alias("kept"), F.col("r")["location"].alias("dropped"))


@query("object_values", """select p_partkey, case when p_size % 2 = 0 then '$5' else p_size::varchar end as price, (p_size + 0.5)::decimal(18,2) as number, p_brand as scalar, map_keys(m) as kept from (select *, map(['brand'], [p_brand]) m from part)""")
def object_values(spark, d):
    size = F.col("p_size").cast("string")
    obj = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit('{"amount": '), size, F.lit(', "formatted": "$5"}'))).otherwise(F.concat(F.lit('{"price": -3, "amount": '), size, F.lit("}")))
    m = F.create_map(F.lit("brand"), F.concat(F.lit(" "), F.col("p_brand")), F.lit("Position"), F.lit("3"), F.lit("x"), F.lit(" "))
    return table(spark, d, "part").select(
        "p_partkey", coerce.price_from_object(obj).alias("price"), coerce.decimal_text(F.concat(size, F.lit(",50"))).alias("number"),
        coerce.scalar_by_keys(F.concat(F.lit('{"label": " ", "name": "'), F.col("p_brand"), F.lit('"}')), ["label", "name"]).alias("scalar"), F.map_keys(coerce.attributes(m)).alias("kept"),
    )


@query("money_repairs", """with p as (select p_partkey, p_partkey % 4 k, p_retailprice::double r, round(p_retailprice * 100)::double cents from part)
  select p_partkey, case k when 2 then cents else r end as parent, case k when 2 then [r, r] else [r, case when k = 1 then 5.0 else r end] end as variants, case when k = 0 then null else r - 1 end as sale_price, case when k = 1 then null else 1.0 end as discount_amount, case when k = 2 then null else 10.0 end as discount_percentage,
   case when k = 3 then 0.0 end as zero, case when k = 0 then '7' else 'q' || k end as listed, case when k % 2 = 0 then 'GBP' else 'USD' end as currency from p""")
def money_repairs(spark, d):
    k, r = F.col("p_partkey") % 4, F.col("p_retailprice").cast("double")
    cents = F.round(r * 100)
    # 0: the parent is in cents; 1: one variant differs; 2: the same from a strict source; 3: a variant is in cents
    parent = F.when(k.isin(0, 2), cents).otherwise(r)
    variants = F.when(k == 1, F.array(r, F.lit(5.0))).when(k == 3, F.array(r, cents)).otherwise(F.array(r, r))
    fixed, each = price.magnitudes(parent, variants, k == 2)
    money = price.valid_discounts(r, F.when(k == 0, r).otherwise(r - 1), r, F.when(k == 1, r + 1).otherwise(F.lit(1.0)), F.when(k == 2, 101.0).otherwise(10.0))
    zero = price.zero_price(F.lit(0.0), k != 3, F.lit(False), F.array(F.lit(0.0)))
    listed = price.listing_price(F.when(k == 0, "7").otherwise(" "), F.when(k % 2 == 0, F.concat(F.lit("q"), k)), F.concat(F.lit("q"), k))
    currency = price.currency_by_url(F.when(k != 0, "USD"), F.lit("GBP"), k == 2)
    return table(spark, d, "part").select("p_partkey", fixed.alias("parent"), each.alias("variants"), *(c.alias(n) for n, c in money.items()), zero.alias("zero"), listed.alias("listed"), currency.alias("currency"))
