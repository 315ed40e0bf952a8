"""Predicates, quality checks, variants, overlays and conversions."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import price, text, values
from millrace.functions import url as u
from millrace.operators import matching, quality

from .registry import RECORDS, query, records, table
from .relational import DOMAIN_SQL

KINDS = {"brand_dtc": ("brand.example",), "retailer": ("example.com",), "marketplace": ("example.net", "example.org")}
PATH_SQL = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1))"
SEGMENTS = "('about','account','cart','checkout','contact','faq','help','login','privacy','register','search','signin','terms','wishlist')"


@query("url_predicates", f"""with p as (select page_id id, url from pages union all select p_partkey + 1000000, case p_partkey % 6 when 0 then 'https://x.example.com/p/' || p_partkey when 1 then 'https://x.example.com/careers/' || (p_partkey + 1000) when 2 then 'https://x.example.com/about/us'
     when 3 then 'javascript:void(0)' when 4 then 'https://x.example.com/jobs/' else 'https://a.b/xhttps://c.d/y' end from part), q as (select *, {PATH_SQL} path from p)
  select id, regexp_matches(lower(url), '^https?://[^\\s/]+') and not regexp_matches(lower(url), '(javascript:|mailto:|/cart(/|$)|/logout)') as safe, len(list_filter(string_split(path, '/'), lambda s: s in {SEGMENTS})) > 0 as utility,
    regexp_matches(path, '/(p|dp|item|product|products|prod|sku|pd)/') or regexp_matches(path, '/[^/]*[0-9]{{3,}}[^/]*/?$') as detail_like,
    regexp_matches(path, '/(job|jobs|career|careers|position|vacancy|opening)s?/') and regexp_matches(path, '[0-9]{{3,}}') as job_posting, len(regexp_extract_all(lower(url), 'https?://')) > 1 as glued from q""")
def url_predicates(spark, d):
    k, key = F.col("p_partkey") % 6, F.col("p_partkey").cast("string")
    made = (
        F.when(k == 0, F.concat(F.lit("https://x.example.com/p/"), key)).when(k == 1, F.concat(F.lit("https://x.example.com/careers/"), F.col("p_partkey") + 1000)).when(k == 2, "https://x.example.com/about/us")
        .when(k == 3, "javascript:void(0)").when(k == 4, "https://x.example.com/jobs/").otherwise("https://a.b/xhttps://c.d/y")
    )
    c = F.col("url")
    both = table(spark, d, "pages").select(F.col("page_id").alias("id"), "url").unionByName(table(spark, d, "part").select((F.col("p_partkey") + 1000000).alias("id"), made.alias("url")))
    return both.select("id", u.safe(c).alias("safe"), u.utility(c).alias("utility"), u.detail_like(c).alias("detail_like"), u.job_posting(c).alias("job_posting"), u.glued(c).alias("glued"))


@query("page_text", r"select page_id, sha256(trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[ \t\n\r\f]+', ' ', 'g'))) as digest from pages")
def page_text(spark, d):
    return table(spark, d, "pages").select("page_id", F.sha2(text.strip_tags(F.col("html")), 256).alias("digest"))


@query("source_types", f"""select page_id, {DOMAIN_SQL.format('url')} as "domain", case when regexp_matches({DOMAIN_SQL.format('url')}, '(^|[.])brand[.]example$') then 'brand_dtc' when regexp_matches({DOMAIN_SQL.format('url')}, '(^|[.])example[.]com$') then 'retailer'
  when regexp_matches({DOMAIN_SQL.format('url')}, '(^|[.])example[.](net|org)$') then 'marketplace' else 'unknown' end as kind from pages""")
def source_types(spark, d):
    p = table(spark, d, "pages").select("page_id", u.domain(F.col("url")).alias("domain"))
    return p.withColumn("kind", matching.source_type(F.col("domain"), KINDS))


@query("variant_axes", f"""with {RECORDS}, a as (select distinct part, flag from records), b as (select distinct part, line_status from records), v as (select part, flag, line_status, min(price) least from records group by all)
  select a.part, a.flag, b.line_status, v.least is not null as offered, v.least from a join b on a.part = b.part left join v on v.part = a.part and v.flag = a.flag and v.line_status = b.line_status""")
def variant_axes(spark, d):
    """Option axes of each part, a row a combination, joined to the variants there are.

    Axes are gathered per part (a few values each), so no two parts' rows meet.
    """
    r = records(spark, d)
    axes = r.groupBy("part").agg(F.collect_set("flag").alias("flags"), F.collect_set("line_status").alias("states"))
    grid = axes.select("part", F.explode("flags").alias("flag"), "states").select("part", "flag", F.explode("states").alias("line_status"))
    real = r.groupBy("part", "flag", "line_status").agg(F.min("price").alias("least"))
    return grid.join(real, ["part", "flag", "line_status"], "left").withColumn("offered", F.col("least").isNotNull())


@query("profile_overlay", """select c_custkey as id, case when c_custkey % 2 = 0 then 'fast' when c_custkey % 3 = 0 then 'slow' else 'auto' end as mode, case when c_custkey % 5 = 0 then '9' else '3' end as retries from customer""")
def profile_overlay(spark, d):
    """Settings by section: explicit over saved over default."""
    k = F.col("c_custkey")
    explicit = F.when(k % 2 == 0, "fast").otherwise("")
    saved = F.when(k % 3 == 0, "slow")
    return table(spark, d, "customer").select(
        k.alias("id"), values.first_present(explicit, saved, F.lit("auto")).alias("mode"), values.first_present(F.when(k % 5 == 0, "9").otherwise(" "), F.lit("3")).alias("retries")
    )


@query("summary_merge", """select c_custkey as id, greatest(c_custkey % 7, c_custkey % 5)::bigint as pages, case when c_custkey % 3 = 0 then 'old' else 'new' end as first_verdict from customer""")
def summary_merge(spark, d):
    """Counters merge by maximum, verdicts by position where the patch isn't empty."""
    k = F.col("c_custkey")
    merged = values.merge_max(F.create_map(F.lit("pages"), k % 7), F.create_map(F.lit("pages"), k % 5))
    verdicts = values.positional_coalesce(F.array(F.lit("old")), F.array(F.when(k % 3 == 0, "").otherwise("new")))
    return table(spark, d, "customer").select(k.alias("id"), merged["pages"].cast("bigint").alias("pages"), F.get(verdicts, F.lit(0)).alias("first_verdict"))


_FAULTS = ("none", "detail_identity_mismatch", "listing_chrome_noise", "thin_detail", "axis_pollution", "variant_price_missing", "price_magnitude_anomaly", "category_pollution", "long_text_pollution", "variant_artifact_pollution", "variant_currency_mismatch", "identifier_shape_pollution", "title_internal_token", "system_artifact_pollution", "repair_diagnostic_missing", "blocked")


@query("quality_checks", f"""with k as (select *, p_partkey % 17 k from part) select p_partkey, case when k = 16 then 'thin_detail' else ([{", ".join(f"'{f}'" for f in _FAULTS)}])[k + 1] end as failure,
  case when k = 0 then 'good' when k = 15 then 'blocked' when k in (3, 4, 5, 16) then 'usable_with_gaps' else 'bad_output' end as verdict, 14 - case when k in (0, 15) then 0 when k = 16 then 2 else 1 end as passed from k""")
def quality_checks(spark, d):
    """A record of each part with one fault, each check's in turn, none, a block, or two that meet."""
    k, none = F.col("p_partkey") % 17, F.lit(None).cast("string")
    when = lambda n, v, other: F.when(k == n, v).otherwise(other)
    variant = lambda color, amount, code: F.struct(F.create_map(F.lit("color"), color).alias("options"), amount.alias("price"), code.alias("currency"))
    red, blue, amount = F.lit("Red"), F.lit("Blue"), F.col("p_retailprice").cast("double")
    usd, no = F.lit("USD"), F.lit(None).cast("double")
    bare = F.struct(F.create_map().cast("map<string,string>").alias("options"), amount.alias("price"), usd.alias("currency"))
    two = F.array(variant(red, amount, usd), variant(blue, amount, usd))
    variants = (
        F.when(k.isin(3, 16), F.array(variant(red, amount, usd))).when(k == 4, F.array(variant(red, amount, usd), bare)).when(k == 5, F.array(variant(red, no, usd), variant(blue, no, none)))
        .when(k == 9, F.array(variant(F.lit("Select color"), amount, usd), variant(blue, amount, usd))).when(k == 10, F.array(variant(red, amount, F.lit("EUR")), variant(blue, amount, usd))).otherwise(two)
    )
    listed = F.array(F.struct(F.lit("A fine thing").alias("title"), when(2, F.lit("https://x.example.com/cart"), F.lit("https://x.example.com/p/thing-12345")).alias("url")))
    asks = ("variant_presence_ok", "variant_labels_ok", "variant_price_ok", "price_sane_ok", "repair_diagnostics_ok", "listing_noise_ok")
    # a record without a price fails only the check of variant prices: its sanity is not asked for then
    required = F.create_map(*(x for n in asks for x in (F.lit(n), (k != 5) if n == "price_sane_ok" else F.lit(True))))
    rows = table(spark, d, "part").select(
        "p_partkey", F.lit("ecommerce_detail").alias("surface"), (k == 15).alias("blocked"), required.alias("required"), F.when(k == 1, "404").when(k == 12, "Default Title").otherwise(F.col("p_name")).alias("title"),
        F.when(k == 5, no).when(k == 6, amount + 1_000_000).otherwise(amount).alias("price"), usd.alias("currency"), when(7, F.lit("https://x.example.com/c"), F.col("p_type")).alias("category"),
        F.when(k.isin(8, 16), "Soft <div>").otherwise(F.col("p_name")).alias("description"), when(13, F.lit("copy-1"), F.lit("S1")).alias("sku"), when(11, F.lit("12x"), F.lit("12345678")).alias("barcode"), none.alias("gender"),
        F.col("p_type").alias("product_type"), listed.alias("listing_rows"), variants.alias("variants"), F.when(k != 14, F.array(F.lit("two places"))).alias("repairs"),
    )
    out = quality.checked(rows)
    return out.select("p_partkey", "failure", "verdict", F.size(F.filter(F.map_values("checks"), lambda x: x)).alias("passed"))


@query("conversions", """select p_partkey as id, case p_partkey % 3 when 0 then 'true' when 1 then 'false' else 'maybe' end as flag, 'USD ' || p_size || case when p_partkey % 2 = 0 then ' - ' || (p_size + 10) else '' end || ' YEAR' as salary,
  (1000 + p_size)::bigint as replies from part""")
def conversions(spark, d):
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    word = F.when(k % 3 == 0, " Yes").when(k % 3 == 1, "0").otherwise("maybe ")
    most = F.when(k % 2 == 0, F.col("p_size") + 10).otherwise(F.col("p_size"))
    said = F.concat(F.lit("1,0"), F.lpad(size, 2, "0"), F.lit(" Replies, 3 views"))
    return table(spark, d, "part").select(
        k.alias("id"), price.to_bool(word).alias("flag"), price.salary_text(F.lit("USD"), F.col("p_size"), most, F.lit("YEAR")).alias("salary"), text.count_before(said, "replies").alias("replies")
    )


@query("conversation_stats", "select role, count(*) as turns, count(distinct conv_id) as conversations, max(turn) as last_turn, sum(len(regexp_extract_all(coalesce(text, ''), '[\\p{L}\\p{N}_]+')))::bigint as words from conversations group by 1")
def conversation_stats(spark, d):
    c = table(spark, d, "conversations")
    return c.groupBy("role").agg(F.count("*").alias("turns"), F.count_distinct("conv_id").alias("conversations"), F.max("turn").alias("last_turn"), F.sum(text.word_count(F.col("text"))).alias("words"))


@query("feedback_coverage", "select coalesce(source, 'none') as source, count(*) as documents, count(quality) as labelled, coalesce(sum(quality), 0)::bigint as good from documents left join labels using (doc_id) group by 1")
def feedback_coverage(spark, d):
    j = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels"), "doc_id", "left")
    return j.groupBy(F.coalesce("source", F.lit("none")).alias("source")).agg(F.count("*").alias("documents"), F.count("quality").alias("labelled"), F.coalesce(F.sum("quality"), F.lit(0)).cast("bigint").alias("good"))
