"""What a fetched page is: blocked, allowed, of which platform; and how its host is treated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import url as u

#: Response headers that name who guards a site: name, part of the value, guard (fixed values).
GUARDS = (
    ("x-datadome", "", "datadome"), ("x-datadome-cid", "", "datadome"), ("server", "datadome", "datadome"), ("cf-mitigated", "challenge", "cloudflare"), ("x-sucuri-id", "", "sucuri"),
    ("x-sucuri-cache", "", "sucuri"), ("x-akamai-transformed", "", "akamai"), ("akamai-grn", "", "akamai"), ("x-px-block", "", "perimeterx"),
)
#: Words of block pages, of pages that may be one, and of their titles: short lists of our own.
STRONG = "captcha|access denied|are you a robot|verify you are (a )?human|unusual traffic|request blocked"
WEAK = "forbidden|please wait|checking your browser|enable javascript|security check"
TITLES = "access denied|attention required|just a moment|robot check|blocked"
#: Families by domain and by marks in the page: short lists of our own.
DOMAINS = {"myshopify.com": "shopify", "greenhouse.io": "greenhouse", "lever.co": "lever", "myworkdayjobs.com": "workday"}
MARKS = {"shopify": "cdn.shopify.com", "woocommerce": "woocommerce", "magento": "mage/cookies", "nextjs": "__next_data__"}


def guard(headers: Column) -> Column:
    """The first guard that a header map (lower-case names) gives away."""
    out = F
    for name, part, who in GUARDS:
        out = out.when(F.contains(F.lower(F.element_at(headers, F.lit(name))), F.lit(part)), who)
    return out.otherwise(F.lit(None).cast("string"))


def blocked(html: Column, status: Column, title: Column, content_words: Column) -> Column:
    """"auth", "blocked", "suspect" or "open".

    401 is a sign-in wall; 403 and 429 block.  A strong mark blocks, as do a weak one and
    such a title together; but a page of 150 words or more is content.
    """
    text = F.lower(F.coalesce(html, F.lit("")))
    strong, weak, named = text.rlike(STRONG), text.rlike(WEAK), F.lower(F.coalesce(title, F.lit(""))).rlike(TITLES)
    return (
        F.when(status == 401, "auth").when(status.isin(403, 429), "blocked").when(content_words >= 150, "open")
        .when(strong | weak & named, "blocked").when(weak | named, "suspect").otherwise("open")
    )


def robots_rules(files: DataFrame, host: str, body: str) -> DataFrame:
    """(host, agent, allow, prefix, ord): the rules of robots files.

    A group's rules hold for the agents named before them; comments and blank rules go.
    """
    lines = files.select(host, F.posexplode(F.split(F.col(body), r"\r?\n")).alias("ord", "line")).withColumn("line", F.trim(F.regexp_replace("line", "#.*$", ""))).where("line <> ''")
    field, value = F.lower(F.trim(F.split_part("line", F.lit(":"), F.lit(1)))), F.trim(F.regexp_replace("line", "^[^:]*:", ""))
    at = Window.partitionBy(host).orderBy("ord")
    rows = lines.select(host, "ord", field.alias("field"), value.alias("value")).where("field in ('user-agent', 'allow', 'disallow')")
    starts = (F.col("field") == "user-agent") & (F.coalesce(F.lag("field").over(at), F.lit("")) != "user-agent")
    rows = rows.withColumn("group", F.sum(starts.cast("int")).over(at))
    agents = rows.where("field = 'user-agent'").select(host, "group", F.lower("value").alias("agent")).distinct()
    rules = rows.where("field <> 'user-agent' and value <> ''").select(host, "group", "ord", (F.col("field") == "allow").alias("allow"), F.col("value").alias("prefix"))
    return rules.join(agents, [host, "group"]).select(host, "agent", "allow", "prefix", "ord")


def crawlable(urls: DataFrame, key: str, url: str, rules: DataFrame, host: str, agent: str) -> DataFrame:
    """(key, allowed): the longest matching rule of the agent's own group decides, else that
    of "*"; allow wins ties, and a host without rules allows all."""
    own = rules.where(F.col("agent") == agent.lower()).select(host).distinct().withColumn("named", F.lit(True))
    mine = rules.join(own, host, "left").where((F.col("agent") == agent.lower()) | F.col("named").isNull() & (F.col("agent") == "*"))
    at = urls.select(key, u.host(F.col(url)).alias(host), F.concat(u.path(F.col(url)), F.when(u.query(F.col(url)) != "", F.concat(F.lit("?"), u.query(F.col(url)))).otherwise("")).alias("at"))
    # "*" stands for any text and "$" for the end; all else stands for itself
    quoted = F.regexp_replace(F.regexp_replace("prefix", r"([.\\+?^{}()|\[\]])", r"\\$1"), r"\*", ".*")
    hit = at.join(mine.withColumn("like", F.concat(F.lit("^"), quoted)), host).where("at rlike like")
    best = hit.groupBy(key).agg(F.max_by("allow", F.struct(F.length("prefix"), "allow")).alias("allow"))
    return urls.select(key).join(best, key, "left").select(key, F.coalesce("allow", F.lit(True)).alias("allowed"))


def platform(url: Column, html: Column) -> Column:
    """Family by domain, then by marks in the page, then by the kind of URL."""
    out = F
    for domain, name in DOMAINS.items():
        out = out.when(u.domain_matches(u.hostname(url), (domain,)), name)
    for name, mark in MARKS.items():
        out = out.when(F.contains(F.lower(html), F.lit(mark)), name)
    return out.when(u.job_posting(url) | u.job_hub(url), "generic_jobs").otherwise("generic_commerce")


def host_policies(outcomes: DataFrame, host: str, at: str, now: Column, ttl_minutes: int = 60, most: int = 6) -> DataFrame:
    """(host, failures, protected, wait_minutes) from fetch outcomes (``blocked`` true or false).

    A usable fetch resets a host: only blocks after its last one count.  It is protected
    while the last block is younger than the time to live; the wait doubles with each block.
    """
    reset = outcomes.groupBy(host).agg(F.max(F.when(~F.col("blocked"), F.col(at))).alias("last_fine"))
    late = outcomes.where("blocked").join(reset, host).where(F.col("last_fine").isNull() | (F.col(at) > F.col("last_fine")))
    per = late.groupBy(host).agg(F.count("*").alias("failures"), F.max(at).alias("last"))
    fresh = F.col("last") >= now - F.make_interval(mins=F.lit(ttl_minutes))
    out = reset.select(host).join(per, host, "left")
    wait = F.when(fresh, F.pow(F.lit(2), F.least(F.col("failures"), F.lit(most)) - 1).cast("bigint"))
    return out.select(host, F.coalesce("failures", F.lit(0).cast("bigint")).alias("failures"), F.coalesce(fresh, F.lit(False)).alias("protected"), F.coalesce(wait, F.lit(0).cast("bigint")).alias("wait_minutes"))


def regex_values(c: Column, pattern: str, most: int = 12) -> Column:
    """The first non-empty group of each match, or the match, of one text; distinct, capped by the contract of a selector."""
    whole = F.regexp_extract_all(c, F.lit(f"(?s)({pattern})"), F.lit(1))
    groups = F.transform(whole, lambda m: F.coalesce(F.nullif(F.regexp_extract(m, f"(?s){pattern}", 1), F.lit("")), m)) if "(" in pattern.replace("(?:", "") else whole
    return F.slice(F.array_distinct(F.filter(F.transform(groups, lambda g: F.trim(g)), lambda x: x != "")), 1, most)


def kept_by_regex(values: Column, pattern: str, most: int = 12) -> Column:
    """Of each value that matches, the first non-empty group or the match."""
    return F.slice(F.flatten(F.transform(values, lambda v: F.slice(regex_values(v, pattern, 1), 1, 1))), 1, most)


def xpath_values(c: Column, path: str) -> Column:
    """Texts at an XPath of a well-formed page."""
    return F.filter(F.transform(F.xpath(c, F.lit(path)), lambda v: F.trim(v)), lambda v: v != "")
