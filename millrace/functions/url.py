"""URL expressions.  A URL that can't be parsed gives null or empty, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .bind import once

#: Query keys that only track: a short list of our own.
TRACKING_KEYS = ("fbclid", "gclid", "msclkid", "ref", "ref_src", "mc_cid", "mc_eid")
TRACKING_PREFIX = "utm_"
UTILITY = ("about", "account", "cart", "checkout", "contact", "faq", "help", "login", "privacy", "register", "search", "signin", "terms", "wishlist")
DETAIL_MARKS = "/(p|dp|item|product|products|prod|sku|pd)/"
JOB_MARKS = "/(job|jobs|career|careers|position|vacancy|opening)s?/"


def scheme(c: Column) -> Column:
    return F.lower(F.regexp_extract(c, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))


def host(c: Column) -> Column:
    """Host and port, lower case, without user or path."""
    return F.lower(F.regexp_extract(c, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?(?:[^/?#@]*@)?([^/?#]*)", 1))


def domain(c: Column) -> Column:
    """Host without www. and default port: the key of a site."""
    h = host(F.trim(c))
    h = F.when((scheme(F.trim(c)) == "http") & h.endswith(":80"), F.regexp_replace(h, ":80$", "")).when(
        (scheme(F.trim(c)) == "https") & h.endswith(":443"), F.regexp_replace(h, ":443$", "")
    ).otherwise(h)
    return F.regexp_replace(h, r"^www\.", "")


def hostname(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(host(c), ":[0-9]*$", ""), r"^www\.", "")


def path(c: Column) -> Column:
    return F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def query(c: Column) -> Column:
    return F.regexp_extract(c, r"^[^?#]*\?([^#]*)", 1)


def segments(c: Column) -> Column:
    return F.filter(F.split(F.lower(path(c)), "/"), lambda s: s != "")


def special_use(c: Column) -> Column:
    """Hosts that no public site has."""
    return F.coalesce((domain(c) == "") | hostname(c).rlike(r"(^|\.)(localhost|local|test|invalid|internal)$"), F.lit(True))


def same_host(a: Column, b: Column) -> Column:
    return (hostname(a) != "") & (hostname(a) == hostname(b))


def domain_matches(c: Column, domains: tuple[str, ...]) -> Column:
    """Equal to one of the domains, or a subdomain of it."""
    out = F.lit(False)
    for d in domains:
        out = out | (c == d) | c.endswith(f".{d}")
    return out


def strip_tracking(c: Column) -> Column:
    """Drops tracking keys from the query; order and fragment stay."""
    keep = F.filter(F.split(query(c), "&"), lambda kv: (kv != "") & ~F.lower(F.split_part(kv, F.lit("="), F.lit(1))).isin(*TRACKING_KEYS) & ~F.lower(kv).startswith(TRACKING_PREFIX))
    left = F.array_join(keep, "&")
    base, fragment = F.regexp_extract(c, r"^([^?#]*)", 1), F.regexp_extract(c, "(#.*)$", 1)
    return F.when(query(c) == "", c).otherwise(F.concat(base, F.when(left != "", F.concat(F.lit("?"), left)).otherwise(""), fragment))


def compare_form(c: Column) -> Column:
    """Lower scheme and host, no query or fragment, no slash at the end."""
    p = path(F.trim(c))
    p = F.when(F.length(p) > 1, F.regexp_replace(p, "/+$", "")).otherwise(p)
    return F.when(scheme(F.trim(c)) != "", F.concat(scheme(F.trim(c)), F.lit("://"), host(F.trim(c)), p)).otherwise(F.trim(c))


def target(c: Column) -> Column:
    """A URL to fetch: trimmed, without tracking; empty if it holds white space."""
    t = F.trim(F.replace(c, F.lit("&amp;"), F.lit("&")))
    return F.when(t.rlike(r"\s"), F.lit("")).otherwise(strip_tracking(t))


def glued(c: Column) -> Column:
    """Two URLs in one."""
    return F.regexp_count(F.lower(c), F.lit("https?://")) > 1


def last_words(c: Column) -> Column:
    """The last path segment as words."""
    s = F.element_at(F.split(F.regexp_replace(path(c), "/+$", ""), "/"), -1)
    return F.trim(F.regexp_replace(F.regexp_replace(s, r"\.[A-Za-z0-9]{2,5}$", ""), "[-_+]+", " "))


def codes(c: Column) -> Column:
    """Product codes in the path: runs of six or more letters and digits with a digit."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(path(c)), F.lit("([a-z0-9]{3,})"), F.lit(1)), lambda t: t.rlike("[0-9]")))


def safe(c: Column, longest: int = 2048) -> Column:
    """A public link: http, of sane length, not a mail or script target."""
    return c.isNotNull() & (F.length(c) <= longest) & F.lower(c).rlike(r"^https?://[^\s/]+") & ~F.lower(c).rlike(r"(javascript:|mailto:|/cart(/|$)|/logout)")


def utility(c: Column) -> Column:
    """A link to a service page rather than content."""
    return F.arrays_overlap(segments(c), F.array(*(F.lit(x) for x in UTILITY)))


def detail_like(c: Column, job: bool = False) -> Column:
    marks = JOB_MARKS if job else DETAIL_MARKS
    return F.coalesce(F.lower(path(c)).rlike(marks) | F.lower(path(c)).rlike(r"/[^/]*[0-9]{3,}[^/]*/?$"), F.lit(False))


def job_posting(c: Column) -> Column:
    return F.lower(path(c)).rlike(JOB_MARKS) & F.lower(path(c)).rlike("[0-9]{3,}")


def job_hub(c: Column) -> Column:
    return F.lower(path(c)).rlike("/(jobs|careers|openings|vacancies)/?$")


def structural(c: Column, page: Column) -> Column:
    """Navigation relative to the page: the same path, the root, or a service page."""
    p = F.regexp_replace(path(c), "/+$", "")
    return ~detail_like(c) & ((p == "") | (p == F.regexp_replace(path(page), "/+$", "")) | utility(c))


def signature(c: Column) -> Column:
    """Shape of a URL: first segment, detail mark, depth band."""
    s = segments(c)
    band = F.when(F.size(s) <= 1, "1").when(F.size(s) <= 3, "2_3").otherwise("4_plus")
    return F.concat_ws("|", F.coalesce(F.get(s, F.lit(0)), F.lit("0")), detail_like(c).cast("int").cast("string"), band)


def surface(c: Column) -> Column:
    """The kind of page that a URL points to."""
    return F.when(job_posting(c), "job_detail").when(F.lower(path(c)).rlike(JOB_MARKS) | job_hub(c), "job_listing").when(detail_like(c), "ecommerce_detail").otherwise("ecommerce_listing")


#: Query keys that a canonical record URL drops, and their prefixes: a short list of our own.
CANONICAL_KEYS, CANONICAL_PREFIX = ("variant", "color", "colour", "size", "sku", "pos", "position", "sort"), "utm_"
#: Second-level labels under which sites register below country domains.
SHARED_LABELS = "co|com|org|net|gov|edu|ac"
#: Top-level domains whose shops price in one currency: a short list of our own.
COUNTRY_CURRENCIES = {"uk": "GBP", "in": "INR", "de": "EUR", "fr": "EUR", "es": "EUR", "it": "EUR", "jp": "JPY", "ca": "CAD", "au": "AUD"}


def _resolved_path(p: Column) -> Column:
    """A path without "." and ".." segments."""
    steps = F.split(p, "/")
    walk = F.aggregate(
        steps, F.array().cast("array<string>"),
        lambda out, s: F.when(s == "..", F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(1)))).when(s == ".", out).otherwise(F.array_append(out, s)),
    )
    tail = F.when(F.element_at(steps, -1).isin(".", ".."), "/").otherwise("")
    return F.concat(F.array_join(walk, "/"), tail)


def absolute(base: Column, c: Column) -> Column:
    """A link as found on a page, resolved against the page's URL; empty for no link.

    ``&amp;`` is decoded; a bare host gets https.
    """
    return once(F.regexp_replace(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")), "(?i)&(amp|#38|#x26);", "&"), lambda t: once(base, lambda base: _against(base, t)))


def _against(base: Column, t: Column) -> Column:
    root = F.concat(scheme(base), F.lit("://"), F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    folder = F.regexp_extract(path(base), r"^(.*/)", 1)
    here = F.concat(root, path(base))
    own = F.regexp_extract(t, r"^([^?#]*)", 1)
    rest = F.substr(t, F.length(own) + 1)
    folder = F.when(folder == "", "/").otherwise(folder)
    return (
        F.when(t == "", "").when(t.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), t).when(t.startswith("//"), F.concat(scheme(base), F.lit(":"), t))
        .when(t.startswith("#"), F.concat(here, F.when(query(base) != "", F.concat(F.lit("?"), query(base))).otherwise(""), t)).when(t.startswith("?"), F.concat(here, t))
        .when(t.rlike(r"^([A-Za-z0-9-]+\.)+[A-Za-z]{2,}(/\S*)?$") & ~F.lower(t).rlike(r"\.(html?|php|aspx?|jsp)$"), F.concat(F.lit("https://"), t))
        .when(t.startswith("/"), F.concat(root, _resolved_path(own), rest)).otherwise(F.concat(root, _resolved_path(F.concat(folder, own)), rest))
    )


def found_in(c: Column, page: Column) -> Column:
    """All URLs of a text: several absolute ones each, else the whole text resolved.

    Distinct whatever their case, the first one stays; templates and placeholders go.
    """
    many = F.regexp_extract_all(c, F.lit(r"(https?://(?:(?!https?://)[^\s,])+)"), F.lit(1))
    each = once(many, lambda many: F.when(F.size(many) >= 2, many).otherwise(F.array(absolute(page, c))))
    each = F.transform(each, lambda x: F.regexp_replace(x, r"[.,;:!)\]}>'\"]+$", ""))
    fine = F.filter(each, lambda x: (x != "") & ~x.rlike(r"\{\{|\}\}|\$\{|<%") & ~F.lower(x).rlike("placeholder|/blank\\.|spacer\\.gif"))
    first = lambda fine, lows: F.filter(fine, lambda x, i: F.array_position(lows, F.lower(x)) == i + 1)
    glued_text = c.rlike(r"[^\s,]https?://")
    return F.when(c.isNull() | (F.trim(c) == "") | glued_text, F.array().cast("array<string>")).otherwise(once(fine, lambda fine: once(F.transform(fine, F.lower), lambda lows: first(fine, lows))))


def canonical_record(c: Column) -> Column:
    """A record's own URL: without query keys that only choose a view of it."""
    keep = F.filter(F.split(query(c), "&"), lambda kv: ~F.lower(F.split_part(kv, F.lit("="), F.lit(1))).isin(*CANONICAL_KEYS) & ~F.lower(kv).startswith(CANONICAL_PREFIX))
    left, had = F.array_join(keep, "&"), F.split(query(c), "&")
    base, fragment = F.regexp_extract(c, r"^([^?#]*)", 1), F.regexp_extract(c, "(#.*)$", 1)
    return F.when((query(c) == "") | (F.size(keep) == F.size(had)), c).otherwise(F.concat(base, F.when(left != "", F.concat(F.lit("?"), left)).otherwise(""), fragment))


def registrable(c: Column) -> Column:
    """The part of a host that is registered: two labels, three under shared ones; addresses stay."""
    h = hostname(c)
    three = F.regexp_extract(h, rf"([^.]+\.(?:{SHARED_LABELS})\.[a-z]{{2}})$", 1)
    return F.when(h.rlike(r"^[0-9.]+$"), h).when(three != "", three).otherwise(F.coalesce(F.nullif(F.regexp_extract(h, r"([^.]+\.[^.]+)$", 1), F.lit("")), h))


def same_site(a: Column, b: Column) -> Column:
    return (registrable(b) != "") & (registrable(a) == registrable(b))


def currency_hint(c: Column) -> Column:
    """Currency of a URL's country: its top-level domain, else a two-letter path segment."""
    codes = F.create_map(*(F.lit(x) for kv in COUNTRY_CURRENCIES.items() for x in kv))
    top = F.regexp_extract(hostname(c), r"\.([a-z]{2})$", 1)
    at = F.filter(segments(c), lambda s: F.array_contains(F.map_keys(codes), F.regexp_extract(s, "^(?:[a-z]{2}-)?([a-z]{2})$", 1)))
    return F.coalesce(F.element_at(codes, top), F.element_at(codes, F.regexp_extract(F.get(at, F.lit(0)), "^(?:[a-z]{2}-)?([a-z]{2})$", 1)))
