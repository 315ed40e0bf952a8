"""Fourteen checks of an extracted record, the first that fails, and a verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import coerce
from millrace.functions import url as u

#: Prices that can be, the most in currencies of small units, and these (fixed values).
LEAST_PRICE, MOST_PRICE, MOST_SMALL = 0.01, 10_000.0, 100_000.0
SMALL_UNITS = ("INR", "JPY", "KRW", "VND", "IDR", "HUF", "CLP")
#: Digits of barcodes.
BARCODES = (8, 12, 13, 14)
#: Names that systems give things, and what is left of templates: short lists of our own.
INTERNAL = r"^(untitled|default title|test product|placeholder|undefined|null|none)$|\[object object\]|^[a-f0-9]{24,}$"
POLLUTED_TEXT = r"(?i)<(script|style|div|p|br)\b|\{\{|function\s*\(|add to cart|cookie policy|enable javascript"
POLLUTED_CATEGORY = r"(?i)://|^/|\.html?$|^(home|shop|all|products?|menu)$|sign in|add to cart"
GENDERS = ("women", "men", "unisex", "kids", "girls", "boys", "baby")
#: check, what a surface asks by default ("detail", "listing", "product", or nothing), what its failure is
#: called, and whether that makes the output bad, in the order in which failures are named.
CHECKS = (
    ("identity_ok", "detail", "detail_identity_mismatch", True), ("listing_noise_ok", "listing", "listing_chrome_noise", True), ("variant_presence_ok", "", "thin_detail", False), ("variant_labels_ok", "", "axis_pollution", False),
    ("variant_price_ok", "", "variant_price_missing", False), ("price_sane_ok", "", "price_magnitude_anomaly", True), ("category_clean_ok", "commerce", "category_pollution", True), ("long_text_clean_ok", "product", "long_text_pollution", True),
    ("variant_artifacts_ok", "product", "variant_artifact_pollution", True), ("variant_currency_parity_ok", "product", "variant_currency_mismatch", True), ("identifier_shapes_ok", "product", "identifier_shape_pollution", True),
    ("title_token_ok", "product", "title_internal_token", True), ("system_artifacts_ok", "product", "system_artifact_pollution", True), ("repair_diagnostics_ok", "", "repair_diagnostic_missing", True),
)


def _asked(default: str, surface: Column) -> Column:
    kinds = {"detail": surface.endswith("_detail"), "listing": surface.endswith("_listing"), "commerce": surface.startswith("ecommerce_"), "product": surface == "ecommerce_detail"}
    return kinds.get(default, F.lit(False))


def _passes() -> dict[str, Column]:
    """What each check asks of the columns url, title, price, currency, category, description, sku, barcode, gender,
    product_type, availability, listing_rows (links and titles of the first rows), variants
    (options map, price, currency) and repairs."""
    text = lambda c: F.coalesce(coerce.text_or_none(F.col(c)), F.lit(""))
    low, rows = lambda c: F.lower(text(c)), F.coalesce("variants", F.array())
    amount, code = F.col("price"), F.upper(text("currency"))
    values = lambda v: F.map_values(F.coalesce(v["options"], F.create_map().cast("map<string,string>")))
    real = F.exists(F.coalesce("listing_rows", F.array()), lambda r: ~coerce.title_noise(r["title"]) & F.coalesce(u.safe(r["url"]) & ~(u.utility(r["url"]) & ~u.detail_like(r["url"])), F.lit(False)))
    stray = lambda x: x.isNotNull() & (~coerce.option_scalar(x).eqNullSafe(F.trim(x)) | x.rlike("^https?:") | (F.length(x) > 60))
    barcode = text("barcode")
    return {
        "identity_ok": ~F.coalesce(coerce.title_noise(F.col("title")), F.lit(True)),
        "listing_noise_ok": real,
        "variant_presence_ok": F.size(rows) >= 2,
        "variant_labels_ok": (F.size(rows) > 0) & F.forall(rows, lambda v: F.size(values(v)) > 0),
        "variant_price_ok": amount.isNotNull() | F.exists(rows, lambda v: v["price"].isNotNull()),
        "price_sane_ok": F.coalesce((amount >= LEAST_PRICE) & (amount <= F.when(code.isin(*SMALL_UNITS), MOST_SMALL).otherwise(MOST_PRICE)), F.lit(False)),
        "category_clean_ok": (text("category") == "") | ~text("category").rlike(POLLUTED_CATEGORY),
        "long_text_clean_ok": ~text("description").rlike(POLLUTED_TEXT),
        "variant_artifacts_ok": F.forall(rows, lambda v: F.forall(values(v), lambda x: ~stray(x))),
        "variant_currency_parity_ok": (code == "") | F.forall(rows, lambda v: (F.upper(F.coalesce(v["currency"], F.lit(""))) == code) | ((F.coalesce(v["currency"], F.lit("")) == "") & v["price"].isNull())),
        "identifier_shapes_ok": ((barcode == "") | (barcode.rlike("^[0-9]+$") & F.length(barcode).isin(*BARCODES))) & ((low("gender") == "") | low("gender").isin(*GENDERS)) & ~low("product_type").rlike(INTERNAL),
        "title_token_ok": ~low("title").rlike(INTERNAL),
        "system_artifacts_ok": ~low("sku").startswith("copy-") & ~low("product_type").isin("default", "tag", "inline"),
        "repair_diagnostics_ok": F.size(F.coalesce("repairs", F.array().cast("array<string>"))) > 0,
    }


def checked(records: DataFrame, surface: str = "surface", blocked: str = "blocked", required: str = "required") -> DataFrame:
    """The records with checks (name to boolean), failure and verdict.

    ``required`` maps checks to whether they count, over what the surface asks for by default; a
    check that isn't asked for passes.  Blocked records are ``blocked``; a failure that makes the output
    bad gives ``bad_output``, another ``usable_with_gaps``, none ``good``.  The failure is that of the
    first check in their order.  Nulls are absent values; input columns checks, failure and verdict are replaced.
    """
    passes, kind = _passes(), F.lower(F.coalesce(surface, F.lit("")))
    wanted = lambda name, default: F.coalesce(F.element_at(F.col(required), F.lit(name)), _asked(default, kind))
    out = records.withColumn("checks", F.map_from_arrays(F.array(*(F.lit(n) for n, *_ in CHECKS)), F.array(*(F.coalesce(passes[n], F.lit(False)) | ~wanted(n, d) for n, d, *_ in CHECKS))))
    failed = lambda n: ~F.element_at("checks", F.lit(n))
    first, bad = F, F
    for name, _, label, makes_bad in CHECKS:
        first = first.when(failed(name), label)
        bad = bad.when(failed(name), F.lit(makes_bad))
    gone = F.coalesce(F.col(blocked), F.lit(False))
    out = out.withColumn("failure", F.when(gone, "blocked").otherwise(first.otherwise(F.lit("none"))))
    return out.withColumn("verdict", F.when(gone, "blocked").otherwise(F.when(F.col("failure") == "none", "good").when(bad.otherwise(F.lit(False)), "bad_output").otherwise("usable_with_gaps")))
