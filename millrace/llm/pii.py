"""Personal data by candidate generators, boosted trees and calibrated thresholds, in column functions."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, packed, set_aside

KINDS = ("email", "ip", "card", "phone")
_LOCAL, _HOST = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
#: The base patterns (fixed by the contract), written so that no start is tried twice: a failing
#: start is never repeated inside its run, and repeats are possessive, so Java neither
#: backtracks nor recurses on long runs.
BASE = (
    rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_HOST}++(?:\.{_HOST}++)++",
    r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)
#: Generators of high recall: spelled or spaced signs, defanged dots, other separators, no plus.
WIDE = (
    rf"(?i)(?:\G|(?<!{_LOCAL})){_LOCAL}++(?:\x20?(?:@|\(at\)|\[at\])\x20?|\x20at\x20(?={_HOST}++(?:\x20dot\x20|\x20?[(\[]dot)))"
    rf"{_HOST}++(?:(?:\.|\x20?(?:\(dot\)|\[dot\]|\[\.\])\x20?|\x20dot\x20){_HOST}++)++",
    r"(?i)(?<![0-9])[0-9]{1,3}+(?:\x20?(?:\.|\[\.\]|\(\.\)|\[dot\]|\(dot\))\x20?[0-9]{1,3}+){3}(?![0-9])",
    r"(?<![0-9])[0-9](?:[\x20._/-]{0,3}+[0-9]){12,18}+(?![0-9])",
    r"(?<![0-9A-Za-z])(?:\(\+?|\+|00)?[0-9](?:[\x20().\-/]{0,3}+[0-9]){6,14}+(?![0-9A-Za-z])",
)
#: Words before a span that speak for its kind, and against any.
CUES = (
    r"mail|contact|write|reach", r"\bip\b|host|server|address|client|ping", r"card|visa|credit|debit|amex|payment", r"\btel|phone|call|fax|mobile|cell|whatsapp",
)
AGAINST = r"version|release|build|isbn|order|invoice|serial|section|chapter|page|token|hash|secret|\bv\.? ?$|\bno\.? ?$|[#=$€£] ?$"
CONTEXT = 24
#: Columns that ``detect`` adds.
NEW = ("pii",)
FEATURES = "kind digits chars groups longest shortest largest separators luhn letters before after cue against".split()


@dataclass
class Model:
    """Trees as (weight, nested (feature, threshold, left, right) or value), and a threshold of the
    score for each kind; without one, nothing is added to the base spans of that kind."""

    trees: list = field(default_factory=list)
    thresholds: dict[int, float] = field(default_factory=dict)


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value made once, however often the body or its lambdas name it."""
    return F.get(F.transform(F.array(value), body), 0)


def _greatest(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def _least(a: Column, b: Column) -> Column:
    return F.least(a, b)


def _running(a: Column, empty: int, join, block: int = 128) -> Column:
    """Inclusive running totals under an associative ``join``, in blocks: for n items about n * block
    steps, where a fold that appends to an array would copy n * n / 2."""
    total = lambda xs: F.aggregate(xs, F.lit(empty), join)
    cut = lambda a: F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / block).cast("int")), lambda b: F.slice(a, b * block + 1, block))
    upto = lambda sums: F.transform(sums, lambda _, i: total(F.slice(sums, 1, i)))
    inner = lambda xs, s: F.transform(xs, lambda _, i: join(s, total(F.slice(xs, 1, i + 1))))
    totals = lambda blocks: F.zip_with(blocks, _let(F.transform(blocks, total), upto), inner)
    some = lambda a: F.when(F.size(a) > 0, F.flatten(_let(cut(a), totals))).otherwise(F.array().cast("array<int>"))
    return _let(a, some)


def _luhn(digits: Column) -> Column:
    def sums(d: Column) -> Column:
        n = F.length(d)
        one = lambda i: F.substring(d, i, F.lit(1)).cast("int") * F.when((n - i) % 2 == 1, 2).otherwise(1)
        doubled = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), one)
        return F.aggregate(doubled, F.lit(0), lambda s, x: s + x - F.when(x > 9, 9).otherwise(0)) % 10 == 0

    return _let(digits, sums)


def _digits(word: Column) -> Column:
    return F.regexp_replace(word, "[^0-9]", "")


def _passes(kind: int, word: Column) -> Column:
    """The contract's test of a base match."""
    if kind == 1:
        part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
        return word.rlike(rf"\A{part}(?:\.{part}){{3}}\z")
    if kind == 2:  # the pattern has 13 to 19 digits
        return _luhn(_digits(word))
    return F.length(_digits(word)).between(9, 15) if kind == 3 else F.lit(True)


def _features(kind: int, word: Column, before: Column, after: Column) -> Column:
    """FEATURES as doubles.  The sign that makes a base match (@, +) is no feature, so that what is
    learnt of it holds for spans that lack it."""
    d, low = _digits(word), F.lower(before)
    groups = F.filter(F.split(word, "[^0-9]+"), lambda g: g != "")
    sizes = F.transform(groups, F.length)
    largest = F.array_max(F.transform(groups, lambda g: F.when(F.length(g) > 3, 999).otherwise(g.cast("int"))))
    near = lambda c: F.when(c.rlike("[A-Za-z]"), 2).when(c.rlike("[^ \\n\\t]"), 1).otherwise(0)
    flag = lambda c: F.when(c, 1).otherwise(0)
    values = [
        F.lit(kind), F.length(d), F.length(word), F.size(groups), F.array_max(sizes), F.array_min(sizes), largest,
        F.size(F.array_distinct(F.split(F.regexp_replace(word, "[0-9A-Za-z]", ""), ""))), flag(_luhn(d)) if kind in (2, 3) else F.lit(0),
        F.length(F.regexp_replace(word, "[^A-Za-z]", "")), near(F.substring(before, -1, 1)), near(F.substring(after, 1, 1)),
        flag(low.rlike(CUES[kind])), flag(low.rlike(AGAINST)),
    ]
    return F.array(*(F.coalesce(v.cast("double"), F.lit(-1.0)) for v in values))


def _implausible(kind: int, word: Column, before: Column) -> Column:
    """Spans that are surely no personal data of a kind: the negatives to learn from."""
    d = _digits(word)
    if kind == 0:
        return ~word.rlike(r"[A-Za-z]{2,24}\z") | F.lower(before).rlike(AGAINST)
    if kind == 1:
        parts = F.split(word, "[^0-9]+")
        return F.exists(parts, lambda p: F.when(F.length(p) > 0, p.cast("int") > 255).otherwise(False)) | F.lower(before).rlike(AGAINST)
    if kind == 2:
        return ~_luhn(d) | F.lower(before).rlike(AGAINST)
    parts = F.filter(F.split(word, "[^0-9]+"), lambda p: p != "")
    dated = word.rlike(r"\A(?:1[89]|20)[0-9]{2}[-/. ][01]?[0-9][-/. ][0-3]?[0-9]|\A[0-3]?[0-9][-/.][01]?[0-9][-/.](?:19|20)[0-9]{2}")
    return dated | (F.size(parts) < 2) | (F.size(parts) > 6) | ~F.length(d).between(9, 15) | (F.array_max(F.transform(parts, F.length)) > 5) | F.lower(before).rlike(AGAINST)


def _made_once(df: DataFrame, *columns: str) -> DataFrame:
    """The same rows.  A caller's filter on these columns is not pushed below, where it would
    make the expressions behind them once for each mention."""
    rest = [c for c in df.columns if c not in columns]
    return df.select(*rest, F.explode_outer(F.array(F.struct(*columns))).alias("_made")).select(*rest, "_made.*")


def _with_meeting(spans: Column, body) -> Column:
    """``body`` of spans in order of start and a function (span, index) that says whether it meets a base span."""
    far = 2**31 - 1
    ends = _running(F.transform(spans, lambda s: F.when(s["base"], s["end"]).otherwise(-1)), -1, _greatest)
    starts = F.reverse(_running(F.reverse(F.transform(spans, lambda s: F.when(s["base"], s["start"]).otherwise(far))), far, _least))
    meets = lambda at: lambda s, i: (F.get(at["ends"], i) > s["start"]) | (F.get(at["starts"], i) < s["end"])
    return _let(F.struct(ends.alias("ends"), starts.alias("starts")), lambda at: body(spans, meets(at)))


def _beside(spans: Column, meets) -> Column:
    return F.filter(spans, lambda s, i: ~s["base"] & ~meets(s, i))


def _refused(spans: Column, meets) -> Column:
    """Proposals; those that meet a base span (of another kind) are surely none."""
    return F.filter(F.transform(spans, lambda s, i: s.withField("sure", F.when(meets(s, i), 0).otherwise(s["sure"]))), lambda s: ~s["base"])


def candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """held (the input row), base and wide: spans as (start, end, kind, base, sure, features).

    ``base`` are the contract's matches by kind and start; ``wide`` what the generators propose
    beside those of a kind, kinds may overlap.  ``sure`` is 1 for base spans, 0 for implausible
    proposals and for those that meet a base span of another kind, else null.  Offsets are code points.  Texts are scanned once for each pattern, and again only
    where it matches.
    """
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    number = whole.rlike("[0-9]")
    gates = (F.contains(whole, F.lit("@")), number, number, number)
    loose = (whole.rlike(r"(?i)@|[(\[]at[)\]]|\bdot\b"), number, number, number)
    none = F.array().cast("array<string>")
    pairs = [(f"{n}{k}", p[k], g[k]) for n, p, g in (("base", BASE, gates), ("wide", WIDE, loose)) for k in range(len(KINDS))]
    work = docs.select(packed(docs).alias("held"), whole.alias("text"), *(F.when(g, F.regexp_extract_all(whole, F.lit(p), F.lit(0))).otherwise(none).alias(n) for n, p, g in pairs))
    work = work.select("held", *(n for n, _, _ in pairs), *(F.when(F.size(n) > 0, F.split("text", p, -1)).otherwise(none).alias(f"{n}_between") for n, p, _ in pairs))

    def steps(n: str) -> Column:
        """From the start of each match to that of the next: what lies between and the match before."""
        words, between = F.col(n), F.col(f"{n}_between")
        return F.transform(words, lambda _, i: F.length(F.get(between, i)) + F.coalesce(F.length(F.get(words, i - 1)), F.lit(0)))

    work = work.select("*", *(steps(n).alias(f"{n}_steps") for n, _, _ in pairs))
    work = work.select("*", *(_running(F.col(f"{n}_steps"), 0, lambda a, b: a + b).alias(f"{n}_at") for n, _, _ in pairs))

    def spans(n: str, kind: int) -> Column:
        words, between, base = F.col(n), F.col(f"{n}_between"), n.startswith("base")
        kept = F.filter(F.transform(words, lambda w, i: F.struct(w.alias("word"), i.cast("int").alias("i"))), lambda x: _passes(kind, x["word"]) if base else F.lit(True))

        def span(x: Column) -> Column:
            start = F.get(F.col(f"{n}_at"), x["i"])
            before, after = F.substring(F.get(between, x["i"]), -CONTEXT, CONTEXT), F.substring(F.get(between, x["i"] + 1), 1, CONTEXT)
            sure = F.lit(1) if base else F.when(_implausible(kind, x["word"], before), 0)
            return F.struct(
                start.alias("start"), (start + F.length(x["word"])).alias("end"), F.lit(kind).alias("kind"), F.lit(base).alias("base"), sure.cast("int").alias("sure"),
                _features(kind, x["word"], before, after).alias("features"),
            )

        return F.transform(kept, span)

    made = work.select("held", *(spans(f"{n}{k}", k).alias(f"{n}{k}") for n in ("base", "wide") for k in range(len(KINDS))))
    base = F.concat(*(f"base{k}" for k in range(len(KINDS))))
    apart = (F.when(F.size(f"wide{k}") > 0, _with_meeting(F.array_sort(F.concat(f"base{k}", f"wide{k}")), _beside)).otherwise(F.col(f"wide{k}")) for k in range(len(KINDS)))
    mixed = made.select("held", base.alias("base"), F.concat(*apart).alias("wide")).withColumn("mixed", F.array_sort(F.concat("base", "wide")))
    wide = F.when(F.size("wide") > 0, _with_meeting(F.col("mixed"), _refused)).otherwise(F.col("wide"))
    return _made_once(mixed.select("held", "base", wide.alias("wide")), "base", "wide")


def fit(docs: DataFrame, text: str = "text", documents: int = 20_000, spans: int = 20_000, rounds: int = 10, depth: int = 3, precision: float = 0.98, scratch: Scratch | None = None) -> Model:
    """Boosted trees over spans of a random sample of about ``documents`` rows, ``spans`` spans at most.

    Base spans teach what personal data look like, implausible proposals what doesn't; a third
    of the spans is kept to calibrate: a kind's threshold is the lowest score, 0.5 at least,
    from which the share of base spans is ``precision``, were both classes equally many.  A kind with fewer than 20 base spans or 5
    implausible ones there gets none, nor does any kind where the sample holds one class only.
    """
    scratch = scratch or Scratch(docs.sparkSession, "pii")
    rows = docs.count()
    some = docs.select(text) if rows <= documents else docs.select(text).where(F.rand(7) < documents / rows)
    each = candidates(some, text).select(F.explode(F.filter(F.concat("base", "wide"), lambda s: s["sure"].isNotNull())).alias("s")).select("s.*")
    drawn = each.select("kind", "sure", "features", F.rand(11).alias("key"))
    sample = scratch.write(drawn.orderBy("key").limit(spans).coalesce(1), "sample")
    vectors = sample.select(array_to_vector("features").alias("features"), F.col("sure").cast("double").alias("label"), "kind", F.floor(F.col("key") * 1e6).alias("key"))
    vectors = vectors.withColumn("fold", F.col("key") % 3)
    train = vectors.where("fold <> 0")
    if train.select("label").distinct().count() < 2:
        return Model()
    boosted = GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=0.3, seed=7, checkpointInterval=-1).fit(train)

    def node(n):
        if n.getClass().getSimpleName() == "LeafNode":
            return n.prediction()
        s = n.split()
        return s.featureIndex(), s.threshold(), node(n.leftChild()), node(n.rightChild())

    model = Model([(w, node(t._java_obj.rootNode())) for w, t in zip(boosted.treeWeights, boosted.trees, strict=True)])
    held_out: dict[int, list] = {}
    for r in vectors.where("fold = 0").select("kind", "label", _score(model, vector_to_array("features")).alias("score")).collect():  # at most ``spans``
        held_out.setdefault(r["kind"], []).append((r["score"], r["label"]))
    for kind, scored in held_out.items():
        right = sum(label for _, label in scored)
        if right < 20 or len(scored) - right < 5:
            continue
        scored.sort(reverse=True)
        hits, best = 0, None
        for i, (score, label) in enumerate(scored, 1):
            hits += label
            caught, wrong = hits / right, (i - hits) / (len(scored) - right)
            if score >= 0.5 and (i == len(scored) or scored[i][0] < score) and caught >= precision * (caught + wrong):
                best = score
        if best is not None:
            model.thresholds[kind] = best
    return model


def _score(model: Model, features: Column) -> Column:
    """The trees' probability, to nine places, as one expression."""

    def value(n) -> Column:
        if isinstance(n, float):
            return F.lit(n)
        k, threshold, left, right = n
        return F.when(F.get(features, k) <= threshold, value(left)).otherwise(value(right))

    margin = sum((F.lit(w) * value(t) for w, t in model.trees), F.lit(0.0))
    return F.round(1 / (1 + F.exp(-2 * margin)), 9)


def detect(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The input rows with pii: (kind, start, end, score, base), by kind, then start.

    Base spans stay whatever their score, which is 1.  A proposal is added where its score
    reaches its kind's threshold, it is not implausible, and it meets no base span; of two
    proposals that are neighbours and overlap, the one of higher score stays, then the one that
    starts first.  Null and empty texts have no spans; repeated rows get the same; an empty table gives an
    empty result.  An input column ``pii`` is kept under the name of ``set_aside``; others keep theirs.  One
    pass, no shuffle.
    """
    found = candidates(docs.withColumnsRenamed(aside := set_aside(docs, NEW)), aside.get(text, text))
    span = lambda s, score: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), score.alias("score"), s["base"].alias("base"))
    base = F.transform("base", lambda s: span(s, F.lit(1.0)))
    if not model.thresholds:
        added = F.filter(base, lambda s: ~s["base"])
        out = found.select("held", base.alias("base"), added.alias("added"))
    else:
        reaches = lambda s: F.coalesce(*(F.when(s["kind"] == k, s["score"] >= t) for k, t in sorted(model.thresholds.items())), F.lit(False))
        scored = found.select("held", base.alias("base"), F.transform(F.filter("wide", lambda s: s["sure"].isNull()), lambda s: span(s, _score(model, s["features"]))).alias("wide"))
        out = scored.select("held", "base", F.filter("wide", reaches).alias("wide"))
        meets = lambda a, b: (a["start"] < b["end"]) & (b["start"] < a["end"])
        loses = lambda s, o: F.coalesce(meets(s, o) & (o["score"] > s["score"]), F.lit(False))
        best = F.filter("wide", lambda s, i: ~loses(s, F.get("wide", (i - 1).cast("int"))) & ~loses(s, F.get("wide", (i + 1).cast("int"))))
        out = out.select("held", "base", best.alias("best"))
        ends = _running(F.transform("best", lambda s: s["end"]), -1, _greatest)
        out = out.select("held", "base", "best", F.when(F.size("best") > 1, ends).alias("ends"))
        first = F.filter("best", lambda s, i: F.coalesce(F.get("ends", (i - 1).cast("int")), F.lit(-1)) <= s["start"])
        out = out.select("held", "base", first.alias("added"))
    every = F.array_sort(F.concat("base", "added"))
    name = F.array(*(F.lit(k) for k in KINDS))
    named = F.transform(every, lambda s: F.struct(F.get(name, s["kind"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["score"].alias("score"), s["base"].alias("base")))
    return _made_once(out.select("held", named.alias("pii")), "pii").select("held.*", "pii")


def count(pii: Column, kind: str) -> Column:
    return F.size(F.filter(pii, lambda s: s["kind"] == kind)).cast("long")


def digest(pii: Column) -> Column:
    """``kind:start:end`` of spans, comma-joined."""
    return F.array_join(F.transform(pii, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(text: Column, pii: Column) -> Column:
    """The text with each span, or run of spans that meet, turned into the first one's ``[KIND]``.

    Each cut walks the text from its start, so a text costs its length times its spans.
    """
    order = F.array_sort(F.transform(pii, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.upper(s["kind"]).alias("kind"))))

    def runs(order: Column) -> Column:
        ends = _running(F.transform(order, lambda s: s["end"]), 0, _greatest)
        heads = lambda e: F.filter(order, lambda s, i: F.coalesce(F.get(e, i - 1), F.lit(0)) <= s["start"])
        tails = lambda e: F.filter(e, lambda x, i: F.coalesce(F.get(order, i + 1)["start"] >= x, F.lit(True)))
        return _let(ends, lambda e: F.struct(heads(e).alias("heads"), tails(e).alias("tails")))

    def made(r: Column) -> Column:
        upto = lambda i: F.coalesce(F.get(r["tails"], i - 1), F.lit(0))
        parts = F.transform(r["heads"], lambda s, i: F.concat(F.substring(text, upto(i) + 1, s["start"] - upto(i)), F.lit("["), s["kind"], F.lit("]")))
        return F.concat(F.array_join(parts, ""), F.substring(text, F.coalesce(F.array_max(r["tails"]), F.lit(0)) + 1, F.length(text)))

    return F.when(F.size(pii) > 0, _let(_let(order, runs), made)).otherwise(text)
