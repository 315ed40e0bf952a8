"""The operators of this subpackage as queries over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import decontaminate, fim, importance, jaccard, langid, licenses, mixing, ngramlm, oracle, pii, pqdedup, sharding, suffixdedup, toolcalls
from .common import table

QUERIES, ORACLE = {}, {}


def query(name, sql=None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return put


def fold(k: int):
    """crc32(doc_id as text) mod k."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % k


def language_model(docs):
    """Fitted on a bounded sample of the documents outside the held-out fold."""
    return langid.fit(langid.training_sample(docs.where(fold(4) != 2).select("doc_id", "text", "lang")))


@query("op1_crf_language_id")
def op1(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    out = langid.identify(docs.select("doc_id", "text"), language_model(docs))
    return out.select("doc_id", (fold(4) == 2).alias("held_out"), "lang_pred", "score", "word_counts")


@query("op2_elias_fano_lm")
def op2(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = ngramlm.train(docs.where(fold(5) != 1).select("text"), min_pair=1)
    return ngramlm.score(docs, model).select(
        "doc_id", (fold(5) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", F.col("lm_score").alias("score")
    )


@query("op3_vector_bin_packing")
def op3(spark, sf_dir):
    return sharding.assign_shards(table(spark, sf_dir, "documents").select("doc_id", "text"))


#: Tools whose calls are validated.
TOOLS = [
    ("search", '{"properties":{"query":{"type":"string"},"limit":{"type":"integer","maximum":6}},"required":["query"]}'),
    ("calculator", '{"properties":{"expression":{"type":"string"}},"required":["expression"],"additionalProperties":false}'),
]


def with_tool_calls(conversations):
    """The table holds no tool calls, so each message gets one by a rule on c (conv_id) and t (turn).

    An assistant's turn calls ``c<t>``: weather, which no schema knows, where 11 divides c + t,
    else the calculator where 3 does, else search.  A search asks for ``turn <t>``, or, where 3
    divides c, for the result of the call two turns before, or, where 13 does, of a call that asks
    back.  Where 7, 17 or 5 divides c + t its limit is text, its query is missing, or the
    calculator gets an argument too many; where 29 does, the call is cut off.  Where 19 divides c,
    later calls repeat an identifier.  A user's turn after the first answers the turn before it,
    not at all where 5 divides c, and the turn after it where 23 does.
    """
    c, t = F.col("conv_id"), F.col("turn")
    k, text = c + t, lambda x: x.cast("string")
    name = F.when(k % 11 == 0, "weather").when(k % 3 == 0, "calculator").otherwise("search")
    back = F.when((c % 13 == 0) & (t % 4 < 2), t + 2).when((c % 13 == 0) | (t >= 2) & (c % 3 == 0), t - 2)
    asks = F.coalesce(F.concat(F.lit("$c"), text(back)), F.concat(F.lit("turn "), text(t)))
    limit = F.when(k % 7 == 0, F.lit('"three"')).otherwise(text(t))
    search = F.when(k % 17 == 0, F.format_string('{"limit": %s}', limit)).otherwise(F.format_string('{"query": "%s", "limit": %s}', asks, limit))
    unit = F.when(k % 5 == 0, F.lit(', "unit": "m"')).otherwise(F.lit(""))
    arguments = F.when(name == "search", search).when(name == "calculator", F.format_string('{"expression": "%s+%s"%s}', text(c), text(t), unit)).otherwise(F.lit("{}"))
    own = F.when((c % 19 == 0) & (t >= 3), t - 2).otherwise(t)
    call = F.when(k % 29 == 0, F.lit("<tool_call>{</tool_call>")).otherwise(
        F.format_string('<tool_call>{"name": "%s", "id": "c%s", "arguments": %s}</tool_call>', name, text(own), arguments)
    )
    answers = F.when(c % 23 == 0, t + 1).when(c % 5 != 0, t - 1)
    result = F.format_string('<tool_result>{"id": "c%s", "content": %s}</tool_result>', text(answers), text(F.length(F.coalesce("text", F.lit("")))))
    block = F.when(F.col("role") == "assistant", call).when((F.col("role") == "user") & (t > 0) & answers.isNotNull(), result)
    return conversations.select("conv_id", "turn", "role", F.concat(F.coalesce("text", F.lit("")), F.coalesce(block, F.lit(""))).alias("text"))


@query("op4_tool_call_linking", oracle.TOOL_CALLS)
def op4(spark, sf_dir):
    return toolcalls.link(with_tool_calls(table(spark, sf_dir, "conversations")), spark.createDataFrame(TOOLS, "name string, schema string"))


@query("op5_pq_near_duplicates", oracle.COSINE)
def op5(spark, sf_dir):
    return pqdedup.near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


@query("op6_jaccard_join", oracle.JACCARD)
def op6(spark, sf_dir):
    return jaccard.jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op7_curriculum_mix", oracle.MIXING)
def op7(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.training_order(mixing.mix(docs)).select(
        "doc_id", "size", "source_size", "target", "taken", "source", "passes", "positions"
    )


@query("op8_positional_licence_scan", oracle.LICENCES)
def op8(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op9_prefix_decontamination", oracle.CONTAMINATION)
def op9(spark, sf_dir):
    docs, bench = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    out = decontaminate.find_contamination(docs.select("doc_id", "text"), bench)
    return out.select(
        "doc_id", "n_words", "n_hit", "n_items", decontaminate.items_digest().alias("items_sha256"),
        decontaminate.contaminated().alias("contaminated"),
    )


@query("op10_suffix_dedup", oracle.REPEATS)
def op10(spark, sf_dir):
    return suffixdedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op11_pii_candidate_boosting")
def op11(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = pii.detect(docs, pii.fit(docs)).select("doc_id", "pii", F.filter("pii", lambda s: s["base"]).alias("own"))
    return out.select(
        "doc_id", *(pii.count(F.col("own"), k).alias(f"n_{k}") for k in pii.KINDS),
        F.sha2(pii.digest(F.col("own")).cast("binary"), 256).alias("base_sha256"), pii.digest(F.col("pii")).alias("spans"),
    )


@query("op12_importance_resampling", oracle.IMPORTANCE)
def op12(spark, sf_dir):
    docs, bench = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("text")
    weighted = importance.importance(docs, bench).select("doc_id", "n_words", "n_features", "weight")
    return importance.draw(weighted).select("doc_id", "n_features", "weight", "score", "rank")


@query("op13_fill_in_middle", oracle.FILL_IN_MIDDLE)
def op13(spark, sf_dir):
    out = fim.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id", F.col("n_units").alias("n"), "form", "prefix_chars", "middle_chars", F.sha2(F.col("fim_text").cast("binary"), 256).alias("output_sha256"),
        F.sha2(fim.restore(F.col("fim_text"), F.col("form")).cast("binary"), 256).alias("restored_sha256"),
    )
