"""From documents to training shards: five stages, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import decontaminate, jaccard, langid, mixing, sharding
from millrace.llm.common import Scratch, scratch_scope, set_aside, table
from millrace.llm.queries import fold


def _columns(out: DataFrame, docs: DataFrame, new: tuple[str, ...]) -> DataFrame:
    """The columns of ``docs``, under their own names, of a result that added ``new``."""
    aside = set_aside(docs, new)
    return out.select(*(F.col(f"`{aside.get(c, c)}`").alias(c) for c in docs.columns))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with a letter stay; null texts and texts without a letter go.

    Which language is found, and how surely, decides nothing.  Where no labelled row is
    left to learn from, no language is found and texts with a letter stay all the same.
    """
    model = langid.fit(langid.training_sample(docs.where(fold(4) != 2).select("doc_id", "text", "lang")))
    if not model.labels:
        return langid.with_letters(docs)
    return _columns(langid.identify(docs, model).where("lang_pred <> 'und'"), docs, langid.NEW)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that of the smallest id; a group is linked by a
    Jaccard similarity of 0.8 on shingles of five words (op6 has 0.9 on three).  Texts
    without words stay."""
    return jaccard.one_of_each(docs, shingle=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold too much of the benchmark go: a twentieth of their words or more.

    Null and empty texts hold nothing and stay; repeated rows are judged alike; an empty table or
    benchmark changes nothing.  Other columns, called like the operator's or not, are kept.
    """
    out = decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark"))
    return _columns(out.where(~decontaminate.contaminated()), docs, decontaminate.NEW)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources by weight, documents in training order; documents left out go, others repeat.

    A document at the end of its source's demand stays whole.  Null sources are a source; texts without
    words are never taken and go; an empty table gives an empty result.  Other columns are kept.
    """
    return mixing.mix_stage(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds ``shard``, 0 to 39, near equal in bytes.

    Rows of one text share a shard unless they fill more than half of one; null and empty texts weigh
    their 16 bytes; an empty table gives an empty result.  A column ``shard`` of the input is kept
    under another name, all others under their own.
    """
    return sharding.shard_stage(docs)


STAGES = [
    ("language ID", language),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mix),
    ("sharding", shards),
]
#: Trained labels and packing can't be written as SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what a stage wrote on its way goes when its result is written."""
    scratch = Scratch(spark, "pipeline")
    docs, last = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        with scratch_scope(spark):
            docs = scratch.write(stage(spark, docs, sf_dir), f"stage-{k}")
        if last is not None:
            scratch.drop(last)
        last = docs
    return docs
