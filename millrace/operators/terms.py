"""Terms of many dimensions found in texts: runs of words meet terms by equality, the longest first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def dimension_terms(spark: SparkSession, path: str) -> DataFrame:
    """(dimension, term, value) of a multi-line JSON file of attributes.

    The file holds ``{"attributes": [{"name", "values": [{"name", "aliases": [...]}]}]}``; an alias
    stands for its value.  Entries without a name are left out.
    """
    schema = "attributes array<struct<name:string,values:array<struct<name:string,aliases:array<string>>>>>"
    rows = spark.read.option("multiLine", True).schema(schema).json(path).select(F.inline("attributes")).select(F.col("name").alias("dimension"), F.inline("values"))
    rows = rows.select("dimension", F.col("name").alias("value"), F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("term"))
    return rows.where("dimension is not null and value is not null and term is not null").select("dimension", "term", "value")


def _words(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def term_matches(items: DataFrame, item: str, words: str, terms: DataFrame) -> DataFrame:
    """(item, dimension, ord, value, term): the terms in each text, by dimension, in text order.

    Within a dimension matches don't overlap: from the left, the longest term that starts at a
    word wins.  Every run of as many words as some term has meets the terms by equality, so the join
    gives true matches only, whatever the number of terms; its size is that of the texts times
    the longest term's words.  The terms are broadcast only where Spark finds them small.  Texts without
    a match, null texts and rows without ``item`` give no row; of a term with two values the smaller counts.
    """
    known = terms.select("dimension", "value", _words(F.col("term")).alias("w")).where(F.size("w") > 0)
    known = known.groupBy("dimension", F.array_join("w", " ").alias("term"), F.size("w").alias("n")).agg(F.min("value").alias("value"))
    sizes = known.agg(F.coalesce(F.array_sort(F.collect_set("n")), F.array().cast("array<int>"))).scalar()  # a few lengths
    texts = items.where(F.col(item).isNotNull()).select(item, _words(F.coalesce(words, F.lit(""))).alias("w")).withColumn("sizes", sizes)
    runs = F.flatten(F.transform("sizes", lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - n + 1, F.lit(1))), lambda i: F.when(i + n - 1 <= F.size("w"), F.struct(i.alias("at"), n.alias("n"), F.array_join(F.slice("w", i, n), " ").alias("run"))))))
    each = texts.select(item, F.inline(F.array_compact(runs)))
    hits = each.join(known.withColumnRenamed("n", "_n"), each["run"] == known["term"])
    found = hits.groupBy(item, "dimension").agg(F.array_sort(F.collect_set(F.struct("at", (-F.col("n")).alias("less"), "term", "value"))).alias("hits"))  # true matches of one text
    start = F.struct(F.lit(0).alias("upto"), F.array().cast("array<int>").alias("kept"))

    def step(state: Column, x: Column) -> Column:
        taken = F.struct((x["at"] - x["less"] - 1).alias("upto"), F.concat(state["kept"], F.array(x["at"])).alias("kept"))
        return F.when(x["at"] > state["upto"], taken).otherwise(state)

    kept = found.select(item, "dimension", "hits", F.aggregate("hits", start, step)["kept"].alias("kept"))
    first = F.filter("hits", lambda x, i: F.array_contains("kept", x["at"]) & (F.coalesce(F.get("hits", i - 1)["at"], F.lit(0)) != x["at"]))
    return kept.select(item, "dimension", F.posexplode(F.transform(first, lambda x: F.struct(x["value"].alias("value"), x["term"].alias("term")))).alias("ord", "x")).select(item, "dimension", "ord", "x.value", "x.term")
