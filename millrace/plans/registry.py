"""Names, queries and their SQL; stand-ins for the relations that the tables lack."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts, spread over the cluster: a file of thin rows is read by few tasks, and what is made of a row is heavy.

    In turn, not by key: unions of parts spread by key gave wrong counts in later groupings (Spark 4.1.2).
    """
    return table(spark, sf_dir, "part").repartition(3 * spark.sparkContext.defaultParallelism)


def stored_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored pages, spread likewise: pages that are alike make small files, and a page costs much more than its bytes."""
    return table(spark, sf_dir, "pages").repartition(3 * spark.sparkContext.defaultParallelism)


# runs and records: orders and their line items
def runs(spark, d) -> DataFrame:
    o = table(spark, d, "orders")
    status = F.when(F.col("o_orderstatus") == "O", "running").when(F.col("o_orderstatus") == "F", "completed").otherwise("failed")
    return o.select(
        F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("user_id"), status.alias("status"),
        F.concat(F.lit("https://www.Shop"), F.col("o_custkey") % 40, F.lit(".example.com/list/"), F.col("o_orderkey"), F.lit("?utm_source=x&page="), F.col("o_orderkey") % 5).alias("url"),
        F.col("o_orderdate").alias("created_at"), F.col("o_totalprice").alias("cost"), F.col("o_orderpriority").alias("priority"),
    )


RUNS = """runs as (select o_orderkey run_id, o_custkey user_id, case when o_orderstatus='O' then 'running' when o_orderstatus='F' then 'completed' else 'failed' end status,
  'https://www.Shop' || (o_custkey % 40) || '.example.com/list/' || o_orderkey || '?utm_source=x&page=' || (o_orderkey % 5) url,
  o_orderdate created_at, o_totalprice cost, o_orderpriority priority from orders)"""


def stored_at() -> list:
    """Where a row of a table lies: its file and its place there, for ties that an order leaves open."""
    return [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place")]


def records(spark, d, *more) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("run_id"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("record_id"),
        F.concat(F.lit("https://shop"), F.col("l_suppkey") % 20, F.lit(".example.com/p/"), F.col("l_partkey")).alias("source_url"),
        F.col("l_partkey").alias("part"), F.col("l_linenumber").cast("bigint").alias("line"), F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("discount"),
        F.col("l_tax").alias("tax"), F.col("l_quantity").alias("quantity"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("line_status"), F.col("l_shipdate").alias("seen_at"), *more,
    )


RECORDS = """records as (select l_orderkey run_id, l_orderkey * 100 + l_linenumber record_id, 'https://shop' || (l_suppkey % 20) || '.example.com/p/' || l_partkey source_url,
  l_partkey part, l_linenumber::bigint line, l_extendedprice price, l_discount discount, l_tax tax, l_quantity quantity, l_returnflag flag, l_linestatus line_status, l_shipdate seen_at from lineitem)"""

VERDICT = """case when flag='A' and line_status='F' then 'blocked' when flag='N' and line_status='F' then 'error' when flag='R' then 'partial' else 'success' end"""


def verdict():
    a, f = F.col("flag"), F.col("line_status")
    return F.when((a == "A") & (f == "F"), "blocked").when((a == "N") & (f == "F"), "error").when(a == "R", "partial").otherwise("success")


def visits(spark, d) -> DataFrame:
    """Visits of pages: events by user; errors have no digest."""
    e = table(spark, d, "events")
    return e.select(
        "event_id", "ts", F.concat(F.lit("https://m.example.com/u/"), F.col("user_id")).alias("url"), "event_type",
        F.when(F.col("event_type") != "error", F.sha2(F.concat(F.col("event_type"), (F.col("event_id") % 2).cast("string")), 256)).alias("digest"),
    )


VISITS = """visits as (select event_id, ts, 'https://m.example.com/u/' || user_id url, event_type,
  case when event_type <> 'error' then sha256(event_type || (event_id % 2)) end digest from events)"""
