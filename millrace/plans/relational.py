"""Scans, filters, joins, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.functions import url as u
from millrace.operators import ranking, relational

from .registry import RECORDS, RUNS, VISITS, query, records, runs, table, visits

DOMAIN_SQL = "regexp_replace(lower(regexp_extract(trim({0}), '^(?:[A-Za-z][A-Za-z0-9+.-]*://)?(?:[^/?#@]*@)?([^/?#]*)', 1)), '^www[.]', '')"


@query("top_domains", f"select {DOMAIN_SQL.format('url')} as domain, count(*) as pages from pages group by 1 order by 2 desc, 1 limit 5")
def top_domains(spark, d):
    pages = table(spark, d, "pages")
    return pages.groupBy(u.domain(F.col("url")).alias("domain")).agg(F.count("*").alias("pages")).orderBy(F.desc("pages"), "domain").limit(5)


@query("list_runs", f"with {RUNS} select run_id, status, url from runs where status = 'completed' and lower(url) like '%shop3.%' order by created_at desc, run_id desc limit 20 offset 20")
def list_runs(spark, d):
    found = relational.list_runs(runs(spark, d), status="completed", url_search="shop3.")
    return relational.page(found, [F.desc("created_at"), F.desc("run_id")], 2, 20).select("run_id", "status", "url")


@query("list_runs_total", f"with {RUNS} select count(*) as total from runs where status = 'completed' and lower(url) like '%shop3.%'")
def list_runs_total(spark, d):
    return relational.list_runs(runs(spark, d), status="completed", url_search="shop3.").agg(F.count("*").alias("total"))


@query("list_users", "select c_custkey as user_id, c_name as email from customer where lower(c_name) like '%00%' and c_acctbal > 0 order by c_custkey limit 50")
def list_users(spark, d):
    c = table(spark, d, "customer").where(relational.contains_text(F.col("c_name"), "00") & (F.col("c_acctbal") > 0))
    return relational.page(c, [F.col("c_custkey")], 1, 50).select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("email"))


@query("active_runs", f"""with {RUNS} select run_id, status, case when run_id % 3 = 0 then (run_id % 100)::int else 0 end as progress from runs where status in ('pending', 'running', 'paused')""")
def active_runs(spark, d):
    summary = F.when(F.col("run_id") % 3 == 0, F.to_json(F.struct((F.col("run_id") % 100).alias("progress")))).otherwise(F.lit("{}"))
    return relational.active_runs(runs(spark, d).withColumn("summary", summary))


@query("user_record_count", f"with {RUNS}, {RECORDS} select count(*) as records from records r join runs using (run_id) where user_id = 7")
def user_record_count(spark, d):
    return relational.records_of_user(records(spark, d), runs(spark, d), 7).agg(F.count("*").alias("records"))


@query("runs_with_logs", f"""with {RUNS}, logs as (select event_id log_id, user_id log_run_id, event_type from events)
  select run_id, log_id, event_type from runs left join logs on run_id = log_run_id and log_id > 500 """)
def runs_with_logs(spark, d):
    logs = table(spark, d, "events").select(F.col("event_id").alias("log_id"), F.col("user_id").alias("log_run_id"), "event_type")
    return relational.runs_with_logs(runs(spark, d), logs, 500).select("run_id", "log_id", "event_type")


@query("log_cursor", "select event_id as log_id, event_type from events where event_id > 700 order by event_id limit 100")
def log_cursor(spark, d):
    return table(spark, d, "events").where("event_id > 700").orderBy("event_id").limit(100).select(F.col("event_id").alias("log_id"), "event_type")


@query("commit_edits", f"""with {RECORDS}, r as (select record_id, min(flag) flag, min(line) line from records group by 1)
  select record_id, flag as old_value, case when line = 1 then 'X' else flag end as new_value, line = 1 and flag <> 'X' as changed from r""")
def commit_edits(spark, d):
    r = records(spark, d).groupBy("record_id").agg(F.min("flag").alias("flag"), F.min("line").alias("line"))
    edits = r.select("record_id", F.when(F.col("line") == 1, "X").otherwise(F.col("flag")).alias("new_value"))
    return relational.commit_edits(edits, r.select("record_id", F.col("flag").alias("old_value"))).select("record_id", "old_value", "new_value", "changed")


@query("backfill_listing", """with a as (select p_partkey id, case when p_partkey % 3 = 0 then null else 'u' || p_partkey end url, p_name title, case when p_partkey % 2 = 0 then null else p_brand end brand from part),
  o as (select 'u' || p_partkey url, upper(p_name) title, 'from ' || p_brand brand from part where p_partkey % 5 <> 0),
  k as (select url, arg_min(brand, title) b from o group by 1), f as (select lower(title) t, arg_min(brand, url) b from o group by 1)
  select id, a.url, title, coalesce(brand, k.b, f.b) as brand from a left join k on a.url = k.url left join f on lower(title) = t""")
def backfill_listing(spark, d):
    p, key = table(spark, d, "part"), F.concat(F.lit("u"), F.col("p_partkey"))
    rows = p.select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 3 != 0, key).alias("url"), F.col("p_name").alias("title"), F.when(F.col("p_partkey") % 2 != 0, F.col("p_brand")).alias("brand"))
    other = p.where("p_partkey % 5 <> 0").select(key.alias("url"), F.upper("p_name").alias("title"), F.concat(F.lit("from "), F.col("p_brand")).alias("brand"))
    return relational.backfill(rows, other, "url", "title", ["brand"])


@query("new_source_urls", f"""with {RECORDS} select distinct source_url from records where run_id % 2 = 1 and source_url not in (select source_url from records where run_id % 2 = 0)""")
def new_source_urls(spark, d):
    r = records(spark, d)
    return relational.new_keys(r.where("run_id % 2 = 1").select("source_url").distinct(), r.where("run_id % 2 = 0"), "source_url")


@query("due_monitors", f"""with m as (select run_id monitor_id, case when status = 'failed' then 'paused' else 'active' end status, case left(priority, 1) when '1' then 'high' when '2' then 'high' when '3' then 'normal' else 'low' end priority,
   case when run_id % 11 = 0 then null else created_at end next_run_at from (with {RUNS} select * from runs))
   select monitor_id, case priority when 'high' then 0 when 'normal' then 1 else 2 end as priority_rank from m where status = 'active' and (next_run_at is null or next_run_at <= timestamp '1998-01-01') order by 2, next_run_at nulls last, 1 limit 200""")
def due_monitors(spark, d):
    level = F.left("priority", F.lit(1))
    m = runs(spark, d).select(
        F.col("run_id").alias("monitor_id"), F.when(F.col("status") == "failed", "paused").otherwise("active").alias("status"),
        F.when(level.isin("1", "2"), "high").when(level == "3", "normal").otherwise("low").alias("priority"), F.when(F.col("run_id") % 11 != 0, F.col("created_at")).alias("next_run_at"),
    )
    return relational.due_monitors(m, F.lit("1998-01-01").cast("timestamp")).limit(200).select("monitor_id", "priority_rank")


@query("dispatch_cap", f"with {RUNS}, c as (select *, row_number() over (partition by priority order by created_at, run_id) n from runs where status = 'running') select run_id, priority from c where priority = '1-URGENT' or n <= 20")
def dispatch_cap(spark, d):
    n = F.row_number().over(Window.partitionBy("priority").orderBy("created_at", "run_id"))
    return runs(spark, d).where("status = 'running'").withColumn("n", n).where((F.col("priority") == "1-URGENT") | (F.col("n") <= 20)).select("run_id", "priority")


@query("latest_per_user", f"with {RUNS} select user_id, arg_max(run_id, (created_at, run_id)) as run_id, max(created_at) as created_at from runs group by 1")
def latest_per_user(spark, d):
    return ranking.latest_per_key(runs(spark, d).select("user_id", "run_id", "created_at"), ["user_id"], "created_at", "run_id")


@query("dedupe_keep_best", f"with {RECORDS} select source_url, record_id, price from (select *, row_number() over (partition by source_url order by price desc, record_id) n from records) where n = 1")
def dedupe_keep_best(spark, d):
    return ranking.best_per_key(records(spark, d), ["source_url"], [F.desc("price"), F.col("record_id")]).select("source_url", "record_id", "price")


@query("capped_candidates", f"""with {RECORDS}, c as (select *, {DOMAIN_SQL.format('source_url')} dom from records), a as (select *, row_number() over (partition by run_id, dom order by price desc, record_id) n from c),
  b as (select *, row_number() over (partition by run_id order by price desc, record_id) m from a where n <= 1) select run_id, dom as "domain", record_id from b where m <= 2""")
def capped_candidates(spark, d):
    r = records(spark, d).withColumn("domain", u.domain(F.col("source_url")))
    return ranking.capped_candidates(r, "run_id", "domain", [F.desc("price"), F.col("record_id")], 1, 2).select("run_id", "domain", "record_id")


@query("merge_richer_rows", f"""with {RECORDS}, r as (select part, record_id, case when record_id % 2 = 0 then '' else flag end flag, case when record_id % 3 = 0 then null else line_status end line_status from records)
  select part, arg_min(record_id, record_id) as record_id, arg_min(flag, record_id) filter (flag <> '') as flag, arg_min(line_status, record_id) filter (line_status is not null) as line_status from r group by part""")
def merge_richer_rows(spark, d):
    r = records(spark, d).select("part", "record_id", F.when(F.col("record_id") % 2 == 0, "").otherwise(F.col("flag")).alias("flag"), F.when(F.col("record_id") % 3 != 0, F.col("line_status")).alias("line_status"))
    return ranking.merge_rows(r, ["part"], ["flag", "line_status"], [F.col("record_id")])


@query("best_candidate_set", f"""with {RECORDS}, s as (select run_id, line_status || flag as name, min(line) o, count(*) n, sum(price) p from records group by 1, 2)
  select run_id, arg_max(name, (n, p, -o)) as best_set, count(*) as sets from s group by 1""")
def best_candidate_set(spark, d):
    r = records(spark, d).withColumn("name", F.concat("line_status", "flag"))
    return ranking.best_set(r, "run_id", "name", "line", [F.count("*").alias("n"), F.sum("price").alias("p")])


@query("field_winners", f"""with {RECORDS}, c as (
   select part, 'flag' field, flag as value, case when line = 1 then 'json_ld' when line = 2 then 'dom' else 'network' end source, record_id idx from records union all
   select part, 'line_status', case when line = 1 then '' else line_status end, case when line = 1 then 'json_ld' when line = 2 then 'dom' else 'network' end, record_id from records),
   r as (select *, case source when 'network' then 0 when 'json_ld' then 1 else 2 end k from c where value <> '')
   select part, field, arg_min(value, (k, idx)) as value, arg_min(source, (k, idx)) as source, count(distinct value) as rivals from r group by 1, 2""")
def field_winners(spark, d):
    r = records(spark, d)
    source = F.when(F.col("line") == 1, "json_ld").when(F.col("line") == 2, "dom").otherwise("network")
    long = r.select("part", source.alias("source"), F.col("record_id").alias("idx"), F.explode(F.array(
        F.struct(F.lit("flag").alias("field"), F.col("flag").alias("value")), F.struct(F.lit("line_status").alias("field"), F.when(F.col("line") == 1, "").otherwise(F.col("line_status")).alias("value"))
    )).alias("x")).select("part", "x.field", "x.value", "source", "idx")
    return ranking.field_winners(long, "part", {"network": 0, "json_ld": 1, "dom": 2})


@query("ordered_distinct", f"with {RECORDS} select source_url, min(record_id) as record_id from records group by 1")
def ordered_distinct(spark, d):
    return ranking.ordered_distinct(records(spark, d), "source_url", "record_id")


@query("union_rules", f"""with {RECORDS}, s as (select distinct part, flag from records where line <= 2), e as (select distinct part, flag from records where line = 3)
  select part, flag, 'saved' as origin from s where part not in (select part from e) union all select part, flag, 'run' from e""")
def union_rules(spark, d):
    r = records(spark, d)
    saved, run = (r.where(w).select("part", "flag").distinct() for w in ("line <= 2", "line = 3"))
    return saved.join(run.select("part").distinct(), "part", "left_anti").withColumn("origin", F.lit("saved")).unionByName(run.withColumn("origin", F.lit("run")))


@query("target_urls", """with c as (select url, page_id * 3 as o from pages union all select trim(url), page_id * 3 + 1 from pages where page_id % 2 = 0 union all select 'not a url', 1)
  select url, min(o) as first_at from c where regexp_matches(url, '^https?://') group by 1""")
def target_urls(spark, d):
    p = table(spark, d, "pages")
    both = p.select("url", (F.col("page_id") * 3).alias("o")).unionByName(p.where("page_id % 2 = 0").select(F.trim("url").alias("url"), (F.col("page_id") * 3 + 1).alias("o"))).unionByName(spark.createDataFrame([("not a url", 1)], "url string, o long"))
    return ranking.ordered_distinct(both.where(F.col("url").rlike("^https?://")), "url", "o").withColumnRenamed("o", "first_at")


@query("table_counts", "select 'customer' as name, count(*) as n from customer union all select 'orders', count(*) from orders union all select 'part', count(*) from part")
def table_counts(spark, d):
    count = lambda t: table(spark, d, t).agg(F.lit(t).alias("name"), F.count("*").alias("n"))
    return count("customer").unionByName(count("orders")).unionByName(count("part"))


@query("visit_history", f"with {VISITS} select url, count(*) as visits, count(distinct digest) as versions, max(ts) as last_visit from visits group by 1")
def visit_history(spark, d):
    return visits(spark, d).groupBy("url").agg(F.count("*").alias("visits"), F.count_distinct("digest").alias("versions"), F.max("ts").alias("last_visit"))
