"""Roll-ups, scores, diffs and states."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import diff, ranking, rollup

from .registry import RECORDS, RUNS, VERDICT, VISITS, query, records, runs, stored_at, table, verdict, visits


@query("status_counts", f"with {RUNS} select status, count(run_id) as runs from runs group by 1")
def status_counts(spark, d):
    return runs(spark, d).groupBy("status").agg(F.count("run_id").alias("runs"))


@query("change_counts", "select user_id as monitor_id, count(*) as changes from events where user_id in (1, 2, 3, 5, 8) and ts > timestamp '2024-01-10' group by 1")
def change_counts(spark, d):
    e = table(spark, d, "events").where(F.col("user_id").isin(1, 2, 3, 5, 8) & (F.col("ts") > F.lit("2024-01-10").cast("timestamp")))
    return e.groupBy(F.col("user_id").alias("monitor_id")).agg(F.count("*").alias("changes"))


@query("operational_metrics", f"""with {RUNS}, l as (select * from runs order by created_at desc, run_id desc limit 1000)
  select round(avg(run_id % 3600), 4) as avg_duration, count(*) filter (run_id % 3600 > 1800) as long_runs, count(*) filter (status = 'running') as running from l""")
def operational_metrics(spark, d):
    last = runs(spark, d).orderBy(F.desc("created_at"), F.desc("run_id")).limit(1000)
    s = F.col("run_id") % 3600
    return last.agg(F.round(F.avg(s), 4).alias("avg_duration"), F.count_if(s > 1800).alias("long_runs"), F.count_if(F.col("status") == "running").alias("running"))


@query("job_summary", f"with {RUNS}, {RECORDS} select user_id, count(distinct run_id) as runs, count(record_id) as records, count(*) filter (flag = 'R') as returned from runs left join records using (run_id) group by 1")
def job_summary(spark, d):
    # records are counted a run first, so the join carries a row a run
    per = records(spark, d).groupBy("run_id").agg(F.count("*").alias("n"), F.count_if(F.col("flag") == "R").alias("r"))
    j = runs(spark, d).join(per, "run_id", "left")
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return j.groupBy("user_id").agg(F.count("*").alias("runs"), zero("n").alias("records"), zero("r").alias("returned"))


@query("run_metrics", f"with {RECORDS} select run_id, count(*) as pages, sum(quantity)::bigint as requests, count(*) filter (discount > 0.05) as retried, max(line) as deepest from records group by 1")
def run_metrics(spark, d):
    return records(spark, d).groupBy("run_id").agg(F.count("*").alias("pages"), F.sum("quantity").cast("bigint").alias("requests"), F.count_if(F.col("discount") > 0.05).alias("retried"), F.max("line").alias("deepest"))


@query("run_histograms", f"with {RECORDS} select run_id, flag, count(*) as n from records group by 1, 2")
def run_histograms(spark, d):
    return rollup.histogram(records(spark, d), ["run_id"], "flag")


@query("quality_summary", f"with {RECORDS} select run_id, round(avg(discount) + 1e-9, 4) as quality, max(quantity) as most, count(*) filter (discount < 0.03) as low from records group by 1")
def quality_summary(spark, d):
    return records(spark, d).groupBy("run_id").agg(F.round(F.avg("discount") + 1e-9, 4).alias("quality"), F.max("quantity").alias("most"), F.count_if(F.col("discount") < 0.03).alias("low"))


@query("url_verdicts", f"""with {RECORDS}, p as (select run_id, count(*) filter (flag <> 'N') n, bool_or(discount > 0.09) b from records group by 1)
  select run_id, case when n > 0 and b then 'partial' when n > 0 then 'success' when b then 'blocked' when run_id % 2 = 0 then 'listing_detection_failed' else 'empty' end as verdict from p""")
def url_verdicts(spark, d):
    p = records(spark, d).groupBy("run_id").agg(F.count_if(F.col("flag") != "N").alias("n"), F.bool_or(F.col("discount") > 0.09).alias("b"))
    return p.select("run_id", rollup.url_verdict(F.col("run_id") % 2 == 0, F.col("b"), F.col("n")).alias("verdict"))


@query("run_verdicts", f"""with {RECORDS}, v as (select run_id, {VERDICT} v from records),
  s as (select run_id, bool_or(v = 'success') ok, bool_or(v = 'partial') pa, bool_or(v = 'error') er, bool_or(v = 'blocked') bl, count(distinct v) k from v group by 1)
  select run_id, case when ok and k = 1 then 'success' when ok or pa then 'partial' when er then 'error' when bl then 'blocked' end as verdict from s""")
def run_verdicts(spark, d):
    return rollup.run_verdict(records(spark, d).withColumn("v", verdict()), "run_id", "v", "line")


@query("run_health", f"""with {RECORDS}, v as (select run_id, {VERDICT} v from records), g as (select run_id, count(*) n, count(*) filter (v not in ('success', 'partial')) f from v group by 1)
  select run_id, n as url_count, f as failure_count, round(f / n, 4) as failure_rate, case when f / n >= 0.25 then 'failed' when f / n >= 0.05 then 'degraded' else 'healthy' end as health from g""")
def run_health(spark, d):
    return rollup.run_health(records(spark, d).withColumn("v", verdict()), "run_id", "v")


@query("fill_rates", """with r as (select p_name a, case when p_partkey % 4 = 0 then '' else p_brand end b, case when p_partkey % 7 = 0 then null else p_type end c from part),
  t as (select 'a' field, count(*) filter (trim(a) <> '') filled, count(*) total from r union all select 'b', count(*) filter (trim(b) <> ''), count(*) from r union all select 'c', count(*) filter (trim(c) <> ''), count(*) from r)
  select field, filled, total, round(filled / total, 4) as fill_rate, filled / total >= 0.8 as passed from t""")
def fill_rates(spark, d):
    k = F.col("p_partkey")
    r = table(spark, d, "part").select(F.col("p_name").alias("a"), F.when(k % 4 == 0, "").otherwise(F.col("p_brand")).alias("b"), F.when(k % 7 != 0, F.col("p_type")).alias("c"))
    return rollup.fill_rates(r, ["a", "b", "c"])


@query("cohort_homogeneity", f"with {RECORDS}, s as (select run_id, flag || line_status g, count(*) n from records group by 1, 2) select run_id, sum(n)::bigint as record_count, max(n) as dominant_count, max(n) / sum(n) as ratio from s group by 1")
def cohort_homogeneity(spark, d):
    return rollup.homogeneity(records(spark, d).withColumn("g", F.concat("flag", "line_status")), "run_id", "g")


@query("listing_integrity", f"""with {RECORDS}, r as (select run_id, flag || line_status g, tax = 0 s, quantity > 40 m, discount > 0.08 u from records),
  p as (select run_id, g, count(*) n, sum(s::int) s, sum(m::int) m, sum(u::int) u from r group by 1, 2),
  t as (select run_id, sum(n)::bigint n, max(n) / sum(n) ratio, sum(s)::bigint s, sum(m)::bigint m, sum(u)::bigint u from p group by 1),
  x as (select *, case when n < 3 and s = n and m = 0 and u = 0 then 'below_min_records' when ratio < 0.5 and not (n >= 5 and u >= greatest(1, floor(n / 2))) then 'cohort_heterogeneous'
    when s = n then 'all_sibling_category_urls' when m = 0 and u = 0 and s > 0 then 'no_support_signals' else 'supported_set' end reason from t)
  select run_id, n as record_count, ratio, s as sibling_count, m as marker_count, u as support_count, reason, case when reason = 'supported_set' then 'product_grid' else 'promo_only_cluster' end as outcome from x""")
def listing_integrity(spark, d):
    r = records(spark, d).select("run_id", F.concat("flag", "line_status").alias("g"), (F.col("tax") == 0).alias("s"), (F.col("quantity") > 40).alias("m"), (F.col("discount") > 0.08).alias("u"))
    return rollup.integrity(r, "run_id", "g", "s", "m", "u")


@query("compliance_scores", f"""with {RECORDS}, z as (select run_id, floor(sum((quantity - 1) * 2 * 0.2) + 1e-9)::bigint raw, max(case when line = 1 and quantity = 1 then 1 else 0 end) g from records group by 1)
   select run_id, case when g = 1 then least(raw, 30) else raw end as overall_score, g = 1 as gate_applied from z""")
def compliance_scores(spark, d):
    r = records(spark, d).select("run_id", F.concat(F.lit("d"), F.col("line")).alias("dim"), ((F.col("quantity") - 1) * 2).alias("score"), F.lit(0.2).alias("weight"))
    return rollup.compliance(r, "run_id", "dim", "score", "weight", "d1")


@query("attribute_coverage", """with a as (select p_partkey item, p_type attribute from part union all select p_partkey, case when p_size > 25 then 'size' else 'other' end from part), w as (select unnest(['ECONOMY', 'SMALL', 'size', 'color']) attribute),
  s as (select attribute, count(distinct item) n from a group by 1) select w.attribute, coalesce(n, 0) as items, round(coalesce(n, 0) / (select count(*) from part), 4) as coverage, round(coalesce(n, 0) / (select count(*) from part), 4) < 0.7 as gap from w left join s using (attribute)""")
def attribute_coverage(spark, d):
    p = table(spark, d, "part")
    a = p.select(F.col("p_partkey").alias("item"), F.col("p_type").alias("attribute")).unionByName(p.select(F.col("p_partkey").alias("item"), F.when(F.col("p_size") > 25, "size").otherwise("other").alias("attribute")))
    return rollup.coverage(a, "item", "attribute", ["ECONOMY", "SMALL", "size", "color"], p.agg(F.count("*")).scalar())


@query("case_clusters", "with v as (select case p_partkey % 3 when 0 then upper(p_name) when 1 then ' ' || p_name else p_name end x from part) select lower(trim(x)) as key, count(distinct x) as spellings, count(*) as n from v group by 1 having count(distinct x) > 1")
def case_clusters(spark, d):
    k = F.col("p_partkey") % 3
    v = table(spark, d, "part").select(F.when(k == 0, F.upper("p_name")).when(k == 1, F.concat(F.lit(" "), F.col("p_name"))).otherwise(F.col("p_name")).alias("x"))
    return rollup.case_clusters(v, "x")


@query("record_confidence", f"""with {RECORDS}, s as (select run_id, round(sum(quantity * (discount * 10) * (1 - tax)) / sum(quantity) + 1e-9, 4) score from records group by 1)
  select run_id, score, case when score >= 0.8 then 'high' when score >= 0.55 then 'medium' else 'low' end as level from s""")
def record_confidence(spark, d):
    r = records(spark, d).select("run_id", F.col("quantity").alias("w"), (F.col("discount") * 10).alias("q"), F.col("tax").alias("p"))
    return rollup.confidence(r, "run_id", "w", "q", "p")


@query("source_shares", f"with {RECORDS}, p as (select run_id, flag, sum(quantity) w from records group by 1, 2) select run_id, flag, round(w / sum(w) over (partition by run_id) + 1e-9, 4) as share from p")
def source_shares(spark, d):
    return rollup.source_shares(records(spark, d), "run_id", "flag", "quantity")


@query("snapshot_diff", f"""with {RECORDS}, a as (select part, flag, price_text from (select part, flag, '$' || quantity::bigint as price_text, row_number() over (partition by part order by record_id) n from records where run_id % 2 = 0) where n = 1),
   b as (select part, flag, price_text from (select part, lower(flag) flag, quantity::bigint || ' USD' as price_text, row_number() over (partition by part order by record_id desc) n from records where run_id % 3 = 0) where n = 1),
   j as (select coalesce(a.part, b.part) part, a.part pa, b.part pb, a.flag fa, b.flag fb, a.price_text xa, b.price_text xb from a full join b on a.part = b.part)
   select part, 'record_new' as event_type, null::varchar as field_name, null::varchar as old_value, null::varchar as new_value from j where pa is null union all
   select part, 'record_removed', null, null, null from j where pb is null union all
   select part, 'field_changed', 'flag', fa, fb from j where pa is not null and pb is not null and lower(fa) is distinct from lower(fb) union all
   select part, 'field_changed', 'price', xa, xb from j where pa is not null and pb is not null and regexp_extract(xa, '([0-9]+)', 1) is distinct from regexp_extract(xb, '([0-9]+)', 1)""")
def snapshot_diff(spark, d):
    r = records(spark, d, *stored_at())
    q = F.rint("quantity").cast("bigint").cast("string")  # halves to even, as the SQL's cast
    # lines of one number in an order tie: the one stored first stands, as in its SQL; missing numbers come last both ways
    a = ranking.best_per_key(r.where("run_id % 2 = 0"), ["part"], [F.asc_nulls_last("record_id"), F.col("file"), F.col("place")]).select("part", "flag", F.concat(F.lit("$"), q).alias("price"))
    b = ranking.best_per_key(r.where("run_id % 3 = 0"), ["part"], [F.desc_nulls_last("record_id"), F.col("file"), F.col("place")]).select("part", F.lower("flag").alias("flag"), F.concat(q, F.lit(" USD")).alias("price"))
    return diff.snapshot_diff(a, b, "part", ["flag", "price"], plain=("flag",))


@query("page_states", f"""with {VISITS}, a as (select *, row_number() over w = 1 or digest is null or digest is distinct from lag(digest) over w as changed from visits window w as (partition by url order by ts, event_id)),
   b as (select *, sum(changed::int) over (partition by url order by ts, event_id rows unbounded preceding) g from a)
   select event_id, url, changed, row_number() over (partition by url, g order by ts, event_id) - 1 as unchanged_count from b""")
def page_states(spark, d):
    return diff.page_states(visits(spark, d), "url", "ts", "event_id", "digest").select("event_id", "url", "changed", "unchanged_count")


@query("retention", "select event_id, e.user_id from events e join (select distinct user_id, (user_id % 15)::int retention_days from events) o on e.user_id = o.user_id where ts >= timestamp '2024-01-31' - to_days(greatest(retention_days, 1))")
def retention(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "ts")
    owners = e.select("user_id", (F.col("user_id") % 15).cast("int").alias("retention_days")).distinct()
    return diff.retain(e, owners, "user_id", "ts", F.lit("2024-01-31").cast("timestamp")).select("event_id", "user_id")


@query("change_alerts", "select user_id, count(*) as event_count from events where event_type = 'error' group by 1")
def change_alerts(spark, d):
    e = table(spark, d, "events").withColumn("event_type", F.when(F.col("event_type") == "error", "field_changed").otherwise("record_new"))
    return diff.change_alerts(e, "user_id")


@query("failure_streaks", """with a as (select user_id, ts, event_id, event_type = 'error' f, sum((event_type <> 'error')::int) over (partition by user_id order by ts, event_id rows unbounded preceding) g from events)
   select user_id, min(ts) as since, count(*) as failures, count(*) >= 2 as stale from a where f group by user_id, g""")
def failure_streaks(spark, d):
    e = table(spark, d, "events").withColumn("failed", F.col("event_type") == "error")
    return diff.failure_streaks(e, "user_id", "ts", "event_id", "failed")


@query("blocked_hosts", """with b as (select user_id % 20 host, ts from events where event_type = 'error'), l as (select *, lag(ts) over (partition by host order by ts) p from b),
   a as (select *, sum(coalesce(epoch(date_trunc('second', ts))::bigint - epoch(date_trunc('second', p))::bigint > 7200, true)::int) over (partition by host order by ts rows unbounded preceding) g from l),
   r as (select host, g, count(*) n, max(ts) t from a group by 1, 2), z as (select host, arg_max(n, g) blocks, max(t) last_block from r group by 1)
   select host, blocks, last_block, blocks >= 2 and epoch(timestamp '2024-01-31')::bigint - epoch(date_trunc('second', last_block))::bigint <= 7200 as avoid from z""")
def blocked_hosts(spark, d):
    e = table(spark, d, "events").where("event_type = 'error'").select((F.col("user_id") % 20).alias("host"), "ts")
    return diff.blocked_hosts(e, "host", "ts", 7200, 2, F.lit("2024-01-31").cast("timestamp"))


@query("failure_windows", "select date_trunc('day', ts) as day, event_type as provider, count(*) as failures from events where event_type = 'error' group by 1, 2 having count(*) >= 3")
def failure_windows(spark, d):
    e = table(spark, d, "events").where("event_type = 'error'")
    return e.groupBy(F.window("ts", "1 day").alias("w"), F.col("event_type").alias("provider")).agg(F.count("*").alias("failures")).where("failures >= 3").select(F.col("w.start").alias("day"), "provider", "failures")


@query("stale_runs", f"with {RUNS} select run_id from runs where status = 'running' and epoch(timestamp '1998-06-01')::bigint - epoch(created_at)::bigint >= 5400")
def stale_runs(spark, d):
    r = runs(spark, d).select("run_id", "status", F.lit(None).cast("timestamp").alias("last_heartbeat_at"), F.lit(None).cast("timestamp").alias("updated_at"), "created_at")
    return diff.stale_runs(r, F.lit("1998-06-01").cast("timestamp"), 5400).select("run_id")
