"""Exports, lists and histories."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import exports
from millrace.sources import html

from .pages import product_pages
from .registry import RECORDS, RUNS, VERDICT, query, records, runs, table, verdict


@query("list_monitors", "select c_custkey as monitor_id, c_mktsegment as status, c_acctbal as updated_at from customer where c_mktsegment = 'BUILDING'")
def list_monitors(spark, d):
    """Customers stand for monitors: their segment is the status, the balance orders them."""
    m = table(spark, d, "customer").select(F.col("c_custkey").alias("monitor_id"), F.col("c_mktsegment").alias("status"), F.col("c_acctbal").alias("updated_at"))
    return exports.equal_filters(m, status="BUILDING", monitor_id=None).orderBy(F.desc("updated_at"), "monitor_id")


@query("list_events", "select event_id, event_type, user_id, (select count(*) from events where event_type = 'purchase') as total from events where event_type = 'purchase' order by ts desc, event_id limit 50 offset 50")
def list_events(spark, d):
    e = exports.equal_filters(table(spark, d, "events"), event_type="purchase")
    return exports.page_with_total(e, [F.desc("ts"), F.col("event_id")], 2, 50).select("event_id", "event_type", "user_id", "total")


@query("unread_notifications", "select user_id, count(*) filter (event_type = 'error') as unread from events group by 1")
def unread_notifications(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("unread"))


@query("export_metadata", "select l_orderkey as run_id, count(*) as total, least(count(*), 4)::bigint as returned, count(*) > 4 as truncated from lineitem group by 1")
def export_metadata(spark, d):
    return exports.export_metadata(records(spark, d), "run_id", 4)


@query("table_export", "select p_partkey, 0 as table_no, 0 as row_no, 'Size' as col_1, p_size::varchar as col_2 from part union all select p_partkey, 0, 1, 'Type', p_type from part")
def table_export(spark, d):
    rows = html.table_rows(html.parse_pages(product_pages(spark, d), "p_partkey", only=("tables",)), "p_partkey")
    return rows.select("p_partkey", "table_no", "row_no", F.col("row")["col_1"].alias("col_1"), F.col("row")["col_2"].alias("col_2"))


@query("catalog_export", "select p_partkey::varchar as id, p_name as title, case when p_partkey % 4 = 0 then '' else p_brand end as brand, 'https://x.example.com/p/' || p_partkey as link, p_retailprice::decimal(12,2)::varchar as price from part")
def catalog_export(spark, d):
    brand = F.when(F.col("p_partkey") % 4 != 0, F.col("p_brand"))
    return exports.fixed_schema(table(spark, d, "part"), {
        "id": F.col("p_partkey"), "title": F.col("p_name"), "brand": brand, "link": F.concat(F.lit("https://x.example.com/p/"), "p_partkey"), "price": F.col("p_retailprice").cast("decimal(12,2)"),
    })


@query("record_bundles", """select p_partkey, '{"record":{"name":"' || p_name || '","size":' || p_size || '},"tables":["' || p_type || '"],"counts":{"tables":1,"evidence":' || case when p_size % 2 = 0 then 2 else 0 end || '}}' as bundle from part""")
def record_bundles(spark, d):
    record = F.struct(F.col("p_name").alias("name"), F.col("p_size").alias("size"))
    evidence = F.when(F.col("p_size") % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array().cast("array<string>"))
    return table(spark, d, "part").select("p_partkey", exports.bundle(record, F.array("p_type"), evidence).alias("bundle"))


@query("source_traces", """select p_partkey, case when p_size % 3 = 0 then 'browser' else 'http' end as method, true as name_found, case when p_size % 5 <> 0 then 'microdata' end as brand_source from part""")
def source_traces(spark, d):
    brand = F.when(F.col("p_size") % 5 != 0, F.col("p_brand")).otherwise(F.lit(" "))
    trace = exports.source_trace(F.when(F.col("p_size") % 3 == 0, "browser").otherwise("http"), F.lit(200), {"name": F.col("p_name"), "brand": brand}, {"name": F.lit("json_ld"), "brand": F.lit("microdata")})
    t = table(spark, d, "part").select("p_partkey", trace.alias("t"))
    found = F.col("t.field_discovery")
    return t.select("p_partkey", F.col("t.acquisition.method").alias("method"), (found["name"] == "json_ld").alias("name_found"), found["brand"].alias("brand_source"))


@query("checked_exports", """with p as (select p_partkey, case p_partkey % 4 when 0 then ' https://x.example.com/p/' || p_partkey when 1 then '/p/' || p_partkey when 2 then '' else 'ftp://x.example.com/p' end u from part)
  select p_partkey, case when regexp_matches(trim(u), '^https?://[^\\s/]+') then trim(u) end as url, case when trim(u) = '' then 'missing url' when not regexp_matches(trim(u), '^https?://[^\\s/]+') then 'url is not absolute' end as error from p""")
def checked_exports(spark, d):
    k, key = F.col("p_partkey") % 4, F.col("p_partkey").cast("string")
    u = F.when(k == 0, F.concat(F.lit(" https://x.example.com/p/"), key)).when(k == 1, F.concat(F.lit("/p/"), key)).when(k == 2, "").otherwise("ftp://x.example.com/p")
    url, error = exports.checked_url(u)
    return table(spark, d, "part").select("p_partkey", url.alias("url"), error.alias("error"))


@query("event_export", """select event_id::varchar as event_id, user_id::varchar as monitor_id, event_type as kind, 'price' as field, '' as old_value, value::decimal(12,2)::varchar as new_value,
  'https://m.example.com/u/' || user_id as url, strftime(ts, '%Y-%m-%d %H:%M:%S') as at, case when event_type = 'error' then 'true' else 'false' end as failed from events""")
def event_export(spark, d):
    """The nine columns of the change export."""
    return exports.fixed_schema(table(spark, d, "events"), {
        "event_id": F.col("event_id"), "monitor_id": F.col("user_id"), "kind": F.col("event_type"), "field": F.lit("price"), "old_value": F.lit(None), "new_value": F.col("value").cast("decimal(12,2)"),
        "url": F.concat(F.lit("https://m.example.com/u/"), "user_id"), "at": F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), "failed": F.col("event_type") == "error",
    })


@query("event_json", """select event_id, '{"event_id":' || event_id || ',"kind":"' || event_type || '","user":' || user_id || '}' as body from events order by event_id limit 100 offset 100""")
def event_json(spark, d):
    body = F.to_json(F.struct("event_id", F.col("event_type").alias("kind"), F.col("user_id").alias("user")))
    return table(spark, d, "events").orderBy("event_id").offset(100).limit(100).select("event_id", body.alias("body"))


@query("snapshot_history", f"with {RUNS}, {RECORDS}, p as (select run_id, count(*) n, max(seen_at) m from records where flag <> 'N' group by 1) select runs.run_id, status, coalesce(n, 0)::bigint as records, m as last_seen from runs left join p using (run_id)")
def snapshot_history(spark, d):
    return exports.history(runs(spark, d).select("run_id", "status"), records(spark, d).where("flag <> 'N'"), "run_id")


@query("selector_summaries", "select p_brand as domain, count(*) as selectors, count(distinct p_type) as fields, max(p_partkey) as latest from part group by 1")
def selector_summaries(spark, d):
    """Parts stand for stored selectors: brand is the domain, type the field."""
    return table(spark, d, "part").groupBy(F.col("p_brand").alias("domain")).agg(F.count("*").alias("selectors"), F.countDistinct("p_type").alias("fields"), F.max("p_partkey").alias("latest"))


@query("run_progress", f"""with {RECORDS}, v as (select run_id, line, part, price, {VERDICT} verdict from records)
  select run_id, line, count(*) over w as done, count(*) filter (verdict = 'success') over w as success, count(*) filter (verdict = 'blocked') over w as blocked from v window w as (partition by run_id order by line, part, price rows unbounded preceding)""")
def run_progress(spark, d):
    r = records(spark, d).select("run_id", "line", "part", "price", verdict().alias("verdict"))
    return exports.progress(r, "run_id", ["line", "part", "price"], "verdict", ["success", "blocked"]).drop("verdict", "part", "price")


@query("host_cache", "select user_id, event_id from events qualify row_number() over (partition by user_id order by ts desc, event_id) <= 3")
def host_cache(spark, d):
    return exports.newest(table(spark, d, "events").select("user_id", "event_id", "ts"), ["user_id"], [F.desc("ts"), F.col("event_id")], 3).drop("ts")


@query("resolved_config", f"""with {RUNS}, s as (select user_id, priority, cost from runs where status = 'failed' qualify row_number() over (partition by user_id order by created_at desc, run_id) = 1)
  select c_custkey as user_id, coalesce(priority, 'none') as priority, coalesce(cost, 0)::double as cost from customer left join s on user_id = c_custkey""")
def resolved_config(spark, d):
    stored = runs(spark, d).where("status = 'failed'").withColumn("cost", F.col("cost").cast("double"))
    keys = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"))
    return exports.resolved(keys, stored, ["user_id"], [F.desc("created_at"), F.col("run_id")], {"priority": "none", "cost": 0.0})


@query("commit_metadata", """with k as (select *, p_partkey % 4 k from part)
 select p_partkey, case k when 0 then 'user' when 1 then 'json_ld' when 2 then p_brand else 'user' end as source, case k when 0 then 2 / 3.0::double when 1 then 1 / 3.0::double when 2 then 2 / 3.0::double else 1 / 4.0::double end as covered,
  case when k = 3 then ['brand', 'color', 'price', 'sku'] else ['title', 'price', 'sku'] end as wanted from k""")
def commit_metadata(spark, d):
    """A field committed by a user where none is known, where one is and stays, where a brand's source stays, and
    where what is known is not asked for."""
    k = F.col("p_partkey") % 4
    had = F.when(k == 2, F.create_map(F.lit("title"), F.lit("json_ld"), F.lit("price"), F.col("p_brand"))).when(k == 3, F.create_map(F.lit("title"), F.lit("dom"))).otherwise(F.create_map(F.lit("title"), F.lit("json_ld")))
    field = F.when(k == 1, "title").when(k == 3, "color").otherwise("price")
    asked = F.when(k == 3, F.array(F.lit("brand"), F.lit("color"))).otherwise(F.array(F.lit("title"), F.lit("price")))
    now = exports.commit_source(had, field, F.lit("user"), keep=True)
    wanted = exports.repaired_fields(asked, ["price", "sku"])
    return table(spark, d, "part").select("p_partkey", F.element_at(now, field).alias("source"), exports.coverage(wanted, now).alias("covered"), wanted.alias("wanted"))
