"""The same operators over the star-schema, event and vector tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmark.functions import text as X
from quillmark.operators import clusters, export, review, sets
from quillmark.operators import rollups as R
from quillmark.runtime import table


def line_usage(s, d):
    q = table(s, d, "lineitem").select("l_returnflag", "l_linestatus", F.col("l_quantity").cast("bigint").alias("q"), F.floor("l_extendedprice").cast("bigint").alias("p"))
    return R.usage(q, ["l_returnflag", "l_linestatus"], "q", "p")


def event_usage(s, d):
    e = table(s, d, "events").select("event_type", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"), F.floor("value").cast("bigint").alias("v"))
    return R.usage(e, ["event_type"], "k", "v")


def event_runs(s, d):
    return R.islands(table(s, d, "events").select("user_id", "event_id", "ts", "event_type"), "user_id", ["ts", "event_id"], "event_type", F.to_date("ts"))


def last_events(s, d):
    return R.latest_state(table(s, d, "events"), "user_id", "event_type", ["ts", "event_id"]).select("user_id", "event_type")


def event_props(s, d):
    return table(s, d, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


def order_priority(s, d):
    """The most frequent priority of each customer, the least of equals."""
    per = table(s, d, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.count("*").alias("n"))
    return per.groupBy("o_custkey").agg(F.min_by("o_orderpriority", F.struct(-F.col("n"), F.col("o_orderpriority"))).alias("priority"), F.sum("n").alias("orders"))


def quantity_upper_median(s, d):
    g = table(s, d, "lineitem").groupBy("l_returnflag", "l_quantity").agg(F.count("*").alias("n"))
    by = W.partitionBy("l_returnflag").orderBy("l_quantity")
    run = g.withColumn("upto", F.sum("n").over(by)).withColumn("total", F.sum("n").over(W.partitionBy("l_returnflag")))
    return run.where("upto > floor(total / 2)").groupBy("l_returnflag").agg(F.min("l_quantity").alias("median"))


def customers_without_orders(s, d):
    return sets.without(table(s, d, "customer").select(F.col("c_custkey").alias("k"), "c_name"), table(s, d, "orders").select(F.col("o_custkey").alias("k")), ["k"])


def keys_missing_or_stale(s, d):
    return sets.missing_and_stale(table(s, d, "lineitem").select(F.col("l_partkey").alias("k")), table(s, d, "part").select(F.col("p_partkey").alias("k")), "k")


def order_upsert(s, d):
    o = table(s, d, "orders").select("o_orderkey", "o_orderstatus", F.floor("o_totalprice").cast("bigint").alias("total"))
    base = o.where("o_orderstatus <> 'P'")
    new = o.where("total > 100000").withColumn("o_orderstatus", F.lit("X"))
    return export.upserted(base, new.select("o_orderkey", "o_orderstatus", "total"), "o_orderkey", ["total"])


def customer_overrides(s, d):
    c = table(s, d, "customer").select("c_custkey", "c_mktsegment", "c_nationkey", "c_acctbal")
    n = table(s, d, "nation").select("n_nationkey", "n_name")
    j = c.join(n, c.c_nationkey == n.n_nationkey, "left")
    return j.select("c_custkey", review.pick(F.when(F.col("c_acctbal") < 0, F.lit("")).when(F.col("c_acctbal") > 9000, F.lit("MANUAL")), F.when(F.col("c_acctbal") > 3000, F.col("c_mktsegment")), "n_name").alias("segment"))


def nearest_centroids(s, d):
    e = table(s, d, "embeddings")
    c = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    c = c.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda v: v["x"]).alias("embedding"))
    return clusters.nearest_labels(e, c).select("vec_id", "label")


def part_options(s, d):
    o = R.distinct_options([(table(s, d, "part"), "p_brand"), (table(s, d, "supplier"), "s_name")], "names")
    return o.select("field", "value")


def newest_orders(s, d):
    return sets.top_n(table(s, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate"), 50, F.desc("o_orderdate"), "o_orderkey")


def built_ids(s, d):
    o = table(s, d, "orders").select("o_orderkey", F.concat(F.lpad(F.lower(F.hex((F.col("o_orderkey") * 9973 + 1_600_000_000) % 4_000_000_000)), 8, "0"), F.lit("00")).alias("h"))
    return o.select("o_orderkey", X.id_stamp("h").alias("stamp"), X.stable_id("o_orderkey").alias("id"))


def nation_roots(s, d):
    """Suppliers and the customers of their nations, as one root per nation."""
    sup = table(s, d, "supplier").groupBy("s_nationkey").agg(F.min("s_suppkey").alias("first_supplier"), F.count("*").alias("suppliers"))
    cus = table(s, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("customers"))
    return sup.join(cus, sup.s_nationkey == cus.c_nationkey, "full_outer").select(F.coalesce("s_nationkey", "c_nationkey").alias("nation"), "first_supplier", F.coalesce("suppliers", F.lit(0)).cast("bigint").alias("suppliers"), F.coalesce("customers", F.lit(0)).cast("bigint").alias("customers"))


QUERIES = {f.__name__: f for f in (line_usage, event_usage, event_runs, last_events, event_props, order_priority, quantity_upper_median, customers_without_orders, keys_missing_or_stale, order_upsert, customer_overrides, nearest_centroids, part_options, newest_orders, built_ids, nation_roots)}

SQL = {
    "line_usage": "select l_returnflag, l_linestatus, count(*) as calls, sum(l_quantity::bigint)::bigint as input, sum(floor(l_extendedprice)::bigint)::bigint as output from lineitem group by all",
    "event_usage": "select event_type, count(*) as calls, sum(json_extract(props, '$.k')::bigint)::bigint as input, sum(floor(value)::bigint)::bigint as output from events group by all",
    "event_runs": """with a as (select *, case when lag(event_type) over w is distinct from event_type or row_number() over w = 1 then 1 else 0 end as s from events window w as (partition by user_id order by ts, event_id)), b as (select *, sum(s) over (partition by user_id order by ts, event_id rows unbounded preceding) as run from a)
  select user_id, run::bigint as run, event_type, count(*) as n, min(ts) as first_at, max(ts) as last_at from b group by user_id, run, event_type""",
    "last_events": "select user_id, event_type from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as r from events) where r = 1",
    "event_props": "select event_id, json_extract(props, '$.k')::bigint as k from events",
    "order_priority": "with p as (select o_custkey, o_orderpriority, count(*) as n from orders group by all), r as (select *, row_number() over (partition by o_custkey order by n desc, o_orderpriority) as r, sum(n) over (partition by o_custkey) as orders from p) select o_custkey, o_orderpriority as priority, orders::bigint as orders from r where r = 1",
    "quantity_upper_median": "select l_returnflag, list_sort(list(l_quantity))[(count(*) // 2) + 1] as median from lineitem group by 1",
    "customers_without_orders": "select c_custkey as k, c_name from customer anti join orders on o_custkey = c_custkey",
    "keys_missing_or_stale": "select k, 'missing' as state from (select distinct l_partkey as k from lineitem) anti join part on p_partkey = k union all select k, 'stale' from (select distinct p_partkey as k from part) anti join lineitem on l_partkey = k",
    "order_upsert": "select o_orderkey, case when floor(o_totalprice)::bigint > 100000 then 'X' else o_orderstatus end as o_orderstatus, floor(o_totalprice)::bigint as total, case when floor(o_totalprice)::bigint > 100000 and o_orderstatus <> 'P' then 'updated' when floor(o_totalprice)::bigint > 100000 then 'new' else 'kept' end as action from orders where o_orderstatus <> 'P' or floor(o_totalprice)::bigint > 100000",
    "customer_overrides": "select c_custkey, coalesce(case when c_acctbal > 9000 then 'MANUAL' end, case when c_acctbal > 3000 then nullif(c_mktsegment, '') end, nullif(n_name, '')) as segment from customer left join nation on n_nationkey = c_nationkey",
    "nearest_centroids": """with x as (select label, i, avg(embedding[i]::double) as x from embeddings, range(1, 65) as t(i) group by all), c as (select label, list(x order by i) as v from x group by label),
  s as (select vec_id, c.label, list_cosine_similarity(embedding::double[], v) as s from embeddings, c) select vec_id, label from (select *, row_number() over (partition by vec_id order by s desc, label) as r from s) where r = 1""",
    "part_options": "select distinct 'names' as field, v as value from (select trim(p_brand) as v from part union all select trim(s_name) from supplier) where v <> ''",
    "newest_orders": "select o_orderkey, o_orderstatus, o_orderdate from orders order by o_orderdate desc, o_orderkey limit 50",
    "built_ids": "select o_orderkey, ((o_orderkey * 9973 + 1600000000) % 4000000000)::bigint * 1000 as stamp, substr(sha256(o_orderkey::varchar), 1, 24) as id from orders",
    "nation_roots": "with s as (select s_nationkey as k, min(s_suppkey) as first_supplier, count(*) as suppliers from supplier group by 1), c as (select c_nationkey as k, count(*) as customers from customer group by 1) select coalesce(s.k, c.k) as nation, first_supplier, coalesce(suppliers, 0) as suppliers, coalesce(customers, 0) as customers from s full outer join c on s.k = c.k",
}
