"""Budgeted sections and cited facts of customers, and sketches of events merged over weeks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import budgets as B
from ..operators import sketches as K
from ..operators.lineage import settle
from .registry import query, table

SECTIONS = (B.Section("orders", "Orders", 0.5), B.Section("parts", "Parts", 0.5))
BUDGET = 600


def _entries(spark, d):
    o = table(spark, d, "orders")
    orders = o.select(F.col("o_custkey").alias("entity"), F.lit("orders").alias("section"), F.col("o_orderkey").alias("place"), F.concat(F.lit("- order "), F.col("o_orderkey").cast("string"), F.lit(" of priority "), "o_orderpriority", F.lit(", status "), "o_orderstatus").alias("full"), F.concat(F.lit("- #"), F.col("o_orderkey").cast("string")).alias("short"))
    li = o.join(table(spark, d, "lineitem"), F.expr("o_orderkey = l_orderkey")).select("o_custkey", "l_partkey").distinct().join(table(spark, d, "part"), F.expr("l_partkey = p_partkey"))
    parts = li.select(F.col("o_custkey").alias("entity"), F.lit("parts").alias("section"), F.col("p_partkey").alias("place"), F.concat(F.lit("- "), "p_name", F.lit(" by "), "p_brand", F.lit(" ("), "p_type", F.lit(")")).alias("full"), F.concat(F.lit("- "), "p_name").alias("short"))
    return orders.unionByName(parts)


def _section_sql(name, rows, head, share, carry):
    """CTEs of one section; ``carry`` names the table of what the sections before left."""
    room = f"{int(BUDGET * share)} + coalesce(carry, 0)" if carry else str(int(BUDGET * share))
    joined = f"left join {carry} using (entity)" if carry else ""
    return f"""
{name}_e as ({rows}),
{name}_w as (select t.entity, t.entries, t.all_full, {room} as room from (select entity, count(*) as entries, sum(length(f) + 1) as all_full from {name}_e group by 1) t {joined}),
{name}_a as (select *, case when {head} + sum(length(f) + 1) over (partition by entity order by place) <= case when all_full + {head} <= room then room else {head} + {B.FULL_SHARE}::double * (room - {head}) end then 1 else 0 end as is_full from {name}_e join {name}_w using (entity)),
{name}_u as (select *, {head} + sum(case is_full when 1 then length(f) else length(s) end + 1) over (partition by entity order by place) as used from {name}_a),
{name}_s as (select w.entity, w.entries, w.room, count(u.entity) as shown, coalesce(max(u.used), {head}) as used, count(*) filter (where u.is_full = 1) as fulls from {name}_w w left join (select * from {name}_u where is_full = 1 or used <= room) u using (entity) group by all),
{name}_c as (select *, entries - shown as omitted, used + case when entries > shown then {B.OMITTED_SIZE} else 0 end as spent from {name}_s),
{name}_l as (select *, greatest(0, room - spent) as carry from {name}_c)"""


@query(
    "with " + _section_sql("o", "select o_custkey as entity, o_orderkey as place, '- order ' || o_orderkey || ' of priority ' || o_orderpriority || ', status ' || o_orderstatus as f, '- #' || o_orderkey as s from orders", len("## Orders") + 2, 0.5, None)
    + "," + _section_sql("p", "select distinct o_custkey as entity, p_partkey as place, '- ' || p_name || ' by ' || p_brand || ' (' || p_type || ')' as f, '- ' || p_name as s from orders join lineitem on o_orderkey = l_orderkey join part on l_partkey = p_partkey", len("## Parts") + 2, 0.5, "o_l")
    + " select entity, 'orders' as section, shown, omitted, spent::bigint as used, carry::bigint as carry, fulls from o_l union all select entity, 'parts', shown, omitted, spent::bigint, carry::bigint, fulls from p_l")
def snk_06_budgeted_sections(spark, d):
    """Orders and parts of each customer within six hundred characters."""
    texts, told = B.budgeted_sections(_entries(spark, d), SECTIONS, BUDGET)
    fulls = texts.where("form = 'full'").groupBy("entity", "section").agg(F.count("*").alias("fulls"))
    return told.join(fulls, ["entity", "section"], "left").select("entity", "section", "shown", "omitted", "used", "carry", F.coalesce("fulls", F.lit(0).cast("long")).alias("fulls"))


@query("""
with f as (select o_custkey as entity, 1 as k, 'order' as kind, o_orderkey as place, o_orderpriority as text from orders
  union all select distinct o_custkey, 2, 'part', p_partkey, p_name from orders join lineitem on o_orderkey = l_orderkey join part on l_partkey = p_partkey
  union all select c_custkey, 0, 'segment', 0, c_mktsegment from customer),
r as (select *, row_number() over (partition by entity, kind order by place, text) as nth from f)
select entity, 'E' || row_number() over (partition by entity order by k, nth) as citation, kind, text from r where nth <= case kind when 'segment' then 1 when 'order' then 5 else 4 end""")
def gr_68_cited_facts(spark, d):
    """A customer's segment, first five orders and first four parts as numbered facts."""
    o = table(spark, d, "orders")
    orders = o.select(F.col("o_custkey").alias("entity"), F.lit("order").alias("kind"), F.col("o_orderkey").alias("place"), F.col("o_orderpriority").alias("text"))
    parts = o.join(table(spark, d, "lineitem"), F.expr("o_orderkey = l_orderkey")).join(table(spark, d, "part"), F.expr("l_partkey = p_partkey")).select(F.col("o_custkey").alias("entity"), F.lit("part").alias("kind"), F.col("p_partkey").alias("place"), F.col("p_name").alias("text")).distinct()
    segments = table(spark, d, "customer").select(F.col("c_custkey").alias("entity"), F.lit("segment").alias("kind"), F.lit(0).cast("long").alias("place"), F.col("c_mktsegment").alias("text"))
    return B.cited_facts(orders.unionByName(parts).unionByName(segments), {"segment": 1, "order": 5, "part": 4})


@query("""
with e as (select ts::date as day, user_id, value from events), b as (select min(day) as lo, max(day) as hi from e),
w as (select day as first, least(day + 6, hi)::date as last from (select distinct day from e), b)
select strftime(first, '%Y-%m-%d') as first_day, count(*) as rows, count(distinct user_id) as users, true as users_near, true as median_near from w join e on day between first and last group by 1""")
def ext_04_mergeable_sketches(spark, d):
    """Users and the median value of every span of seven days, from states of single days, held against exact figures."""
    e = table(spark, d, "events").select(F.to_date("ts").alias("day"), "user_id", "value")
    states = settle(K.sketch_states(e, "day", "user_id", "value"), "sketches")
    last = e.agg(F.max("day").alias("hi"))
    spans = e.select("day").distinct().join(F.broadcast(last)).select(F.date_format("day", "yyyy-MM-dd").alias("range_id"), F.col("day").alias("first"), F.least(F.date_add("day", 6), "hi").alias("last"))
    merged = K.merged_states(states, spans)
    days = spans.select("range_id", F.explode(F.sequence("first", "last")).alias("day"))
    ranked = e.join(days, "day").join(merged.select("range_id", "median"), "range_id")
    exact = ranked.groupBy("range_id").agg(
        F.count("*").alias("rows"), F.count_distinct("user_id").alias("users"), F.avg((F.col("value") < F.col("median")).cast("double")).alias("below"), F.avg((F.col("value") <= F.col("median")).cast("double")).alias("upto"))
    near = F.abs(F.col("distinct") - F.col("users")) <= F.greatest(F.lit(1.0), F.col("users") * 0.03)
    return exact.join(merged.select("range_id", "distinct"), "range_id").select(F.col("range_id").alias("first_day"), "rows", "users", near.alias("users_near"), ((F.col("below") <= 0.52) & (F.col("upto") >= 0.48)).alias("median_near"))
