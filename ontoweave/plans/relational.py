"""Joins, aggregations, windows, sorts and set operations, bound to the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.lineage import parts_for, settle
from ..operators.topk import best_per_key, rank_of_truth, round_robin, top_per_group
from .registry import query, table


@query("select n_name, r_name, count(*) as customers from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by all")
def jn_01_inner_dimension(spark, d):
    return (
        table(spark, d, "customer").join(table(spark, d, "nation"), F.expr("c_nationkey = n_nationkey")).join(table(spark, d, "region"), F.expr("n_regionkey = r_regionkey"))
        .groupBy("n_name", "r_name").agg(F.count("*").alias("customers"))
    )


@query("select c_custkey, count(o_orderkey) as orders, round(coalesce(sum(o_totalprice), 0), 2) as spent from customer left join orders on c_custkey = o_custkey group by 1")
def jn_02_left_outer(spark, d):
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("s"))
    return table(spark, d, "customer").join(o, F.expr("c_custkey = o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("orders"), F.round(F.coalesce("s", F.lit(0.0)), 2).alias("spent"))


@query("select p_partkey, p_name from part where p_partkey in (select l_partkey from lineitem where l_quantity > 49)")
def jn_03_semi(spark, d):
    return table(spark, d, "part").join(table(spark, d, "lineitem").where("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_semi").select("p_partkey", "p_name")


@query("select doc_id from documents where doc_id not in (select doc_id from labels)")
def jn_05_anti(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left_anti").select("doc_id")


@query("with f as (select distinct o_custkey, l_partkey from lineitem join orders on l_orderkey = o_orderkey) select a.o_custkey as a, b.o_custkey as b, count(*) as shared from f a join f b on a.l_partkey = b.l_partkey and a.o_custkey < b.o_custkey group by all having count(*) >= 3")
def jn_06_inverted_index_pairs(spark, d):
    """Customers that share three parts or more; a part has a bounded number of buyers, however many customers there are."""
    li = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.expr("l_orderkey = o_orderkey"))
    f = settle(li.select("o_custkey", "l_partkey").distinct(), "buyers")
    # A task counts its pairs in memory, so there are as many tasks as the pairs need.
    n = F.count("*").cast("long")
    met = f.groupBy("l_partkey").agg((n * (n - 1) / 2).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0.0))).first()[0]
    pairs = f.toDF("a", "part").join(f.toDF("b", "part"), "part").where("a < b").select("a", "b").repartition(parts_for(int(met), 2_000_000), "a", "b")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("shared")).where("shared >= 3")


@query("select o.o_orderkey, l_linenumber, o_orderdate::varchar as ordered from orders o join lineitem on l_orderkey = o_orderkey where l_shipdate < o_orderdate + interval 3 day and l_shipdate > o_orderdate")
def jn_07_theta_after_equi(spark, d):
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    near = F.expr("l_orderkey = o_orderkey and l_shipdate < o_orderdate + interval 3 days and l_shipdate > o_orderdate")
    return o.join(li, near).select("o_orderkey", "l_linenumber", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("ordered"))


@query("select s.s_suppkey, c.c_custkey from supplier s join customer c on lower(replace(s.s_name, 'Supplier', 'Customer')) = lower(c.c_name)")
def jn_10_case_insensitive(spark, d):
    s, c = table(spark, d, "supplier"), table(spark, d, "customer")
    return s.join(c, F.lower(F.replace("s_name", F.lit("Supplier"), F.lit("Customer"))) == F.lower("c_name")).select("s_suppkey", "c_custkey")


@query("select distinct o_orderkey from orders join customer on o_custkey = c_custkey where c_mktsegment = 'BUILDING' or o_orderpriority = '1-URGENT'")
def jn_11_or_join_as_union(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    known = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"))
    return o.join(c, "o_custkey", "left_semi").select("o_orderkey").union(o.where("o_orderpriority = '1-URGENT'").join(known, "o_custkey", "left_semi").select("o_orderkey")).distinct()


@query("with y as (select o_custkey, p_brand, sum(l_quantity) as q from orders join lineitem on o_orderkey = l_orderkey join part on p_partkey = l_partkey group by all), x as (select *, max((p_brand = 'Brand#11')::int) over (partition by o_custkey) as has from y) select o_custkey, p_brand, q from x where p_brand = 'Brand#11' or (has = 0 and q >= 100)")
def jn_13_preferred_else_fallback(spark, d):
    li = table(spark, d, "lineitem").join(table(spark, d, "part"), F.expr("l_partkey = p_partkey"))
    x = table(spark, d, "orders").join(li, F.expr("o_orderkey = l_orderkey")).groupBy("o_custkey", "p_brand").agg(F.sum("l_quantity").alias("q"))
    has = F.max((F.col("p_brand") == "Brand#11").cast("int")).over(Window.partitionBy("o_custkey"))
    return x.withColumn("has", has).where("p_brand = 'Brand#11' or (has = 0 and q >= 100)").drop("has")


@query("with w as (select distinct doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}]+')) as w from documents), k as (select distinct lower(string_split(p_name, ' ')[2]) as k from part union select distinct lower(n) from (values ('The'), ('Des'), ('Und'), ('Las')) t(n)) select k as name, count(distinct doc_id) as docs from w join k on w = k group by 1")
def jn_14_contains_join(spark, d):
    """Documents whose text holds a name as a word: the words are the key, so no text meets every name."""
    names = table(spark, d, "part").select(F.lower(F.split("p_name", " ")[1]).alias("name")).distinct().union(spark.createDataFrame([("the",), ("des",), ("und",), ("las",)], "name string"))
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[\\p{L}]+"), 0))
    held = table(spark, d, "documents").select("doc_id", F.explode(words).alias("name"))
    return held.join(names.distinct(), "name").groupBy("name").agg(F.count_distinct("doc_id").alias("docs"))


@query("with t as (select p_partkey::varchar as tn from part), e as (select tn, substr(tn, 1, length(tn) - 1) as up from t where length(tn) > 1) select e.tn as child, t.tn as parent from e join t on e.up = t.tn")
def jn_16_tree_number_prefix(spark, d):
    t = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("tn"))
    child = t.where("length(tn) > 1").select(F.col("tn").alias("child"), F.expr("substr(tn, 1, length(tn) - 1)").alias("parent"))
    return child.join(t.select(F.col("tn").alias("parent")), "parent").select("child", "parent")


@query("select event_id from events e where user_id < 20 or exists (select 1 from events s where s.user_id = e.user_id and s.event_type = 'purchase' and s.value > 90)")
def jn_19_owned_or_shared(spark, d):
    e = table(spark, d, "events")
    shared = e.where("event_type = 'purchase' and value > 90").select("user_id")
    return e.where("user_id < 20").select("event_id").union(e.join(shared, "user_id", "left_semi").select("event_id")).distinct()


@query("select event_type, count(*) as n, count(distinct user_id) as users, round(sum(value), 4) as total, min(value) as low, max(value) as high from events group by 1")
def o_agg_01_counts(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.round(F.sum("value"), 4).alias("total"), F.min("value").alias("low"), F.max("value").alias("high"))


@query("select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, round(avg(l_discount), 6) as avg_disc, count(*) as n from lineitem where l_shipdate <= timestamp '1998-09-02' group by all")
def o_agg_02_sum_group(spark, d):
    rows = table(spark, d, "lineitem").where("l_shipdate <= timestamp_ntz '1998-09-02 00:00:00'")
    revenue = F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(revenue, 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


@query("select l_orderkey, round(1 - product(1 - least(greatest(l_discount, 0), 1)), 6) as any_discount from lineitem group by 1")
def o_agg_07_noisy_or(spark, d):
    from ..functions.scores import noisy_or

    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.round(noisy_or(F.col("l_discount")), 6).alias("any_discount"))


@query("select l_suppkey, list_sort(list(distinct l_returnflag)) as flags, count(distinct l_partkey) as parts from lineitem group by 1")
def o_agg_08_set_union(spark, d):
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.sort_array(F.collect_set("l_returnflag")).alias("flags"), F.count_distinct("l_partkey").alias("parts"))


@query("select text_key, count(distinct source) as support, min(doc_id) as first_doc from (select md5(text) as text_key, source, doc_id from documents) group by 1 having count(distinct source) >= 2")
def o_agg_09_support(spark, d):
    x = table(spark, d, "documents").select(F.md5("text").alias("text_key"), "source", "doc_id")
    return x.groupBy("text_key").agg(F.count_distinct("source").alias("support"), F.min("doc_id").alias("first_doc")).where("support >= 2")


@query("with s as (select c_nationkey, o_custkey, sum(o_totalprice) as spent from orders join customer on o_custkey = c_custkey group by all), r as (select *, dense_rank() over (partition by c_nationkey order by spent desc) as rank from s), m as (select c_nationkey, avg(1.0 / rank) as mrr, avg((rank <= 3)::int) as top3 from r group by 1) select 'micro' as level, round((select avg(1.0 / rank) from r), 6) as mrr, round((select avg((rank <= 3)::int) from r), 6) as top3 union all select 'macro', round(avg(mrr), 6), round(avg(top3), 6) from m")
def o_agg_10_micro_macro(spark, d):
    x = table(spark, d, "orders").join(table(spark, d, "customer"), F.expr("o_custkey = c_custkey")).groupBy("c_nationkey", "o_custkey").agg(F.sum("o_totalprice").alias("spent"))
    r = x.withColumn("rank", F.dense_rank().over(Window.partitionBy("c_nationkey").orderBy(F.desc("spent"))))
    stats = [F.avg(1.0 / F.col("rank")).alias("mrr"), F.avg((F.col("rank") <= 3).cast("int")).alias("top3")]
    macro = r.groupBy("c_nationkey").agg(*stats).agg(F.avg("mrr").alias("mrr"), F.avg("top3").alias("top3"))
    shown = lambda df, name: df.select(F.lit(name).alias("level"), F.round("mrr", 6).alias("mrr"), F.round("top3", 6).alias("top3"))
    return shown(r.agg(*stats), "micro").union(shown(macro, "macro"))


@query("select c_custkey, coalesce(o.n, 0)::bigint as orders, coalesce(l.n, 0)::bigint as lines from customer left join (select o_custkey, count(*) as n from orders group by 1) o on o.o_custkey = c_custkey left join (select o_custkey, count(*) as n from orders join lineitem on l_orderkey = o_orderkey group by 1) l on l.o_custkey = c_custkey")
def o_agg_11_12_correlated_counts(spark, d):
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    a = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders"))
    b = o.join(li, F.expr("l_orderkey = o_orderkey")).groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("lines"))
    return table(spark, d, "customer").select("c_custkey").join(a, "c_custkey", "left").join(b, "c_custkey", "left").na.fill(0)


@query("with x as (select l_orderkey, p_brand from lineitem join part on l_partkey = p_partkey group by all), n as (select p_brand, count(*) as df from x group by 1), k as (select x.* from x join n using (p_brand) where df <= greatest(3, 0.2 * (select count(distinct l_orderkey) from x))) select a.p_brand as a, b.p_brand as b, count(*) as shared from k a join k b on a.l_orderkey = b.l_orderkey and a.p_brand < b.p_brand group by all having count(*) >= 2")
def o_agg_13_cooccurrence(spark, d):
    x = table(spark, d, "lineitem").join(table(spark, d, "part"), F.expr("l_partkey = p_partkey")).select("l_orderkey", "p_brand").distinct()
    groups = x.select(F.count_distinct("l_orderkey")).first()[0]
    common = x.groupBy("p_brand").agg(F.count("*").alias("df")).where(F.col("df") <= max(3.0, 0.2 * groups)).select("p_brand")
    k = x.join(F.broadcast(common) if common.count() <= 100_000 else common, "p_brand", "left_semi").select("l_orderkey", "p_brand")
    return k.toDF("k", "a").join(k.toDF("k", "b"), "k").where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared")).where("shared >= 2")


@query("select count(*) as events, count(*) filter (event_type = 'purchase') as purchases, count(*) filter (value > 50) as large, count(distinct user_id) as users, count(props) as with_props, sum((props is null)::int)::bigint as without_props from events")
def o_agg_15_coverage(spark, d):
    return table(spark, d, "events").agg(
        F.count("*").alias("events"), F.count_if(F.col("event_type") == "purchase").alias("purchases"), F.count_if(F.col("value") > 50).alias("large"),
        F.count_distinct("user_id").alias("users"), F.count("props").alias("with_props"), F.count_if(F.col("props").isNull()).alias("without_props"),
    )


@query("with h as (select distinct source, md5(text) as k from documents), o as (select k, count(*) as n from h group by 1) select source, count(*) as total, sum((n = 1)::int)::bigint as only_here from h join o using (k) group by 1")
def o_agg_16_provider_overlap(spark, d):
    h = table(spark, d, "documents").select("source", F.md5("text").alias("k")).distinct()
    o = h.groupBy("k").agg(F.count("*").alias("n"))
    return h.join(o, "k").groupBy("source").agg(F.count("*").alias("total"), F.count_if(F.col("n") == 1).alias("only_here"))


@query("select o_custkey, '[' || string_agg('{\"key\":' || o_orderkey || ',\"status\":\"' || o_orderstatus || '\"}', ',' order by o_orderkey) || ']' as orders from orders group by 1")
def o_agg_22_ordered_json(spark, d):
    items = F.array_sort(F.collect_list(F.struct(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"))))
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.to_json(items).alias("orders"))


@query("select l_suppkey, l_partkey, l_orderkey, l_linenumber, rn from (select *, row_number() over (partition by l_suppkey order by l_extendedprice desc, l_orderkey, l_linenumber)::int as rn from lineitem) where rn <= 10")
def win_01_top_10_per_group(spark, d):
    rows = top_per_group(table(spark, d, "lineitem"), ["l_suppkey"], [F.desc("l_extendedprice"), "l_orderkey", "l_linenumber"], 10)
    return rows.select("l_suppkey", "l_partkey", "l_orderkey", "l_linenumber", "rn")


@query("with b as (select l_suppkey, l_partkey, max(l_extendedprice) as price from lineitem group by all) select l_suppkey, l_partkey, price, rn from (select *, row_number() over (partition by l_suppkey order by price desc, l_partkey)::int as rn from b) where rn <= 50")
def win_02_dedupe_then_head(spark, d):
    b = table(spark, d, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.max("l_extendedprice").alias("price"))
    return top_per_group(b, ["l_suppkey"], [F.desc("price"), "l_partkey"], 50)


@query("with t as (select p_type, p_partkey, row_number() over (partition by p_type order by p_retailprice desc, p_partkey)::int as turn from part) select p_type, p_partkey, turn, row_number() over (order by turn, p_type)::int as place from t qualify row_number() over (order by turn, p_type) <= 40")
def win_03_round_robin(spark, d):
    rows = round_robin(table(spark, d, "part").select("p_type", "p_partkey", "p_retailprice"), "p_type", [F.desc("p_retailprice"), "p_partkey"], 40)
    return rows.select("p_type", "p_partkey", "turn", "place")


@query("with t as (select p_brand, p_size, p_partkey, row_number() over (partition by p_brand order by p_partkey)::int as turn from part), f as (select * from t qualify row_number() over (partition by p_size order by turn, p_brand) = 1) select p_brand, p_size, p_partkey, turn, row_number() over (order by turn, p_brand)::int as place from f qualify row_number() over (order by turn, p_brand) <= 30")
def win_03_round_robin_seen_once(spark, d):
    return round_robin(table(spark, d, "part").select("p_brand", "p_size", "p_partkey"), "p_brand", ["p_partkey"], 30, ["p_size"])


@query("select o_custkey, o_orderkey, o_orderdate::varchar as ordered from orders qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) = 1")
def win_04_latest_per_key(spark, d):
    rows = best_per_key(table(spark, d, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")])
    return rows.select("o_custkey", "o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("ordered"))


@query("select l_partkey, min(l_extendedprice) as price, arg_min(l_suppkey, l_extendedprice * 1e9 + l_suppkey) as l_suppkey from lineitem group by 1")
def win_05_best_row(spark, d):
    best = F.min(F.struct("l_extendedprice", "l_suppkey"))
    return table(spark, d, "lineitem").groupBy("l_partkey").agg(best.alias("b")).select("l_partkey", F.col("b.l_extendedprice").alias("price"), F.col("b.l_suppkey").alias("l_suppkey"))


@query("with s as (select c_mktsegment, o_custkey, sum(o_totalprice) as spent from orders join customer on o_custkey = c_custkey group by all), r as (select *, row_number() over (partition by c_mktsegment order by spent desc, o_custkey)::int as rank from s), t as (select c_mktsegment, c_custkey as o_custkey from customer where c_acctbal > 9900) select c_mktsegment, min(rank) as rank from t left join r using (c_mktsegment, o_custkey) group by 1")
def win_06_rank_of_truth(spark, d):
    c = table(spark, d, "customer")
    x = table(spark, d, "orders").join(c, F.expr("o_custkey = c_custkey")).groupBy("c_mktsegment", "o_custkey").agg(F.sum("o_totalprice").alias("s"))
    ranking = x.withColumn("rank", F.row_number().over(Window.partitionBy("c_mktsegment").orderBy(F.desc("s"), "o_custkey")))
    return rank_of_truth(ranking, c.where("c_acctbal > 9900").select("c_mktsegment", F.col("c_custkey").alias("o_custkey")), "c_mktsegment", "o_custkey")


@query("select c_nationkey, c_custkey from customer qualify row_number() over (partition by c_nationkey order by md5('13:' || c_custkey), c_custkey) <= 5")
def win_07_seeded_sample(spark, d):
    rows = top_per_group(table(spark, d, "customer"), ["c_nationkey"], [F.md5(F.concat(F.lit("13:"), F.col("c_custkey").cast("string"))), "c_custkey"], 5)
    return rows.select("c_nationkey", "c_custkey")


@query("select p_partkey, round(p_retailprice - 0.02 * (p_size - 20), 4) as score from part order by score, p_partkey limit 25")
def tk_02_custom_score(spark, d):
    return table(spark, d, "part").select("p_partkey", F.round(F.col("p_retailprice") - 0.02 * (F.col("p_size") - 20), 4).alias("score")).orderBy("score", "p_partkey").limit(25)


@query("select p_partkey, p_name from part where lower(p_name) like '%red%' or lower(p_name) like '%ring%' order by (lower(p_name) like '%ring') desc, (lower(p_name) like 'red%') desc, length(p_name), p_partkey limit 200")
def tk_04_boolean_order(spark, d):
    p = table(spark, d, "part").where("lower(p_name) like '%red%' or lower(p_name) like '%ring%'")
    return p.orderBy(F.expr("lower(p_name) like '%ring'").desc(), F.expr("lower(p_name) like 'red%'").desc(), F.length("p_name"), "p_partkey").limit(200).select("p_partkey", "p_name")


@query("select o_orderkey, o_orderpriority from orders where o_orderstatus = 'F' order by case o_orderpriority when '1-URGENT' then 0 when '2-HIGH' then 1 else 9 end, o_orderkey limit 30")
def tk_05_ordinal_sort(spark, d):
    stage = F.when(F.col("o_orderpriority") == "1-URGENT", 0).when(F.col("o_orderpriority") == "2-HIGH", 1).otherwise(9)
    return table(spark, d, "orders").where("o_orderstatus = 'F'").orderBy(stage, "o_orderkey").limit(30).select("o_orderkey", "o_orderpriority")


@query("select event_id, coalesce(json_extract_string(props, '$.k')::bigint, -1) as k from events order by 2 desc, 1 limit 50")
def tk_06_json_sort(spark, d):
    return table(spark, d, "events").select("event_id", F.coalesce(F.get_json_object("props", "$.k").cast("bigint"), F.lit(-1)).alias("k")).orderBy(F.desc("k"), "event_id").limit(50)


@query("select c_custkey, c_name from customer order by c_acctbal desc, c_custkey limit 20 offset 40")
def tk_07_page(spark, d):
    return table(spark, d, "customer").orderBy(F.desc("c_acctbal"), "c_custkey").offset(40).limit(20).select("c_custkey", "c_name")


@query("select l_orderkey from lineitem where l_returnflag = 'R' intersect select l_orderkey from lineitem where l_returnflag = 'N' intersect select l_orderkey from lineitem where l_quantity > 45")
def set_01_intersect(spark, d):
    li = table(spark, d, "lineitem")
    part = lambda c: li.where(c).select("l_orderkey")
    return part("l_returnflag = 'R'").intersect(part("l_returnflag = 'N'")).intersect(part("l_quantity > 45"))


@query("select 0 as priority, p_partkey from part where p_brand = 'Brand#12' union all select 1, p_partkey from part where p_brand like 'Brand#1%' and p_brand <> 'Brand#12'")
def set_02_union_priority(spark, d):
    p = table(spark, d, "part")
    exact = p.where("p_brand = 'Brand#12'").select(F.lit(0).alias("priority"), "p_partkey")
    return exact.unionByName(p.where("p_brand like 'Brand#1%' and p_brand <> 'Brand#12'").select(F.lit(1).alias("priority"), "p_partkey"))


@query("with t as (select min(doc_id) as e, text from documents group by text), f as (select distinct e, unnest(regexp_extract_all(lower(text), '[\\p{L}]+')) as f from t), n as (select e, count(*) as n from f group by 1) select a.e as a, b.e as b, count(*) as shared, round(count(*) / (any_value(x.n) + any_value(y.n) - count(*)), 6) as jaccard from f a join f b on a.f = b.f and a.e < b.e join n x on x.e = a.e join n y on y.e = b.e group by a.e, b.e having count(*) / (any_value(x.n) + any_value(y.n) - count(*)) >= 0.4")
def set_04_jaccard_pairs(spark, d):
    """Different texts that share four tenths of their words."""
    from ..operators.similarity import jaccard_pairs
    from .graphs import _text_words

    return jaccard_pairs(_text_words(spark, d), 0.4).select("a", "b", "shared", F.round("jaccard", 6).alias("jaccard"))


@query("with u as (select c_custkey as k, 0 as o from customer where c_acctbal > 9000 union all select o_custkey, 1 from orders where o_totalprice > 400000) select k, min(o) as first_source from u group by 1")
def set_05_first_wins(spark, d):
    a = table(spark, d, "customer").where("c_acctbal > 9000").select(F.col("c_custkey").alias("k"), F.lit(0).alias("o"))
    b = table(spark, d, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("k"), F.lit(1).alias("o"))
    return a.union(b).groupBy("k").agg(F.min("o").alias("first_source"))


@query("select distinct o_custkey, l_partkey from orders join lineitem on l_orderkey = o_orderkey where o_orderstatus = 'O' except select o_custkey, l_partkey from orders join lineitem on l_orderkey = o_orderkey where l_returnflag = 'R'")
def set_06_except(spark, d):
    """Parts in open orders of a customer who has never returned them."""
    li = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.expr("l_orderkey = o_orderkey"))
    return li.where("o_orderstatus = 'O'").select("o_custkey", "l_partkey").subtract(li.where("l_returnflag = 'R'").select("o_custkey", "l_partkey"))


@query("select r_name, c_mktsegment, count(*) as n, grouping(r_name)::int as g1, grouping(c_mktsegment)::int as g2 from customer join nation on c_nationkey = n_nationkey join region on r_regionkey = n_regionkey group by cube (r_name, c_mktsegment)")
def ext_04_cube(spark, d):
    x = table(spark, d, "customer").join(table(spark, d, "nation"), F.expr("c_nationkey = n_nationkey")).join(table(spark, d, "region"), F.expr("r_regionkey = n_regionkey"))
    return x.cube("r_name", "c_mktsegment").agg(F.count("*").alias("n"), F.grouping("r_name").cast("int").alias("g1"), F.grouping("c_mktsegment").cast("int").alias("g2"))


@query("select user_id, event_id, round(value - lag(value) over w, 6) as change, rank() over (partition by user_id order by value desc)::int as by_value, round(sum(value) over (partition by user_id order by ts, event_id rows between 2 preceding and current row), 6) as last3 from events window w as (partition by user_id order by ts, event_id)")
def ext_04_frames(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select(
        "user_id", "event_id", F.round(F.col("value") - F.lag("value").over(w), 6).alias("change"),
        F.rank().over(Window.partitionBy("user_id").orderBy(F.desc("value"))).alias("by_value"), F.round(F.sum("value").over(w.rowsBetween(-2, 0)), 6).alias("last3"),
    )


@query("select l.event_id, r.event_id as purchase_id from events l asof join (select * from events where event_type = 'purchase') r on l.user_id = r.user_id and l.ts >= r.ts where l.event_type <> 'purchase'")
def ext_04_asof_join(spark, d):
    """The latest purchase up to each other event: one window over the union instead of a range join."""
    e = table(spark, d, "events")
    w = Window.partitionBy("user_id").orderBy("ts", F.desc(F.col("event_type") == "purchase")).rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("event_type") == "purchase", F.col("event_id")), ignorenulls=True).over(w)
    return e.withColumn("purchase_id", last).where("event_type <> 'purchase' and purchase_id is not null").select("event_id", "purchase_id")
