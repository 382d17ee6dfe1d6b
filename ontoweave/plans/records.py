"""Record merging, normalisation cascades, claims and packets, bound to the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import ids
from ..operators.topk import best_per_key
from .registry import query, table


@query("select e.event_id from events e where e.user_id in (select user_id from events group by 1 having count(*) > 60) and e.event_type = 'click'")
def jn_04_membership(spark, d):
    e = table(spark, d, "events")
    return e.where("event_type = 'click'").join(e.groupBy("user_id").count().where("count > 60"), "user_id", "left_semi").select("event_id")


@query("with c as (select l_suppkey as subject, l_partkey as object, max(l_discount) > 0.05 as strong from lineitem group by all), n as (select object, count(*) filter (strong) as s, count(*) filter (not strong) as w from c group by 1) select object, s * (s - 1) // 2 + w * (w - 1) // 2 as agreeing, s * w as conflicting from n where s + w > 1")
def jn_08_claim_pairs(spark, d):
    """How many pairs of subjects claim the same of one object, and how many the opposite: by the sizes of its two classes, not pair by pair."""
    c = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("subject"), F.col("l_partkey").alias("object")).agg((F.max("l_discount") > 0.05).alias("strong"))
    n = c.groupBy("object").agg(F.count_if("strong").alias("s"), F.count_if(~F.col("strong")).alias("w")).where("s + w > 1")
    return n.select("object", F.expr("s * (s - 1) div 2 + w * (w - 1) div 2").alias("agreeing"), F.expr("s * w").alias("conflicting"))


@query("select 'OMIM:' || c_custkey as ref, s_suppkey from customer join supplier on c_custkey = s_suppkey")
def jn_12_prefix_rewrite(spark, d):
    a = table(spark, d, "customer").select(ids.normalize(F.concat(F.lit("mim:"), F.col("c_custkey").cast("string"))).alias("ref"))
    b = table(spark, d, "supplier").select("s_suppkey", ids.normalize(F.concat(F.lit("OMIM:"), F.col("s_suppkey").cast("string"))).alias("ref"))
    return a.join(b, "ref").select("ref", "s_suppkey")


@query("select p_brand, p_type, max(p_retailprice) as best from part group by all")
def o_agg_03_max_per_key(spark, d):
    return table(spark, d, "part").groupBy("p_brand", "p_type").agg(F.max("p_retailprice").alias("best"))


@query("with x as (select n_regionkey, p_brand, o_custkey from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join lineitem on l_orderkey = o_orderkey join part on p_partkey = l_partkey group by all), n as (select n_regionkey, count(distinct o_custkey) as n from x group by 1), f as (select n_regionkey, p_brand, count(*) as entities from x group by all) select f.n_regionkey, p_brand, entities from f join n using (n_regionkey) where entities <= 0.9 * n qualify row_number() over (partition by f.n_regionkey order by entities desc, p_brand) <= 24")
def o_agg_14_region_findings(spark, d):
    """Findings of at most nine tenths of a region's entities, the 24 most frequent."""
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.expr("c_nationkey = n_nationkey"))
    li = table(spark, d, "lineitem").join(table(spark, d, "part"), F.expr("p_partkey = l_partkey"))
    x = table(spark, d, "orders").join(c, F.expr("o_custkey = c_custkey")).join(li, F.expr("l_orderkey = o_orderkey")).select("n_regionkey", "p_brand", "o_custkey").distinct()
    n = x.groupBy("n_regionkey").agg(F.count_distinct("o_custkey").alias("n"))
    f = x.groupBy("n_regionkey", "p_brand").agg(F.count("*").alias("entities")).join(n, "n_regionkey").where(F.col("entities") <= 0.9 * F.col("n"))
    nth = F.row_number().over(Window.partitionBy("n_regionkey").orderBy(F.desc("entities"), "p_brand"))
    return f.withColumn("nth", nth).where("nth <= 24").select("n_regionkey", "p_brand", "entities")


@query("select event_type, count(*) as calls, count(*) filter (value < 1) as empties, round(avg(value), 6) as seconds, count(distinct props) as answers from events group by 1")
def o_agg_17_run_statistics(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("calls"), F.count_if(F.col("value") < 1).alias("empties"), F.round(F.avg("value"), 6).alias("seconds"), F.count_distinct("props").alias("answers"))


@query("with s as (select p_brand, p_type, count(*) as n from part group by all), k as (select p_brand, count(*) as kinds from s group by 1), h as (select p_type, count(*) as brands from s where n >= 2 group by 1) select p_type, brands, round(brands / (select count(*) from k), 6) as share from h where brands >= greatest(2, ceil((select count(*) from k) / 3.0))")
def o_agg_19_subtype_share(spark, d):
    s = table(spark, d, "part").groupBy("p_brand", "p_type").agg(F.count("*").alias("n"))
    total = s.select(F.count_distinct("p_brand")).first()[0]
    h = s.where("n >= 2").groupBy("p_type").agg(F.count("*").alias("brands")).where(F.col("brands") >= max(2, -(-total // 3)))
    return h.select("p_type", "brands", F.round(F.col("brands") / max(total, 1), 6).alias("share"))


@query("select o_custkey, o_orderstatus from orders group by all")
def o_agg_20_group_as_distinct(spark, d):
    return table(spark, d, "orders").select("o_custkey", "o_orderstatus").dropDuplicates()


@query("select o_custkey, count(*) as relations, count(distinct o_orderpriority) as providers, max(o_totalprice) as cited from orders group by 1 order by relations desc, providers desc, cited desc, o_custkey limit 100")
def tk_08_paper_order(spark, d):
    x = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("relations"), F.count_distinct("o_orderpriority").alias("providers"), F.max("o_totalprice").alias("cited"))
    return x.orderBy(F.desc("relations"), F.desc("providers"), F.desc("cited"), "o_custkey").limit(100)


@query("with i as (select p_partkey % 100 as entity, (['SYMBOL', 'MONDO', 'HP', 'OMIM', 'ZZ'])[p_partkey % 5 + 1] || ':' || p_partkey as id, (case p_partkey % 5 when 0 then 19 when 1 then 1 when 2 then 2 when 3 then 10 else 20 end) as r from part) select entity, arg_min(id, r * 1e9 + substr(id, instr(id, ':') + 1)::int) as shown from i group by 1")
def gr_16_display_id(spark, d):
    """The id that names an entity: the first prefix in the order of display, then the smallest number."""
    k = F.col("p_partkey")
    prefix = F.element_at(F.array(*map(F.lit, ("SYMBOL", "MONDO", "HP", "OMIM", "ZZ"))), (k % 5 + 1).cast("int"))
    i = table(spark, d, "part").select((k % 100).alias("entity"), F.concat(prefix, F.lit(":"), k.cast("string")).alias("id"), "p_partkey")
    return best_per_key(i, ["entity"], [ids.display_rank(F.col("id")), "p_partkey"]).select("entity", F.col("id").alias("shown"))


@query("with m as (select doc_id, md5(lower(regexp_replace(trim(regexp_replace(text, '\\s+', ' ', 'g')), '[.,;!]+$', ''))) as key from documents) select key, count(*) as merged, min(doc_id) as kept from m group by 1 having count(*) > 1")
def gr_46_canonical_merge(spark, d):
    """Records whose whole texts have one canonical key; the smallest is kept."""
    key = F.lower(F.regexp_replace(F.trim(F.regexp_replace("text", r"\s+", " ")), "[.,;!]+$", ""))
    return table(spark, d, "documents").groupBy(F.md5(key).alias("key")).agg(F.count("*").alias("merged"), F.min("doc_id").alias("kept")).where("merged > 1")


@query("with c as (select s_suppkey, 1 as stage, n_name as hit from supplier join nation on s_nationkey = n_nationkey where n_nationkey % 3 = 0 union all select s_suppkey, 2, r_name from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey where r_regionkey % 2 = 0 union all select s_suppkey, 3, lower(s_name) from supplier) select s_suppkey, stage, hit from c qualify row_number() over (partition by s_suppkey order by stage) = 1")
def gr_50_cascade(spark, d):
    """The first stage that knows an entity: nation, region, then the name's own key."""
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.expr("s_nationkey = n_nationkey")).join(table(spark, d, "region"), F.expr("n_regionkey = r_regionkey"))
    stages = F.array_compact(F.array(
        F.when(F.col("n_nationkey") % 3 == 0, F.struct(F.lit(1).alias("stage"), F.col("n_name").alias("hit"))),
        F.when(F.col("r_regionkey") % 2 == 0, F.struct(F.lit(2).alias("stage"), F.col("r_name").alias("hit"))),
        F.struct(F.lit(3).alias("stage"), F.lower("s_name").alias("hit")),
    ))
    return s.select("s_suppkey", F.get(stages, 0).alias("f")).select("s_suppkey", "f.stage", "f.hit")


@query("with r as (select p_partkey, row_number() over (order by p_retailprice desc, p_partkey)::int as place from part), o as (select p_partkey, case when place <= 20 and p_partkey % 2 = 0 then place - 20 else place end as k from r) select p_partkey, row_number() over (order by k)::int as rank from o qualify row_number() over (order by k) <= 40")
def gr_51_external_order(spark, d):
    """An outside order moves some of the first twenty to the front; all others keep their places."""
    top = table(spark, d, "part").select("p_partkey", "p_retailprice").orderBy(F.desc("p_retailprice"), "p_partkey").limit(40)
    r = top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("p_retailprice"), "p_partkey")))
    outside = r.where("place <= 20 and p_partkey % 2 = 0").select("p_partkey", (F.col("place") - 20).alias("given"))
    key = F.coalesce("given", "place")
    return r.join(outside, "p_partkey", "left").withColumn("rank", F.row_number().over(Window.orderBy(key))).select("p_partkey", "rank")


@query("select l_partkey, round((case max(l_linenumber) when 1 then 0.2 when 2 then 0.5 else 0.9 end)::double * avg(l_discount) * log2(2 + count(*)), 6) as weight from lineitem group by 1")
def gr_65_display_weight(spark, d):
    level = F.when(F.max("l_linenumber") == 1, 0.2).when(F.max("l_linenumber") == 2, 0.5).otherwise(0.9)
    return table(spark, d, "lineitem").groupBy("l_partkey").agg(F.round(level * F.avg("l_discount") * F.log2(F.lit(2) + F.count("*")), 6).alias("weight"))


@query("with x as (select user_id as id, event_id as run, event_type as label from events) select id, run, label from x qualify row_number() over (partition by id order by run desc) = 1 order by lower(label), id limit 100")
def gr_74_index_upsert(spark, d):
    x = table(spark, d, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("run"), F.col("event_type").alias("label"))
    return best_per_key(x, ["id"], [F.desc("run")]).orderBy(F.lower("label"), "id").limit(100)


@query("with p as (select doc_id, list_distinct(regexp_extract_all(text, '\\b[A-Z][a-z]+ing\\b')) as names from documents), e as (select doc_id, unnest(names) as n from p) select a.n as a, b.n as b, count(*) as papers from e a join e b on a.doc_id = b.doc_id and a.n < b.n group by all having count(*) >= 2")
def gr_67_cooccurrence_of_names(spark, d):
    names = F.array_distinct(F.regexp_extract_all("text", F.lit(r"\b[A-Z][a-z]+ing\b"), 0))
    e = table(spark, d, "documents").select("doc_id", F.explode(names).alias("n"))
    return e.toDF("doc_id", "a").join(e.toDF("doc_id", "b"), "doc_id").where("a < b").groupBy("a", "b").agg(F.count("*").alias("papers")).where("papers >= 2")
