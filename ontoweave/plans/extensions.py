"""Grouping sets, frames, range joins, scans and checks of texts, bound to the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import state
from ..operators.lineage import shared_dir
from ..operators.ranges import near_join
from ..operators.topk import best_per_key, top_per_group
from ..streaming import windows
from . import texts  # noqa: F401  # registers the counter whose SQL the stream shares
from .registry import ORACLE_SQL, query, table


@query("select l_returnflag, l_linestatus, count(*) as n, count(distinct l_suppkey) as suppliers, round(quantile_cont(l_quantity, 0.5), 6) as median from lineitem group by rollup (l_returnflag, l_linestatus) having count(*) > 10")
def o_agg_21_rollup_percentile(spark, d):
    sets = table(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus")
    counted = sets.agg(F.count("*").alias("n"), F.count_distinct("l_suppkey").alias("suppliers"), F.round(F.percentile("l_quantity", 0.5), 6).alias("median"))
    return counted.where("n > 10")


@query("select o_orderkey, rank() over w as rank, dense_rank() over p as dense, lag(o_totalprice) over w as before, lead(o_totalprice) over w as after, round(sum(o_totalprice) over (w rows between 2 preceding and current row), 2) as last_three from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey), p as (partition by o_custkey order by o_orderpriority)")
def win_08_frames(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, d, "orders").select(
        "o_orderkey", F.rank().over(w).alias("rank"), F.dense_rank().over(Window.partitionBy("o_custkey").orderBy("o_orderpriority")).alias("dense"),
        F.lag("o_totalprice").over(w).alias("before"), F.lead("o_totalprice").over(w).alias("after"),
        F.round(F.sum("o_totalprice").over(w.rowsBetween(-2, 0)), 2).alias("last_three"),
    )


@query("select s_suppkey, p_partkey from supplier join part on abs(s_acctbal - p_retailprice) <= 0.5")
def jn_18_range_join(spark, d):
    """Suppliers and parts whose amounts differ by a half at most."""
    return near_join(table(spark, d, "supplier"), table(spark, d, "part"), "s_acctbal", "p_retailprice", 0.5).select("s_suppkey", "p_partkey")


@query("select l_partkey, l_suppkey from lineitem where l_discount >= 0.05 and l_returnflag = 'R'")
def src_16_column_scan(spark, d):
    """Two columns of a wide table; projection and filters reach the Parquet scan."""
    return table(spark, d, "lineitem").where("l_discount >= 0.05 and l_returnflag = 'R'").select("l_partkey", "l_suppkey")


@query("select l_orderkey, l_linenumber, measure, value from (unpivot (select l_orderkey, l_linenumber, l_quantity, l_discount, l_tax from lineitem) on l_quantity, l_discount, l_tax into name measure value value) where value > 0")
def src_18_wide_to_long(spark, d):
    """A wide matrix of measures as rows, those above nought."""
    wide = table(spark, d, "lineitem")
    return wide.unpivot(["l_orderkey", "l_linenumber"], ["l_quantity", "l_discount", "l_tax"], "measure", "value").where("value > 0")


@query("select o_custkey as project, o_orderkey as record, year(o_orderdate)::int as fiscal_year from orders qualify row_number() over (partition by o_custkey order by year(o_orderdate) desc, o_orderkey desc) = 1")
def src_21_latest_record(spark, d):
    """The record of a project's last year; of one year, the later row."""
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("project"), F.col("o_orderkey").alias("record"), F.year("o_orderdate").alias("fiscal_year"))
    return best_per_key(rows, ["project"], [F.desc("fiscal_year"), F.desc("record")])


@query("select md5(text) as key, count(*) as copies, min(doc_id) as kept from documents where text is not null group by 1 having count(*) > 1")
def ext_05_exact_duplicates(spark, d):
    """Whole texts that stand in several documents; the smallest stays."""
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", F.md5("text").alias("key"))
    return docs.groupBy("key").agg(F.count("*").alias("copies"), F.min("doc_id").alias("kept")).where("copies > 1")


@query(r"with f as (select page_id, len(regexp_extract_all(html, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+'))::int as addresses, len(regexp_extract_all(html, '\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b'))::int as hosts, len(regexp_extract_all(html, '\+?[0-9]{2,3}[ -][0-9]{3,4}[ -][0-9]{3,4}\b'))::int as phones, len(regexp_extract_all(html, '[?&](?:utm_source|ref|session|user)=[A-Za-z0-9]+'))::int as trackers from pages) select * from f")
def ext_05_personal_data(spark, d):
    """How many mail addresses, network addresses, telephone numbers and tracking parameters a page holds."""
    return table(spark, d, "pages").select("page_id", *text.personal_counts(F.col("html")))


@query("with o as (select o_custkey, '{\"id\": ' || o_orderkey || ', \"status\": \"' || o_orderstatus || '\"}' as line, o_orderkey from orders) select o_custkey, substr(sha256('[' || string_agg(line, ', ' order by o_orderkey) || ']'), 1, 16) as version, count(*) as records from o group by 1")
def gr_26_snapshot_version(spark, d):
    """A version of each customer's records: sixteen hex digits of the SHA-256 of their JSON with sorted keys, in id order."""
    line = F.concat(F.lit('{"id": '), F.col("o_orderkey").cast("string"), F.lit(', "status": "'), F.col("o_orderstatus"), F.lit('"}'))
    rows = table(spark, d, "orders").select("o_custkey", F.struct("o_orderkey", line.alias("line")).alias("r")).groupBy("o_custkey").agg(F.sort_array(F.collect_list("r")).alias("rows"))
    body = F.concat(F.lit("["), F.array_join(F.col("rows.line"), ", "), F.lit("]"))
    return rows.select("o_custkey", F.substring(F.sha2(body, 256), 1, 16).alias("version"), F.size("rows").cast("long").alias("records"))


@query("with x as (select distinct o_custkey, p_brand from orders join lineitem on l_orderkey = o_orderkey join part on p_partkey = l_partkey where l_returnflag <> 'R') select o_custkey, count(*) as n, string_agg(p_brand, '|' order by p_brand) as terms from x group by 1")
def gr_70_sorted_sets(spark, d):
    """The sorted distinct terms of each entity's answers, without the excluded ones."""
    li = table(spark, d, "lineitem").where("l_returnflag <> 'R'").join(table(spark, d, "part"), F.expr("p_partkey = l_partkey"))
    x = table(spark, d, "orders").join(li, F.expr("l_orderkey = o_orderkey")).groupBy("o_custkey").agg(F.sort_array(F.collect_set("p_brand")).alias("t"))
    return x.select("o_custkey", F.size("t").cast("long").alias("n"), F.array_join("t", "|").alias("terms"))


KEY_SQL = "coalesce(list_aggregate(regexp_extract_all(replace(lower(t), '''s', 's'), '[a-z0-9]+'), 'string_agg', ' '), '')"


@query("with n as (select item_id, unnest(string_split(text, '.')) as n, generate_subscripts(string_split(text, '.'), 1) as pos from benchmark), t as (select item_id, pos, trim(regexp_replace(regexp_replace(n, '[\\\\\"“”«»`\\x00-\\x1f\\x7f]', ' ', 'g'), '\\s+', ' ', 'g'), ' ,.:;-/''') as t from n), k as (select *, " + KEY_SQL + " as k from t where not contains(t, ';')) select item_id, t as term from k where len(replace(k, ' ', '')) >= 4 qualify row_number() over (partition by item_id, k order by pos) = 1")
def pf_20_search_terms(spark, d):
    """The sentences of each item as search terms, the first of those with one key."""
    n = table(spark, d, "benchmark").select("item_id", F.posexplode(F.split("text", r"\.")).alias("pos", "n"))
    t = n.select("item_id", "pos", text.search_term(F.col("n")).alias("term")).where(text.usable_term(F.col("term")))
    return best_per_key(t.withColumn("key", text.word_key(F.col("term"))), ["item_id", "key"], ["pos"]).select("item_id", "term")


@query("with n as (select item_id, unnest(string_split(text, ' ')) as n, generate_subscripts(string_split(text, ' '), 1) as pos from benchmark), t as (select item_id, pos, trim(n) as t from n), k as (select *, " + KEY_SQL + " as k from t where len(t) >= 4 and not regexp_matches(t, '^[A-Z]{2,6}[0-9]{0,2}[A-Z]?$') and not contains(t, ':')), f as (select * from k where k <> '' qualify row_number() over (partition by item_id, k order by pos) = 1) select item_id, t as name, row_number() over (partition by item_id order by pos)::int as place from f qualify row_number() over (partition by item_id order by pos) <= 8")
def pf_22_usable_names(spark, d):
    """The first eight different usable words of each item."""
    n = table(spark, d, "benchmark").select("item_id", F.posexplode(F.split("text", " ")).alias("pos", "n")).select("item_id", "pos", F.trim("n").alias("name"))
    first = best_per_key(n.where(text.usable_name(F.col("name"))).withColumn("key", text.word_key(F.col("name"))), ["item_id", "key"], ["pos"])
    return top_per_group(first, ["item_id"], ["pos"], 8, "place").select("item_id", "name", "place")


@query("with h as (select l_partkey, count(distinct l_returnflag) as sources from lineitem where l_tax >= 0.07 group by 1) select p_partkey, p_name, sources from part join h on p_partkey = l_partkey where sources >= 2 or contains(lower(p_name), 'widgets') or len(list_filter(string_split(lower(p_name), ' '), lambda x: x in ('red', 'widgets') or (len(x) >= 5 and (starts_with('widgets', x) or starts_with(x, 'widgets'))))) > 0")
def pf_12_on_topic(spark, d):
    """Hits whose names are like the query's, or on which two sources agree."""
    hits = table(spark, d, "lineitem").where("l_tax >= 0.07").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count_distinct("l_returnflag").alias("sources"))
    named = table(spark, d, "part").join(hits, "p_partkey")
    return named.where(text.similar(F.lit("red widgets"), F.col("p_name")) | (F.col("sources") >= 2)).select("p_partkey", "p_name", "sources")


@query("with a as (select p_partkey, lower(p_name) as label, p_brand, count(distinct l_suppkey) as sources from part left join lineitem on l_partkey = p_partkey group by all), q as (select distinct label as query from a) select query, p_partkey as best, sources from q join a on string_split(query, ' ')[1] = string_split(label, ' ')[1] qualify row_number() over (partition by query order by (query = label and not (sources < 2 and p_brand = 'Brand#1')) desc, sources desc, p_brand, p_partkey) = 1")
def gr_18_best_match(spark, d):
    """What a text means: a hit of that very name that is not a thin record, then the most sources, the better prefix, the smaller id."""
    sources = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count_distinct("l_suppkey").alias("sources"))
    a = table(spark, d, "part").select("p_partkey", F.lower("p_name").alias("label"), "p_brand").join(sources, "p_partkey", "left").na.fill(0, ["sources"])
    hits = a.select("label", F.split("label", " ")[0].alias("word"), "p_partkey", "p_brand", "sources")
    asked = a.select(F.col("label").alias("query"), F.split("label", " ")[0].alias("word")).distinct()
    thin = (F.col("sources") < 2) & (F.col("p_brand") == "Brand#1")
    found = best_per_key(asked.join(hits, "word"), ["query"], [F.desc((F.col("query") == F.col("label")) & ~thin), F.desc("sources"), "p_brand", "p_partkey"])
    return found.select("query", F.col("p_partkey").alias("best"), "sources")


def _stream(spark, d):
    """The events as a stream; a file source takes a single file only by a pattern."""
    return windows.read_events(spark, f"{d}/{{events.parquet}}")


@query("select user_id as key, event_id as ord, value from (select * from events qualify row_number() over (partition by user_id order by event_id desc) = 1) where event_type <> 'error'")
def ext_02_stream_upsert(spark, d):
    """The last version of each key after a stream of versions and deletions has gone through the last-writer sink."""
    target = f"{shared_dir(spark)}/upsert-{uuid.uuid4().hex}"
    feed = _stream(spark, d).select(F.col("user_id").alias("key"), F.col("event_id").alias("ord"), "value", (F.col("event_type") == "error").alias("deleted"))
    feed.writeStream.foreachBatch(windows.last_writer(target)).option("checkpointLocation", f"{target}-log").trigger(availableNow=True).start().awaitTermination()
    return windows.read_last(spark, target).select("key", "ord", "value")


@query("select distinct event_id, event_type from events")
def ext_03_stream_dedupe(spark, d):
    """Every event once, of a stream in which each comes twice."""
    target = f"{shared_dir(spark)}/dedupe-{uuid.uuid4().hex}"
    once = _stream(spark, d)
    kept = windows.deduplicated(once.union(once)).select("event_id", "event_type")
    kept.writeStream.format("parquet").option("path", target).option("checkpointLocation", f"{target}-log").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("event_id long, event_type string").parquet(target)


@query("with e as (select user_id as job, (json_extract_string(props, '$.k')::bigint) % 3 as stage, event_id as ord, case event_type when 'signup' then 'queued' when 'purchase' then 'done' when 'error' then 'failed' else 'running' end as kind from events) select job, stage, case when bool_or(kind = 'done') then 'done' when arg_max(kind, ord) = 'running' then 'failed' else arg_max(kind, ord) end as state, count(*) filter (kind = 'running') as attempts from e group by all")
def st_03_stage_states(spark, d):
    kind = F.when(F.col("event_type") == "signup", "queued").when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "error", "failed").otherwise("running")
    stage = F.from_json("props", "k bigint")["k"] % 3
    return state.stage_states(table(spark, d, "events").select(F.col("user_id").alias("job"), stage.alias("stage"), F.col("event_id").alias("ord"), kind.alias("kind")))


@query("with p as (select doc_id, trim(string_split(text, chr(10))[1]) as title, trim(regexp_replace(text, '\\s+', ' ', 'g')) as body from documents) select doc_id, title, case when length(body) > 400 then rtrim(substr(body, 1, 399)) || '…' else body end as excerpt from p")
def gr_71_record_projection(spark, d):
    """Each document's first line and an excerpt of at most 400 characters."""
    return table(spark, d, "documents").select("doc_id", F.trim(F.split("text", "\n")[0]).alias("title"), text.excerpt(F.col("text")).alias("excerpt"))


@query(ORACLE_SQL["st_01_fixed_window_counter"])
def ext_03_stateful_counter(spark, d):
    """The window counter as a stream with expiring state; the events come in four files, one a batch, in the order of time."""
    path = f"{shared_dir(spark)}/counter-{uuid.uuid4().hex}"
    e = table(spark, d, "events").select(F.col("user_id").alias("key"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("at"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"))
    ends = e.agg(F.min("at").alias("lo"), F.max("at").alias("hi")).first()
    if ends["lo"] is None:
        return spark.createDataFrame([], "key long, at long, id long, hits long, allowed boolean")
    step = (ends["hi"] - ends["lo"]) // 4 + 1
    for i in range(4):
        e.where(F.floor((F.col("at") - ends["lo"]) / step) == i).coalesce(1).write.mode("append").parquet(f"{path}/in")
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    counted = windows.streamed_counter(stream, 86_400, 3)
    counted.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/log").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("key long, at long, id long, hits long, allowed boolean").parquet(f"{path}/out")
