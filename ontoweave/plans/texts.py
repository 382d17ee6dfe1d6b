"""Text, identifier, search, evidence, scan and state queries, bound to the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import ids, text
from ..functions.scores import frequency
from ..operators import evidence, search, state
from ..operators.topk import best_per_key
from ..sources import html
from ..streaming import windows
from .registry import query, table


@query("select p_partkey, lower(regexp_replace(trim(p_name), '\\s+', ' ', 'g')) as normal, list_aggregate(regexp_extract_all(lower(replace(p_name, '''s', 's')), '[a-z0-9]+'), 'string_agg', ' ') as key, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g'), '_') as slug from part")
def pf_01_02_text_keys(spark, d):
    return table(spark, d, "part").select("p_partkey", text.normal(F.col("p_name")).alias("normal"), text.word_key(F.col("p_name")).alias("key"), text.slug(F.col("p_name")).alias("slug"))


@query("select source, lang, count(*) as docs, count(distinct strip_accents(lower(text))) as folded from documents group by all")
def pf_03_accent_fold(spark, d):
    """Different folded texts of each source and language."""
    return table(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("docs"), F.count_distinct(text.fold(F.col("text"))).alias("folded"))


@query("with w as (select doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) as w from documents) select doc_id, len(list_filter(w, lambda x: x not in ('of', 'the', 'and', 'with', 'a', 'an', 'in', 'to', 'abnormal', 'abnormality')))::int as words from w")
def pf_04_word_set(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(text.words(F.col("text"))).alias("words"))


@query("select p_partkey, p_name from part where contains(lower(p_name), 'widgets') or len(list_filter(string_split(lower(p_name), ' '), lambda x: x in ('red', 'widgets') or (len(x) >= 5 and (starts_with('widgets', x) or starts_with(x, 'widgets'))))) > 0")
def pf_05_similar_names(spark, d):
    """Names with a word of the query or with its stem."""
    return table(spark, d, "part").where(text.similar(F.lit("red widgets"), F.col("p_name"))).select("p_partkey", "p_name")


@query("select event_id, case event_id % 6 when 0 then 0.9::double when 1 then (event_id % 7) / 7.0::double when 2 then (event_id % 100)::double / 100 when 3 then 0.55 when 4 then 0.02 else 0.5 end as freq from events")
def pf_08_frequency(spark, d):
    n = F.col("event_id")
    said = F.when(n % 6 == 0, "Very frequent").when(n % 6 == 1, F.concat((n % 7).cast("string"), F.lit("/7"))).when(n % 6 == 2, F.concat((n % 100).cast("string"), F.lit(" %"))).when(n % 6 == 3, "HP:0040282").when(n % 6 == 4, "very rare").otherwise("rare")
    return table(spark, d, "events").select("event_id", frequency(said).alias("freq"))


@query("select event_id, case event_id % 4 when 0 then 'MONDO:' || lpad(user_id::varchar, 7, '0') when 1 then 'ORPHA:' || user_id when 2 then 'Foo:' || user_id else 'plain' || user_id end as normal, case event_id % 4 when 0 then 'MONDO:' || lpad(user_id::varchar, 7, '0') when 1 then 'ORPHA:' || user_id when 2 then 'FOO:' || user_id else 'plain' || user_id end as bridge from events")
def pf_id_normal_forms(spark, d):
    u = F.col("user_id").cast("string")
    raw = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("mondo:"), u)).when(F.col("event_id") % 4 == 1, F.concat(F.lit("Orphanet:"), u)).when(F.col("event_id") % 4 == 2, F.concat(F.lit("Foo:"), u)).otherwise(F.concat(F.lit("plain"), u))
    return table(spark, d, "events").select("event_id", ids.normalize(raw).alias("normal"), ids.bridge_id(raw).alias("bridge"))


RUNS_SQL = """with iw as (select item_id, regexp_extract_all(text, '\\S+') as w from benchmark), ir as (select distinct item_id, list_aggregate(list_slice(w, i, i + 7), 'string_agg', ' ') as run from (select item_id, w, unnest(range(1, len(w) - 6)) as i from iw where len(w) >= 8)),
dw as (select doc_id, regexp_extract_all(text, '\\S+') as w from documents), dr as (select distinct doc_id, list_aggregate(list_slice(w, i, i + 7), 'string_agg', ' ') as run from (select doc_id, w, unnest(range(1, len(w) - 6)) as i from dw where len(w) >= 8)),
met as (select item_id, doc_id, count(*) as runs from ir join dr using (run) group by all)
"""


def _shared_runs(spark, d, words=8):
    """(item_id, doc_id, runs): how many different runs of words of a benchmark item stand in a document."""
    split = F.regexp_extract_all("text", F.lit(r"\S+"), 0)
    hashes = F.transform(F.sequence(F.lit(1), F.size("w") - (words - 1)), lambda i: F.xxhash64(F.array_join(F.slice("w", i, words), " ")))
    def runs(name, key):
        return table(spark, d, name).select(key, split.alias("w")).where(F.size("w") >= words).select(key, F.explode(F.array_distinct(hashes)).alias("k"))

    items = runs("benchmark", "item_id")
    # Few different runs are broadcast, and then no run of a document is shuffled that no item has.
    items = items.hint("broadcast" if items.count() <= 1_000_000 else "merge")
    return runs("documents", "doc_id").join(items, "k").groupBy("item_id", "doc_id").agg(F.count("*").alias("runs"))


@query(RUNS_SQL + "select * from met")
def pf_14_phrase_contamination(spark, d):
    """Documents that hold a run of eight words of a benchmark item, anywhere in either."""
    return _shared_runs(spark, d)


@query(RUNS_SQL + "select item_id, doc_id, contains(regexp_replace(d.text, '\\s+', ' ', 'g'), trim(regexp_replace(b.text, '\\s+', ' ', 'g'))) as verified from met join documents d using (doc_id) join benchmark b using (item_id)")
def pf_18_quote_verification(spark, d):
    """Whether a document quotes a whole benchmark item, but for white space; candidates share a run of words."""
    plain = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    met = _shared_runs(spark, d).select("item_id", "doc_id")
    items = table(spark, d, "benchmark").select("item_id", plain("text").alias("quote"))
    docs = table(spark, d, "documents").select("doc_id", "text").join(met, "doc_id")
    return docs.join(items, "item_id").select("item_id", "doc_id", F.contains(plain("text"), F.col("quote")).alias("verified"))


@query("select p_partkey, p_name, rank from (select *, case when p_partkey::varchar = 'red ring' then 0 when lower(p_name) = 'red ring' then 1 when starts_with(lower(p_name), 'red ring') then 2 when contains(lower(p_name), 'red ring') then 3 when lower(p_name) = 'red' then 1 when starts_with(lower(p_name), 'red') then 2 when contains(lower(p_name), 'red') then 3 end as rank from part) where rank is not null order by rank, p_partkey limit 50 offset 5")
def tk_01_match_rank_search(spark, d):
    rank = F.coalesce(*(search.match_rank(q, F.col("p_partkey").cast("string"), F.col("p_name")) for q in ("Red  ring", "red")))
    return table(spark, d, "part").withColumn("rank", rank).where("rank is not null").orderBy("rank", "p_partkey").offset(5).limit(50).select("p_partkey", "p_name", "rank")


@query("with q as (select distinct lower(p_name) as q from part union select distinct string_split(lower(p_name), ' ')[1] from part union select distinct lower(p_brand) from part), k as (select p_partkey, 0 as stage, lower(p_name) as k from part union all select p_partkey, 1, lower(p_brand) from part union all select p_partkey, 2, string_split(lower(p_name), ' ')[1] from part), s as (select q, stage, count(*) as found, min(p_partkey) as first from q join k on q = k group by all) select q as query, stage, found, first from s qualify row_number() over (partition by q order by stage) = 1")
def gr_33_staged_resolve(spark, d):
    """Texts are names, else brands, else first words of names: the first stage that knows a text, with all that it finds."""
    name, brand = F.lower("p_name"), F.lower("p_brand")
    p = table(spark, d, "part")
    keys = p.select("p_partkey", F.posexplode(F.array(name, brand, F.split(name, " ")[0])).alias("stage", "query"))
    asked = p.select(F.explode(F.array(name, brand, F.split(name, " ")[0])).alias("query")).distinct()
    found = keys.join(asked, "query").groupBy("query", "stage").agg(F.count("*").alias("found"), F.min("p_partkey").alias("first"))
    return best_per_key(found, ["query"], ["stage"]).select("query", "stage", "found", "first")


@query("with w as (select doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) as term from documents) select term, count(distinct doc_id) as df, count(*) as tf from w group by 1 having count(distinct doc_id) >= 20")
def ft_01_postings(spark, d):
    rows = search.postings(table(spark, d, "documents").select("doc_id", "text"))
    per = rows.groupBy("term", "doc_id").agg(F.count("*").alias("n"))
    return per.groupBy("term").agg(F.count("*").alias("df"), F.sum("n").alias("tf")).where("df >= 20")


@query("with w as (select doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') as w from documents), p as (select doc_id, unnest(range(1, len(w))) as i, w from w where len(w) > 1) select doc_id, count(*) as n from p where w[i] = 'of' and w[i + 1] = 'the' group by 1")
def ft_02_phrase(spark, d):
    return search.phrase_docs(table(spark, d, "documents").select("doc_id", "text"), ["of", "the"])


@query("with w as (select doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') as w from documents), c as (select doc_id, len(w)::double as l, len(list_filter(w, lambda x: x = 'that'))::double as a, len(list_filter(w, lambda x: x = 'this'))::double as b from w), s as (select count(*)::double as n, avg(l) as m, sum((a > 0)::int)::double as da, sum((b > 0)::int)::double as db from c), r as (select doc_id, ln(1 + (n - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * l / m)) + ln(1 + (n - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * l / m)) as score from c, s) select doc_id, round(score, 6) as score from r where score > 0 order by round(score, 6) desc, doc_id limit 50")
def ft_03_bm25(spark, d):
    found = search.bm25(table(spark, d, "documents").select("doc_id", "text"), ["that", "this"]).withColumn("score", F.round("score", 6))
    return found.orderBy(F.desc("score"), "doc_id").limit(50)


def _quotes(spark, d):
    li = table(spark, d, "lineitem")
    level = F.element_at(F.array(*map(F.lit, ("clinical_trial", "observational", "animal", "in_vitro", "review"))), (F.col("l_linenumber") % 5 + 1).cast("int"))
    effect = F.when(F.col("l_returnflag") == "R", "negative").when(F.col("l_returnflag") == "A", "mixed").otherwise("positive")
    return li.select(F.col("l_partkey").alias("edge"), F.col("l_suppkey").alias("paper"), level.alias("level"), effect.alias("effect"), (F.col("l_linestatus") == "O").alias("abstract"))


QUOTES_SQL = """with q as (select l_partkey as edge, l_suppkey as paper, (['clinical_trial', 'observational', 'animal', 'in_vitro', 'review'])[l_linenumber % 5 + 1] as level,
  case l_returnflag when 'R' then 'negative' when 'A' then 'mixed' else 'positive' end as effect, l_linestatus = 'O' as abstract from lineitem),
w as (select *, (case level when 'clinical_trial' then 0.9 when 'observational' then 0.7 when 'animal' then 0.5 when 'in_vitro' then 0.35 else 0.2 end)::double * (case when abstract then 0.7 else 1 end)::double as w from q where not (effect = 'negative' and level = 'review')),
p as (select * from w qualify row_number() over (partition by edge, paper order by w desc, effect) = 1),
s as (select edge, count(*) as papers, count(*) filter (effect = 'negative') as negative_papers, count(*) filter (effect <> 'negative') as supporting,
  1 - coalesce(product(1 - w * case when effect = 'mixed' then 0.5 else 1 end) filter (effect <> 'negative'), 1) as conf from p group by 1),
e as (select edge, papers, negative_papers, round(conf, 3) as confidence, negative_papers > supporting as mostly_negative from s)
"""


@query(QUOTES_SQL + "select * from e")
def gr_41_edge_confidence(spark, d):
    return evidence.edge_confidence(_quotes(spark, d))


@query(QUOTES_SQL + ", x as (select p_brand, p_size, confidence * least(1, p_size / 50.0::double) * case when mostly_negative then 0.25 else 1 end as path from e join part on p_partkey = edge) select p_brand as solution, round(1 - product(1 - path), 3) as score, count(*) as paths from x group by 1")
def gr_43_candidate_solutions(spark, d):
    e = evidence.edge_confidence(_quotes(spark, d))
    p = table(spark, d, "part")
    edges = e.join(p.select(F.col("p_partkey").alias("edge"), F.col("p_brand").alias("solution")), "edge").withColumnRenamed("edge", "target")
    return evidence.candidate_solutions(edges, p.select(F.col("p_partkey").alias("target"), F.least(F.lit(1.0), F.col("p_size") / 50.0).alias("weight")))


@query("with c as (select p_partkey, count(l_orderkey) as n from part left join lineitem on l_partkey = p_partkey and l_returnflag = 'R' and l_discount >= 0.095 group by 1) select p_partkey, n, case when n = 0 then 'untested' when n <= 3 then 'barely_tested' else 'tested' end as status from c")
def gr_45_gap_status(spark, d):
    n = table(spark, d, "lineitem").where("l_returnflag = 'R' and l_discount >= 0.095").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("n"))
    c = table(spark, d, "part").select("p_partkey").join(n, "p_partkey", "left").na.fill(0, ["n"])
    return c.withColumn("status", evidence.gap_status(F.col("n")))


@query("select o_orderkey, (case o_orderpriority when '1-URGENT' then 2 when '2-HIGH' then 1 else 0 end * 8 + (contains(lower(o_orderstatus), 'f'))::int * 2)::int as score from orders where o_orderpriority in ('1-URGENT', '2-HIGH') or contains(lower(o_orderstatus), 'f') order by score desc, o_orderkey limit 6")
def gr_76_keyword_score(spark, d):
    hit = F.when(F.col("o_orderpriority") == "1-URGENT", 2).when(F.col("o_orderpriority") == "2-HIGH", 1).otherwise(0)
    score = (hit * 8 + F.contains(F.lower("o_orderstatus"), F.lit("f")).cast("int") * 2).alias("score")
    return table(spark, d, "orders").select("o_orderkey", score).where("score > 0").orderBy(F.desc("score"), "o_orderkey").limit(6)


@query("select page_id, regexp_extract(html, '<title>(.*?)</title>', 1) as title, len(regexp_extract_all(html, '<a href=\"([^\"]*)\"'))::int as links, regexp_extract(html, '<html lang=\"([a-z]*)\"', 1) as lang from pages")
def src_26_html_scan(spark, d):
    return html.page_facts(table(spark, d, "pages"))


@query("select page_id, pos, link from (select page_id, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) as link, generate_subscripts(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1), 1)::int - 1 as pos from pages)")
def src_26_html_links(spark, d):
    return html.links(table(spark, d, "pages"))


@query("select event_type, (json_extract_string(props, '$.k')::bigint) % 3 as k, count(*) as n from events group by all")
def src_20_json_projection(spark, d):
    props = F.from_json("props", "k bigint")
    return table(spark, d, "events").groupBy("event_type", (props["k"] % 3).alias("k")).agg(F.count("*").alias("n"))


@query("with recursive e as (select user_id as key, floor(epoch(ts))::bigint as \"at\", event_id as id, row_number() over (partition by user_id order by floor(epoch(ts))::bigint, event_id) as rn from events), f as (select key, \"at\", id, rn, \"at\" + 86400 as reset, 1::bigint as hits from e where rn = 1 union all select e.key, e.\"at\", e.id, e.rn, case when f.reset <= e.\"at\" then e.\"at\" + 86400 else f.reset end, case when f.reset <= e.\"at\" then 1 else f.hits + 1 end from f join e on e.key = f.key and e.rn = f.rn + 1) select key, \"at\", id, hits, hits <= 3 as allowed from f")
def st_01_fixed_window_counter(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("key"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("at"), F.col("event_id").alias("id"))
    return state.fixed_window_counter(e, 86_400, 3)


@query("with l as (select user_id as key, max(floor(epoch(ts))::bigint) as \"at\" from events group by 1) select key, \"at\" from l where \"at\" > (select max(\"at\") from l) - 43200 order by \"at\" desc, key limit 64")
def st_02_live_entries(spark, d):
    return state.live_entries(table(spark, d, "events").select(F.col("user_id").alias("key"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("at")), 43_200, 64)


@query("select user_id as key, event_id as ord, value from (select * from events qualify row_number() over (partition by user_id order by event_id desc) = 1) where event_type <> 'purchase'")
def st_04_upsert_delete(spark, d):
    feed = table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("ord"), "value", (F.col("event_type") == "purchase").alias("deleted"))
    return state.upsert(feed, "key", ["ord"]).select("key", "ord", "value")


@query("with e as (select user_id as stream, event_id as ord, case when event_id % 17 = 0 then 'reset' else 'append' end as kind, event_type as text from events), c as (select *, max((kind = 'reset')::int) over (partition by stream order by ord rows between current row and unbounded following) as cleared from e) select stream, coalesce(string_agg(text, '' order by ord) filter (kind = 'append' and cleared = 0), '') as text, false as complete from c group by 1")
def st_05_delta_fold(spark, d):
    kind = F.when(F.col("event_id") % 17 == 0, "reset").otherwise("append")
    return state.delta_fold(table(spark, d, "events").select(F.col("user_id").alias("stream"), F.col("event_id").alias("ord"), kind.alias("kind"), F.col("event_type").alias("text")))


@query("select strftime(time_bucket(interval 1 hour, ts), '%Y-%m-%d %H:%M:%S') as start, event_type, count(*) as n, round(sum(value), 6) as total from events group by all")
def ext_01_tumbling_windows(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return windows.windowed_counts(e).withColumn("total", F.round("total", 6))


@query("with l as (select user_id, ts, lag(ts) over (partition by user_id order by ts) as p from events), g as (select user_id, ts, sum(case when p is null or ts - p >= interval 30 minute then 1 else 0 end) over (partition by user_id order by ts rows unbounded preceding) as s from l) select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as start, count(*) as n from g group by user_id, s")
def ext_01_sessions(spark, d):
    return windows.sessions(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")))


@query("with w as (select doc_id, source, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') as w from documents where text is not null), p as (select doc_id from (select doc_id, w, unnest(range(1, len(w))) as i from w where len(w) > 1) where w[i] = 'of' and w[i + 1] = 'the' group by 1) select w.doc_id from w where doc_id in (select doc_id from p) and source like 'src1%' and not list_contains(w, 'und')")
def ft_06_field_search(spark, d):
    """A query with a phrase, fields, brackets and NOT, answered on the index of two fields."""
    index = search.build_index(table(spark, d, "documents").where("text is not null"), ["text", "source"])
    asked = search.parse_query('"of the"[tiab] (src1*[so] OR nothing[tiab]) NOT und[tiab]', {"tiab": ["text"], "so": ["source"]})
    return search.matching(index, asked)


@query("""
with n as (select distinct p_name as id, p_name as label, p_name as name, true as is_label from part union select p_name, p_name, p_name || ' ' || lower(p_type), false from part
  union select p_name, p_name, 'Red  Ring of ' || p_brand, false from part where p_name like '% bolt'),
c as (select *, regexp_extract_all(lower(name), '[\\p{L}\\p{N}]+') as w from n), l as (select *, len(w)::double as l, len(list_filter(w, lambda x: x = 'red'))::double as a, len(list_filter(w, lambda x: x = 'ring'))::double as b from c),
s as (select count(*)::double as n, avg(l) as m, sum((a > 0)::int)::double as da, sum((b > 0)::int)::double as db from l),
r as (select id, label, is_label, round(ln(1 + (n - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * l / m)) + ln(1 + (n - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * l / m)), 6) as score from l, s where a > 0 and b > 0),
f as (select id, label, 0 as stage, case when is_label then 0.0::double else 1 end as rank, length(label) as size from n where lower(name) = 'red ring' union all select id, label, 1, -(score + case when is_label then 0.5::double else 0 end), 0 from r),
o as (select id, min(label) as label, min((stage, rank, size)) as o from f group by id)
select row_number() over (order by o, id)::int as place, id, label from o order by o, id limit 12""")
def ft_04_name_search(spark, d):
    """Names of parts for the words red ring: exact names, then labels and longer names that hold both."""
    p = table(spark, d, "part")
    row = lambda name, is_label: (F.col("p_name").alias("id"), F.col("p_name").alias("label"), name.alias("name"), F.lit(is_label).alias("is_label"))
    names = p.select(*row(F.col("p_name"), True)).unionByName(p.select(*row(F.concat("p_name", F.lit(" "), F.lower("p_type")), False))).unionByName(
        p.where("p_name like '% bolt'").select(*row(F.concat(F.lit("Red  Ring of "), "p_brand"), False))).distinct()
    return search.name_search(names, " Red  RING", 12)
