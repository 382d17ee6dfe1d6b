"""Queries on many-word names: dictionaries in texts, interpretation, qualified names, predicates, diverse selection."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import names as N
from ..operators import phrases as P
from ..operators.interpretation import interpret
from ..operators.selection import diverse_selection, ordered
from .registry import query, table


def _clauses(spark, d):
    """The clauses and sentences of benchmark items, of two words or more, as phrases numbered by themselves."""
    cut = lambda marks: F.split("text", marks)
    pieces = table(spark, d, "benchmark").select(F.explode(F.concat(cut(r"[.,;:!?\n]"), cut(r"[.!?\n]"))).alias("phrase"))
    words = pieces.select(P.tokens(F.col("phrase")).alias("w")).where(F.size("w") > 1)
    return words.select(F.array_join("w", " ").alias("phrase_id"), F.array_join("w", " ").alias("phrase")).distinct()


@query(r"""
with b as (select unnest(string_split_regex(text, '[.,;:!?\n]') || string_split_regex(text, '[.!?\n]')) as t from benchmark),
p as (select distinct regexp_extract_all(regexp_replace(lower(t), '[''’`]', '', 'g'), '[\p{L}\p{N}]+') as p from b),
ph as (select p, array_to_string(p, ' ') as phrase, len(p) as n, p[1] || ' ' || p[2] as head from p where len(p) > 1),
dw as (select doc_id, regexp_extract_all(regexp_replace(lower(coalesce(text, '')), '[''’`]', '', 'g'), '[\p{L}\p{N}]+') as w from documents),
x as (select doc_id, unnest(w) as x, generate_subscripts(w, 1) as pos from dw),
h as (select doc_id, pos, x || ' ' || lead(x) over (partition by doc_id order by pos) as head from x),
m as (select h.doc_id, phrase, pos as s, pos + n - 1 as e from h join ph using (head) join dw using (doc_id) where w[pos:pos + n - 1] = p),
sp as (select distinct doc_id, s, e from m),
k as (select * from (select *, max(e) over (partition by doc_id order by s, e desc rows between unbounded preceding and 1 preceding) as upto from sp) where upto is null or upto < e),
f as (select doc_id, phrase, min(s) as s, arg_min(e, s) as e from m join k using (doc_id, s, e) group by all)
select doc_id as text_id, place, phrase as phrase_id from (select *, row_number() over (partition by doc_id order by s, e desc, phrase)::int as place from f) where place <= 3""")
def gr_59_first_named(spark, d):
    """The first three clauses or sentences of benchmark items that a document holds, those inside longer ones left out."""
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("text_id"), "text")
    return P.first_named(P.phrase_matches(texts, _clauses(spark, d)), 3)


def _order_texts(spark, d):
    """Each order's lines as a text: names of parts in three forms, every other one with a letter after it."""
    form = F.element_at(F.array(F.lit(""), F.lit("s"), F.lit("es")), (F.col("l_quantity").cast("int") % 3 + 1))
    token = F.concat("p_name", form, F.when(F.col("l_quantity").cast("int") % 5 == 0, "x").otherwise(""))
    li = table(spark, d, "lineitem").join(table(spark, d, "part").select("p_partkey", "p_name"), F.expr("l_partkey = p_partkey"))
    lines = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", token.alias("t")))).alias("lines"))
    return lines.select(F.col("l_orderkey").alias("text_id"), F.array_join(F.transform("lines", lambda x: x["t"]), ", ").alias("text"))


ORDER_TEXTS = """
tx as (select l_orderkey as text_id, string_agg(p_name || case l_quantity::int % 3 when 0 then '' when 1 then 's' else 'es' end || case when l_quantity::int % 5 = 0 then 'x' else '' end, ', ' order by l_linenumber, p_name) as text
  from lineitem join part on l_partkey = p_partkey group by 1)"""


@query(f"with {ORDER_TEXTS}, n as (select distinct p_name from part) select text_id, p_name as phrase_id from tx, n where regexp_matches(text, '\\b' || p_name || '(e?s)?\\b')")
def jn_15_named_in_text(spark, d):
    """Names of parts, singular or plural, that stand as whole words in the texts of orders."""
    names = table(spark, d, "part").select(F.col("p_name").alias("phrase_id"), F.col("p_name").alias("phrase")).distinct()
    return P.named(_order_texts(spark, d), names)


@query(f"""
with {ORDER_TEXTS}, nn as (select distinct p_name from part where p_name like 'hot %' or p_name like 'large %'),
nouns as (select *, row_number() over (order by noun) as place from (select distinct string_split(p_name, ' ')[2] as noun from part)),
w as (select text_id, unnest(regexp_extract_all(text, '[a-z0-9]+')) as x, generate_subscripts(regexp_extract_all(text, '[a-z0-9]+'), 1) as pos from tx),
v as (select *, lag(x) over (partition by text_id order by pos) as before from w),
r as (select text_id, min(place) as place from v join nouns on x = noun or x = noun || 's' where coalesce(before || ' ' || x, '') not in (select p_name from nn) group by 1)
select text_id, coalesce(noun, 'other') as topic from tx left join r using (text_id) left join nouns using (place)""")
def gr_77_topic_inference(spark, d):
    """The topic of an order's text: the first noun, by the alphabet, that stands there outside the names of hot and large parts."""
    part = table(spark, d, "part")
    names = part.where("p_name like 'hot %' or p_name like 'large %'").select(F.col("p_name").alias("phrase")).distinct().select(F.col("phrase").alias("phrase_id"), "phrase")
    nouns = part.select(F.split("p_name", " ")[1].alias("topic")).distinct()
    rules = nouns.select(F.explode(F.array(F.col("topic"), F.concat("topic", F.lit("s")))).alias("phrase"), "topic")
    placed = nouns.select("topic", F.dense_rank().over(Window.orderBy("topic")).alias("place"))  # a few dozen nouns
    return P.inferred(_order_texts(spark, d), names, rules.join(placed, "topic").select("place", "topic", "phrase"), "other")


def _mixed_texts(spark, d):
    """Texts of orders that name parts, brands and types, alone, together and next to what no dictionary knows."""
    kind = F.col("l_linenumber") % 4
    token = (
        F.when(kind == 0, F.concat("p_name", F.lit(" And "), "p_brand")).when(kind == 1, F.concat(F.lit(" "), "p_type"))
        .when(kind == 2, F.concat("p_name", F.lit(" with size "), F.col("p_size").cast("string"))).otherwise(F.concat("p_brand", F.lit("  "))))
    li = table(spark, d, "lineitem").join(table(spark, d, "part"), F.expr("l_partkey = p_partkey"))
    lines = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", token.alias("t")))).alias("lines"))
    return lines.select(F.col("l_orderkey").alias("text_id"), F.array_join(F.transform("lines", lambda x: x["t"]), ";").alias("text"))


@query(r"""
with tk as (select l_orderkey, l_linenumber, case l_linenumber % 4 when 0 then p_name || ' And ' || p_brand when 1 then ' ' || p_type when 2 then p_name || ' with size ' || p_size else p_brand || '  ' end as token
  from lineitem join part on l_partkey = p_partkey),
tx as (select l_orderkey as text_id, string_agg(token, ';' order by l_linenumber, token) as text from tk group by 1),
n as (select distinct lower(p_brand) as key, 'gene' as kind, p_brand as id, 0 as rank from part union all select distinct lower(p_type), 'phenotype', p_type, 2 from part
  union all select lower(p_name), 'disease', 'part:' || min(p_partkey), case when p_name like 'old %' then 1 else 3 end from part group by p_name
  union all select distinct lower(p_name), 'phenotype', 'name:' || p_name, 2 from part where p_name like '% ring'),
k as (select key, kind, id from n qualify row_number() over (partition by key order by rank, id) = 1),
pt as (select text_id, unnest(string_split_regex(text, '[,;\n+]')) as seg, generate_subscripts(string_split_regex(text, '[,;\n+]'), 1) - 1 as part from tx),
pc as (select text_id, part, unnest(string_split_regex(seg, '(?i)\s+(?:and|with)\s+')) as seg, generate_subscripts(string_split_regex(seg, '(?i)\s+(?:and|with)\s+'), 1) - 1 as piece from pt),
w as (select text_id, -1 as part, -1 as piece, trim(text) as segment, kind, id from tx join k on key = lower(trim(text))),
pk as (select text_id, part, -1 as piece, trim(seg) as segment, kind, id from pt left join k on key = lower(trim(seg))),
ck as (select text_id, part, piece, trim(seg) as segment, kind, id from pc left join k on key = lower(trim(seg))),
g as (select text_id, part from ck group by all having count(*) > 1 and count(kind) = count(*))
select * from w
union all select pk.* from pk anti join w using (text_id) where kind is not null or (text_id, part) not in (select (text_id, part) from g)
union all select ck.* from ck semi join g using (text_id, part) anti join w using (text_id) anti join (select * from pk where kind is not null) z using (text_id, part)""")
def gr_12_interpretation(spark, d):
    """Texts of orders read as brands (genes), names (diseases) and types (phenotypes); rings are phenotypes unless they are old."""
    part = table(spark, d, "part")
    flag = F.lit(False).alias("fixed")
    brands = part.select(F.col("p_brand").alias("name"), F.lit("gene").alias("kind"), F.col("p_brand").alias("id"), flag).distinct()
    types = part.select(F.col("p_type").alias("name"), F.lit("phenotype").alias("kind"), F.col("p_type").alias("id"), flag).distinct()
    diseases = part.groupBy("p_name").agg(F.concat(F.lit("part:"), F.min("p_partkey").cast("string")).alias("id")).select(F.col("p_name").alias("name"), F.lit("disease").alias("kind"), "id", F.startswith("p_name", F.lit("old ")).alias("fixed"))
    rings = part.where("p_name like '% ring'").select(F.col("p_name").alias("name"), F.lit("phenotype").alias("kind"), F.concat(F.lit("name:"), "p_name").alias("id"), flag).distinct()
    return interpret(_mixed_texts(spark, d), brands.unionByName(types).unionByName(diseases).unionByName(rings))


@query(r"""
with l as (select p_partkey, lower(case p_size % 4 when 0 then 'Late-onset ' when 1 then '' when 2 then p_type || ' ' else 'model ' end || p_name || case p_size % 5 when 0 then '' when 1 then ' type a' when 2 then ' c1' when 3 then ' b' else ' type 2' end) as label,
  [p_name || ' c', p_name, 'severe ' || p_name || ' form of ' || lower(p_type), p_name || ' 2b'] as names from part),
w as (select p_partkey, string_split(replace(label, '-', ' '), ' ') as w, list_transform(names, lambda x: string_split(x, ' ')) as ns from l),
n as (select p_partkey, w, ns, unnest(ns) as n, generate_subscripts(ns, 1) as nth from w),
u as (select * from n where not regexp_matches(n[-1], '(^|[^su])s$')),
kn as (select p_partkey, list_distinct(list_filter(flatten(list(n)), lambda x: regexp_matches(x, '^(?:[ivx]{1,4}|[0-9]+[a-z]?|[a-z][0-9]{0,2})$'))) as known from u group by 1),
i as (select u.*, known, unnest(range(1, len(w) - len(n) + 2)) as i from u join kn using (p_partkey) where len(w) >= len(n)),
s as (select *, w[i + len(n) - 1] as last, n[-1] as want, w[:i - 1] || w[i + len(n):] as rest from i where w[i:i + len(n) - 2] = n[1:len(n) - 1]),
e as (select *, list_filter(rest, lambda x: regexp_matches(x, '^(?:[ivx]{1,4}|[0-9]+[a-z]?|[a-z][0-9]{0,2})$')) as marks from s where last = want or (starts_with(last, want) and ((regexp_matches(want, '^[a-z]$') and regexp_matches(substr(last, len(want) + 1), '^[0-9]{1,2}$')) or (regexp_matches(want, '^[0-9]+$') and regexp_matches(substr(last, len(want) + 1), '^[a-z]$'))))),
d as (select p_partkey, nth, i, unnest(marks) as m, unnest(range(1, len(marks) + 1)) as o, known from e),
x as (select distinct p_partkey, nth, i from d anti join (
    select p_partkey, nth, i, o from (select *, unnest(known) as k from d) where m = k
      or (starts_with(m, k) and ((regexp_matches(k, '^[a-z]$') and regexp_matches(substr(m, len(k) + 1), '^[0-9]{1,2}$')) or (regexp_matches(k, '^[0-9]+$') and regexp_matches(substr(m, len(k) + 1), '^[a-z]$'))))
      or (starts_with(k, m) and ((regexp_matches(m, '^[a-z]$') and regexp_matches(substr(k, len(m) + 1), '^[0-9]{1,2}$')) or (regexp_matches(m, '^[0-9]+$') and regexp_matches(substr(k, len(m) + 1), '^[a-z]$'))))) ok using (p_partkey, nth, i, o)),
g as (select p_partkey, nth, i, case when len(rest) > 0 or last <> want then 'qualified' else 'same name' end as told from e anti join x using (p_partkey, nth, i) where not list_contains(rest, 'model')),
f as (select p_partkey, arg_min(told, [nth, i]) as told from g group by 1),
pa as (select distinct p_partkey from (select *, unnest(range(1, len(n) - len(w) + 2)) as j from u where len(n) > len(w)) where n[j:j + len(w) - 1] = w and len(list_filter(n[:j - 1] || n[j + len(w):], lambda x: x not in ('severe', 'form', 'of'))) = 0)
select p_partkey, label, coalesce(told, case when pa.p_partkey is not null then 'parent' end) as told from l left join f using (p_partkey) left join pa using (p_partkey)""")
def pf_17_qualified_match(spark, d):
    """Composed labels of parts against four names of the part."""
    size = F.col("p_size")
    before = F.element_at(F.array(F.lit("Late-onset "), F.lit(""), F.concat("p_type", F.lit(" ")), F.lit("model ")), size % 4 + 1)
    after = F.element_at(F.array(F.lit(""), F.lit(" type a"), F.lit(" c1"), F.lit(" b"), F.lit(" type 2")), size % 5 + 1)
    label = F.lower(F.concat(before, "p_name", after))
    names = F.array(F.concat("p_name", F.lit(" c")), F.col("p_name"), F.concat(F.lit("severe "), "p_name", F.lit(" form of "), F.lower("p_type")), F.concat("p_name", F.lit(" 2b")))
    return table(spark, d, "part").select("p_partkey", label.alias("label"), N.qualified_match(label, names).alias("told"))


@query(r"""
with x as (select s_suppkey, case s_suppkey % 6 when 0 then 'MONDO:0' || s_suppkey when 1 then 'mondo:7' || s_suppkey when 2 then 'mp:' || s_suppkey when 3 then null when 4 then 'GENO:1' else 'HP:' || s_suppkey end as curie,
  case s_suppkey % 7 when 0 then 'Obsolete ' || s_name when 1 then s_name || ' (non-human animal)' else s_name end as label, s_suppkey % 11 = 0 as taxon, s_suppkey % 13 = 0 as mode from supplier)
select s_suppkey, upper(split_part(coalesce(curie, ''), ':', 1)) in ('NCBITAXON', 'LOINC', 'OMIA', 'MP', 'ZP', 'WBPHENOTYPE', 'FBCV', 'XPO', 'DDPHENO', 'APO') or taxon or (coalesce(curie, '') ilike 'mondo:%' and not curie ilike 'mondo:0%')
    or lower(label) like '%non-human animal%' or lower(label) like 'obsolete %' as noise, coalesce(curie, '') like 'GENO:%' or mode as generic from x""")
def pf_06_07_noise_generic(spark, d):
    """Whether suppliers, under composed identifiers, labels and cross-references, are noise or generic."""
    key = F.col("s_suppkey")
    said = key.cast("string")
    curie = F.when(key % 6 == 0, F.concat(F.lit("MONDO:0"), said)).when(key % 6 == 1, F.concat(F.lit("mondo:7"), said)).when(key % 6 == 2, F.concat(F.lit("mp:"), said)).when(key % 6 == 4, "GENO:1").when(key % 6 == 5, F.concat(F.lit("HP:"), said))
    label = F.when(key % 7 == 0, F.concat(F.lit("Obsolete "), "s_name")).when(key % 7 == 1, F.concat("s_name", F.lit(" (non-human animal)"))).otherwise(F.col("s_name"))
    xrefs = F.when(key % 11 == 0, F.array(F.lit("HGNC:1"), F.lit("NCBITaxon:9"))).when(key % 11 == 1, F.array(F.lit("HGNC:1")))
    return table(spark, d, "supplier").select("s_suppkey", N.is_noise(curie, label, xrefs).alias("noise"), N.is_generic(curie, key % 13 == 0).alias("generic"))


def selection_tables(spark, d):
    """Orders of customers as items, their brands as keys, and three brands that each customer wants."""
    o = table(spark, d, "orders")
    items = o.select(F.col("o_custkey").alias("group"), F.col("o_orderkey").alias("item"), (F.lit(4) - F.substring("o_orderpriority", 1, 1).cast("int")).alias("level"), (F.col("o_orderstatus") == "F").alias("done"), "o_totalprice")
    items = ordered(items, F.desc("level"), F.desc("o_totalprice"), "item").withColumn("own", F.col("done") & (F.col("level") == 3)).drop("done", "o_totalprice")
    keys = table(spark, d, "lineitem").join(table(spark, d, "part"), F.expr("l_partkey = p_partkey")).join(o, F.expr("l_orderkey = o_orderkey")).select(F.col("o_custkey").alias("group"), F.col("o_orderkey").alias("item"), F.col("p_brand").alias("key"))
    brands = F.array(*(F.concat(F.lit("Brand#"), ((F.col("c_custkey") * 7 + i * i) % 25 + 1).cast("string")) for i in (1, 2, 3)))
    wanted = table(spark, d, "customer").select(F.col("c_custkey").alias("group"), F.posexplode(brands).alias("place", "key"))
    return items, keys, wanted


@query()
def gr_47_diverse_selection(spark, d):
    """Six orders of each customer that cover many brands, wanted ones and those of finished urgent orders first."""
    return diverse_selection(*selection_tables(spark, d), 6)
