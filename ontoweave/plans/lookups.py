"""Concepts, variants, citations, relation groups and category searches on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lookups as L
from .registry import query, table


@query("select distinct c_custkey as concept, 's' || n_nationkey as entry, case when c_custkey % 2 = 0 then 'id' else 'name' end as by from customer join nation on c_nationkey = n_nationkey where c_custkey % 5 <> 4")
def gr_72_concept_match(spark, d):
    """Customers' nations as concepts, by identifier or by a name in another case and spacing; every fifth has a wrong name alone."""
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.expr("c_nationkey = n_nationkey"))
    k = F.col("c_custkey")
    spelt = F.when(k % 5 == 4, "nowhere").otherwise(F.concat(F.lit("  "), F.lower("n_name"), F.lit(" ")))
    by_id = (k % 2 == 0) & (k % 5 != 4)
    concepts = c.select(k.alias("concept"), F.when(by_id, F.concat(F.lit("M"), F.col("n_nationkey").cast("string"))).alias("exact_id"), F.array(F.when(by_id, "none").otherwise(spelt)).alias("names"))
    n = F.col("n_nationkey")
    entries = table(spark, d, "nation").select(F.concat(F.lit("s"), n.cast("string")).alias("entry"), F.concat(F.lit("M"), n.cast("string")).alias("db_id"), F.col("n_name").alias("name"), n.alias("place"))
    return L.match_concepts(concepts, entries)


@query("""
with m as (select l_orderkey as doc_id, 'P:' || p_size as key, p_brand as name, l_linenumber, l_partkey, l_suppkey from lineitem join part on l_partkey = p_partkey where p_size <> 7),
c as (select doc_id, key, arg_min(name, (l_linenumber, l_partkey, l_suppkey)) as name, count(*) as n, min((l_linenumber, l_partkey, l_suppkey)) as first from m group by all)
select doc_id, key, name, n, row_number() over (partition by doc_id order by n desc, first, key)::int as place from c""")
def gr_72_document_concepts(spark, d):
    """Orders as documents whose lines mention sizes of parts; one size is as common as a species and left out."""
    li = table(spark, d, "lineitem").join(table(spark, d, "part"), F.expr("l_partkey = p_partkey"))
    mentions = li.select(F.col("l_orderkey").alias("doc_id"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("at"), F.lit("P").alias("type"), F.col("p_size").cast("string").alias("identifier"), F.lit(None).cast("string").alias("accession"), F.col("p_brand").alias("name"), F.lit("").alias("text"))
    return L.summarize_concepts(mentions, ("P", "7")).select("doc_id", "key", "name", "n", "place")


@query("""
with v as (select p_partkey as variant, p_brand as gene, p_size as place from part), u as (select gene, place, min(variant) as variant from v group by all having count(*) = 1)
select p_partkey as asked, u.variant from part join u on p_brand = gene and p_size = place""")
def gr_73_unique_variants(spark, d):
    """Parts as changes at their size in their brand, asked for in three-letter spelling: those that only one part stands for."""
    p, at = table(spark, d, "part"), F.col("p_size").cast("string")
    variants = p.select(F.col("p_partkey").alias("variant"), F.array(F.upper("p_brand"), F.lit("other")).alias("genes"), F.concat(F.lit("p.V"), at, F.lit("*")).alias("change"))
    return L.resolve_variants(p.select(F.col("p_partkey").alias("asked"), F.col("p_brand").alias("gene"), F.concat(F.lit(" p.(Val"), at, F.lit("Ter)")).alias("change")), variants)


@query("""
with r as (select p_brand as gene, l_partkey as variant, l_orderkey as paper, min(l_shipdate) as seen from lineitem join part on l_partkey = p_partkey group by all),
b as (select gene, variant, row_number() over (partition by gene order by count(*) desc, variant)::int as rank from r group by gene, variant),
k as (select gene, variant, paper, rank, row_number() over (partition by gene, variant order by seen, paper)::int as place from r join b using (gene, variant) where rank <= 10)
select * from k where place <= 30""")
def gr_73_top_variants(spark, d):
    """The ten parts of each brand that most orders hold, with the first thirty orders of each."""
    li = table(spark, d, "lineitem").join(table(spark, d, "part"), F.expr("l_partkey = p_partkey"))
    return L.top_variant_papers(li.select(F.col("p_brand").alias("gene"), F.col("l_partkey").alias("variant"), F.col("l_orderkey").alias("paper"), F.col("l_shipdate").alias("at")), 10, 30)


@query("""
with l as (select l_orderkey as id, string_agg(p_name || case l_linenumber % 4 when 0 then '' when 3 then ' [1](x)'
    when 1 then case l_orderkey % 3 when 0 then ' [2]' when 1 then ' [1]' else ' ' end else case l_orderkey % 3 when 0 then ' [1]' else ' ' end end, '; ' order by l_linenumber, l_partkey, l_suppkey) as text
  from lineitem join part on l_partkey = p_partkey group by 1)
select id, text from l semi join orders on id = o_orderkey""")
def gr_79_remapped_citations(spark, d):
    """Orders as answers that cite sources by number, of which two, one or none were selected."""
    li = table(spark, d, "lineitem").join(table(spark, d, "part"), F.expr("l_partkey = p_partkey"))
    mark = F.element_at(F.array(*map(F.lit, ("", " [1]", " [3]", " [1](x)"))), (F.col("l_linenumber") % 4 + 1).cast("int"))
    lines = li.groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", F.concat("p_name", mark).alias("t")))).alias("l"))
    text = F.array_join(F.transform("l", lambda x: x["t"]), "; ")
    asked = F.array(F.lit("a"), F.lit("b"), F.lit("c"))
    chosen = F.when(F.col("id") % 3 == 0, F.array(F.lit("c"), F.lit("a"))).when(F.col("id") % 3 == 1, F.array(F.lit("a"))).otherwise(F.array(F.lit("z")))
    known = lines.join(table(spark, d, "orders").select(F.col("o_orderkey").alias("id")), "id", "left_semi")
    return known.select("id", L.remap_citations(text, asked, chosen).alias("text"))


RELATIONS = ("has_phenotype", "trial_drug_phase_2", "treated_by", "gene_of", "subclass_of", "xref", "sold_in")


@query("""
with r as (select 'supplier:' || l_suppkey as focus, 'part:' || l_partkey as node, (['has_phenotype', 'trial_drug_phase_2', 'treated_by', 'gene_of', 'subclass_of', 'xref', 'sold_in'])[l_linenumber % 7 + 1] as relation, year(l_shipdate::date) as source from lineitem),
g as (select *, case relation when 'has_phenotype' then 'Diseases with this phenotype' when 'trial_drug_phase_2' then 'Drugs / treatments' when 'treated_by' then 'Drugs / treatments' when 'gene_of' then 'Genes' when 'subclass_of' then 'Hierarchy' when 'xref' then 'Cross-references' else 'Other' end as grp,
  case relation when 'treated_by' then 0 when 'trial_drug_phase_2' then 3 else 9 end as stage from r),
a as (select focus, grp, node, list_sort(list(distinct relation)) as relations, count(distinct source) as sources, min(stage) as stage from g group by all)
select focus, grp as "group", node, array_to_string(relations, ',') as relations, sources, row_number() over (partition by focus, grp order by case when grp like 'Drugs%' then stage else 0 end, sources desc, node)::int as place from a""")
def gr_64_focus_groups(spark, d):
    """What each supplier is related to by its lines, under seven names of relations."""
    relation = F.element_at(F.array(*map(F.lit, RELATIONS)), (F.col("l_linenumber") % 7 + 1).cast("int"))
    s, p = F.concat(F.lit("supplier:"), F.col("l_suppkey").cast("string")), F.concat(F.lit("part:"), F.col("l_partkey").cast("string"))
    edges = table(spark, d, "lineitem").select(s.alias("src"), p.alias("dst"), relation.alias("relation"), F.year(F.col("l_shipdate").cast("date")).alias("source"))
    focus = table(spark, d, "supplier").select(F.concat(F.lit("supplier:"), F.col("s_suppkey").cast("string")).alias("focus"))
    kinds = table(spark, d, "part").select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("node"), F.lit("disease").alias("kind"))
    return L.focus_groups(edges, focus, kinds).withColumn("relations", F.array_join("relations", ","))


@query("""
select p_partkey, array_to_string((case when p_size % 4 < 2 then [] when p_size % 4 = 2 then ['gene' || p_size] else [p_name] end || list_filter([p_brand, p_type, p_name, 'x'], lambda x: x <> (case p_size % 4 when 0 then 'cat' when 1 then 'AB' when 2 then 'gene' || p_size else p_name end)))[1:3], '|') as terms from part""")
def pf_21_gene_terms(spark, d):
    """Parts as genes with a symbol that is a word, one that is short, a safe one, or none but the label."""
    k = F.col("p_size") % 4
    symbol = F.when(k == 0, "cat").when(k == 1, "AB").when(k == 2, F.concat(F.lit("gene"), F.col("p_size").cast("string"))).otherwise("")
    return table(spark, d, "part").select("p_partkey", F.array_join(L.gene_terms(symbol, F.col("p_name"), F.array("p_brand", "p_type", "p_name", F.lit("x"))), "|").alias("terms"))


@query("""
with e as (select l_partkey as gene, n_name as name, o_orderpriority as category, sum(l_quantity) as value from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by all),
k as (select name as asked, gene, value, category from e where category in ('1-URGENT', '2-HIGH'))
select asked, gene, category, round(value, 2) as value, row_number() over (partition by asked order by value desc, gene, category)::int as place from k""")
def ft_12_category_search(spark, d):
    """Parts by their quantity in each nation, for two priorities of orders as categories, the greatest first."""
    t = lambda name: table(spark, d, name)
    li = t("lineitem").join(t("orders"), F.expr("l_orderkey = o_orderkey")).join(t("customer"), F.expr("o_custkey = c_custkey")).join(t("nation"), F.expr("c_nationkey = n_nationkey"))
    enriched = li.groupBy(F.col("l_partkey").alias("gene"), F.lit("nation").alias("field"), F.col("n_name").alias("name"), F.col("o_orderpriority").alias("category")).agg(F.sum("l_quantity").alias("value"))
    asked = t("nation").select(F.col("n_name").alias("asked"), F.lit("nation").alias("field"), F.concat(F.lit(" "), F.lower("n_name")).alias("name"), F.array(F.lit("2-HIGH"), F.lit(" 1-URGENT")).alias("categories"))
    return L.category_search(enriched, asked).withColumn("value", F.round("value", 2))
