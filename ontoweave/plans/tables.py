"""Tab-separated files of variants, annotations and associations, written from the driver's tables, read back and searched."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import search
from ..operators.lineage import settle
from ..sources import ontologies as O
from ..sources import tables as T
from .files import _fresh
from .registry import query, table


def _variants(spark, d):
    """Parts as variations, most on two assemblies."""
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    p = table(spark, d, "part").withColumn("Assembly", F.explode(F.when(k % 3 == 0, F.array(F.lit("GRCh37"))).otherwise(F.array(F.lit("GRCh37"), F.lit("GRCh38")))))
    stars = F.element_at(F.array(*map(F.lit, T.REVIEW_STARS), F.lit("none")), (k % 6 + 1).cast("int"))
    ids = F.concat(F.lit("MONDO:MONDO:"), k.cast("string"), F.lit(",OMIM:"), size, F.lit(",x:1|MedGen:C"), size, F.lit(";-"))
    rows = p.select(
        k.alias("VariationID"), "Assembly", F.col("p_name").alias("Name"), F.when(k % 2 == 0, k.cast("string")).otherwise("-1").alias("RS# (dbSNP)"),
        F.when(k % 5 == 0, "Conflicting classifications of pathogenicity").when(k % 5 == 1, "Likely pathogenic").otherwise("Benign").alias("ClinicalSignificance"), stars.alias("ReviewStatus"),
        (F.col("p_size") + F.when(F.col("Assembly") == "GRCh38", 100).otherwise(0)).alias("NumberSubmitters"), ids.alias("PhenotypeIDS"), F.concat("p_type", F.lit("|"), "p_brand", F.lit(";not provided")).alias("PhenotypeList"),
        F.concat(size, F.lit(";7")).alias("GeneID"), F.concat(F.lit("g"), size).alias("GeneSymbol"), F.concat(F.lit("HGNC:"), size).alias("HGNC_ID"))
    path = _fresh(spark, "variants")
    rows.write.csv(path, sep="\t", header=True)
    return T.variant_summary(spark, path)


VARIANTS = """v as (select p_partkey as vid, p_name as name, case when p_partkey % 2 = 0 then p_partkey::varchar end as rs, p_partkey % 5 = 1 as pathogenic, case p_partkey % 6 when 0 then 4 when 1 then 3 when 2 then 2 when 5 then 0 else 1 end as stars,
  p_size + case when p_partkey % 3 = 0 then 0 else 100 end as submitters, p_type || '=MONDO:MONDO:' || p_partkey || ',OMIM:' || p_size || '|' || p_brand || '=UMLS:C' || p_size as traits, p_size || '/g' || p_size || '/HGNC:' || p_size || ';7/-/-' as genes, p_size from part)"""


def _flat(rows):
    ref = lambda x: F.concat(x["prefix"], F.lit(":"), x["id"])
    trait = lambda t: F.concat(t["name"], F.lit("="), F.array_join(F.transform(t["xrefs"], ref), ","))
    gene = lambda g: F.array_join(F.array(g["geneid"], g["symbol"], g["hgnc"]), "/", "-")
    return rows.select("vid", "name", "rs", "pathogenic", "stars", "submitters", F.array_join(F.transform("traits", trait), "|").alias("traits"), F.array_join(F.transform("genes", gene), ";").alias("genes"))


@query(f"with {VARIANTS} select * exclude (p_size) from v")
def src_17_variant_summary(spark, d):
    return _flat(_variants(spark, d))


@query(f"""with {VARIANTS}, s as (select * from v order by stars desc, submitters desc, vid desc)
select 'symbol' as field, vid from (select vid from s where p_size = 7 limit 20) union all select 'pathogenic', vid from (select vid from s where p_size = 7 and pathogenic limit 20)
union all select 'trait', vid from (select vid from s where p_size = 9 limit 20) union all select 'rs', vid from s where vid = 18""")
def ft_09_variant_search(spark, d):
    """The best reviewed variations of a gene, of a gene if pathogenic, of a trait, and of an rs number."""
    v = _variants(spark, d)
    asked = {"symbol": ("symbol", "G7", False), "pathogenic": ("hgnc", "7", True), "trait": ("trait", "UMLS:c9", False), "rs": ("rs", "rs18", False)}
    found = None
    for name, (field, value, only) in asked.items():
        rows = T.variant_search(v, field, value, 20, only).select(F.lit(name).alias("field"), "vid")
        found = rows if found is None else found.unionByName(rows)
    return found


def _annotated(spark, d):
    li = table(spark, d, "lineitem").join(table(spark, d, "part"), F.expr("l_partkey = p_partkey"))
    ids = F.concat(F.lit("MESH:P"), F.col("l_partkey").cast("string"), F.lit(";"), F.when(F.col("l_linenumber") % 3 == 0, "-").otherwise(F.concat(F.lit("B"), "p_brand")))
    rows = li.select(F.col("l_orderkey").cast("string").alias("pmid"), F.element_at(F.array(*map(F.lit, ("Disease", "Gene", "Chemical"))), (F.col("l_partkey") % 3 + 1).cast("int")).alias("type"), ids.alias("c"), F.concat("p_brand", F.lit("|other")).alias("m"), F.lit("r").alias("r"))
    path = _fresh(spark, "annotated")
    rows.write.csv(path, sep="\t")
    return path


@query("""
with li as (select * from lineitem join part on l_partkey = p_partkey where l_orderkey in (select o_orderkey from orders where o_orderstatus = 'F')),
x as (select l_orderkey, (['Disease', 'Gene', 'Chemical'])[l_partkey % 3 + 1] as type, 'MESH:P' || l_partkey as db_id, case when l_partkey % 2 = 0 then p_name else p_brand end as name from li
  union all select l_orderkey, (['Disease', 'Gene', 'Chemical'])[l_partkey % 3 + 1], 'B' || p_brand, p_brand from li where l_linenumber % 3 <> 0)
select type, db_id, name, count(distinct l_orderkey) as papers from x group by all""")
def src_23_text_concepts(spark, d):
    """Parts and brands as concepts in annotations of orders; orders that are done are the subset; parts of even number have known names."""
    subset = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("pmid"))
    k = F.col("p_partkey")
    names = table(spark, d, "part").where("p_partkey % 2 = 0").select(F.element_at(F.array(*map(F.lit, ("Disease", "Gene", "Chemical"))), (k % 3 + 1).cast("int")).alias("type"), F.concat(F.lit("MESH:P"), k.cast("string")).alias("db_id"), F.col("p_name").alias("name"))
    return T.concepts(settle(T.text_annotations(spark, _annotated(spark, d), subset), "concepts"), names)


@query("""
select l_orderkey as pmid, case when l_linenumber % 3 <> 2 then 'rs' || l_partkey end as rs, case when l_linenumber % 3 = 1 then 'p.' || l_suppkey end as hgvs, case when l_linenumber % 3 > 0 then l_suppkey::varchar end as gene, l_returnflag as mention from lineitem""")
def src_23_mutations(spark, d):
    """Lines as changes: bare rs numbers, labelled lists with one, and lists without."""
    n, p, s = F.col("l_linenumber") % 3, F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")
    concept = F.when(n == 0, F.concat(F.lit("rs"), p)).when(n == 1, F.concat(F.lit("tmVar:c;HGVS:p."), s, F.lit(";RS#:"), p, F.lit(";CorrespondingGene:"), s)).otherwise(F.concat(F.lit("CorrespondingGene:"), s, F.lit(";x:RS")))
    path = _fresh(spark, "mutations")
    table(spark, d, "lineitem").select("l_orderkey", F.lit("Mutation"), concept.alias("c"), "l_returnflag", F.lit("r").alias("r")).write.csv(path, sep="\t")
    return T.mutations(spark, path)


GENES_SQL = "g as (select distinct upper(p_name) as symbol, 'ORPHA:' || l_suppkey as disease, (['MENDELIAN', 'POLYGENIC', 'Disease-causing germline', 'UNKNOWN'])[l_linenumber % 4 + 1] as association from lineitem join part on l_partkey = p_partkey)"


def _gene_diseases(spark, d):
    li = table(spark, d, "lineitem").join(table(spark, d, "part"), F.expr("l_partkey = p_partkey"))
    how = F.element_at(F.array(*map(F.lit, ("MENDELIAN", "POLYGENIC", "Disease-causing germline", "UNKNOWN"))), (F.col("l_linenumber") % 4 + 1).cast("int"))
    path = _fresh(spark, "gene-diseases")
    li.select(F.col("l_partkey").alias("ncbi_gene_id"), F.col("p_name").alias("gene_symbol"), how.alias("association_type"), F.concat(F.lit("ORPHANET:"), F.col("l_suppkey").cast("string")).alias("disease_id")).write.csv(path, sep="\t", header=True)
    return T.gene_diseases(spark, path)


@query(f"with {GENES_SQL} select * from g")
def src_10_gene_diseases(spark, d):
    """Parts as genes of suppliers as diseases, each association once."""
    return _gene_diseases(spark, d)


@query(f"with {GENES_SQL} select distinct symbol, disease from g where association = 'MENDELIAN' or association like 'Disease-causing%'")
def pf_10_causal(spark, d):
    return _gene_diseases(spark, d).where(T.is_causal(F.col("association"))).select("symbol", "disease").distinct()


@query("""
select l_orderkey, l_linenumber, l_partkey, l_linenumber % 5 in (0, 1, 3) as excluded from lineitem""")
def pf_09_excluded_frequency(spark, d):
    """Which of five forms of a frequency mean never."""
    said = F.element_at(F.array(*map(F.lit, ("0%", "0/3", "12%", " HP:0040285 ", "0/0"))), (F.col("l_linenumber") % 5 + 1).cast("int"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", O.excluded_frequency(said).alias("excluded"))


@query("""
select 'MONDO:' || l_suppkey as src, 'HP:' || l_partkey as dst, 'has_phenotype' as relation from lineitem where l_returnflag <> 'R' and l_linenumber % 3 = 0
union all select 'HGNC:' || l_suppkey, 'MONDO:' || l_partkey, 'causes' from lineitem where l_returnflag <> 'R' and l_linenumber % 3 = 1""")
def pf_11_sound_associations(spark, d):
    """Lines as associations: returned ones are denied, and a third have identifiers of the wrong kind."""
    n, s, p = F.col("l_linenumber") % 3, F.col("l_suppkey").cast("string"), F.col("l_partkey").cast("string")
    li = table(spark, d, "lineitem").select(
        F.concat(F.when(n == 0, "MONDO:").otherwise("HGNC:"), s).alias("subject"), F.when(n == 1, "biolink:causes").otherwise("biolink:has_phenotype").alias("predicate"), F.concat(F.when(n == 0, "HP:").otherwise("MONDO:"), p).alias("object"),
        F.when(F.col("l_returnflag") == "R", True).alias("negated"))
    return T.sound_associations(li)


@query("select o_custkey, o_orderkey, place from (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey)::int as place from orders) where place <= greatest(1, least(25, o_custkey % 40 - 5))")
def tk_09_clamped_limit(spark, d):
    """Each customer's dearest orders, as many as asked for by the customer's number, at least one and at most 25."""
    rows = T.first_rows(table(spark, d, "orders"), "o_custkey", [F.desc("o_totalprice"), F.col("o_orderkey")], (F.col("o_custkey") % 40 - 5).cast("int"))
    return rows.select("o_custkey", "o_orderkey", "place")


@query(r"""
with w as (select doc_id, doc_id % 30 as year, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') as w, regexp_extract_all(lower(coalesce(source, '')), '[\p{L}\p{N}]+') as sw from documents),
c as (select doc_id, year, len(w) + len(sw) as l, len(list_filter(w, lambda x: x = 'that')) + 4.0 * len(list_filter(sw, lambda x: x = 'that')) as a, len(list_filter(w, lambda x: x = 'src1')) + 4.0 * len(list_filter(sw, lambda x: x = 'src1')) as b from w),
s as (select count(*)::double as n, avg(l) as m, sum((a > 0)::int)::double as da, sum((b > 0)::int)::double as db from c),
r as (select doc_id, year, round((ln(1 + (n - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * l / m)) + ln(1 + (n - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * l / m)))::double, 6) as score from c, s where a > 0 and b > 0)
select doc_id, year, score, (select count(*) from r) as total from r order by year desc, score desc, doc_id limit 50 offset 10""")
def ft_07_project_search(spark, d):
    """A page of documents that hold both words in the text or the source, latest year first, then by score; and how many there are in all."""
    docs = table(spark, d, "documents").select("doc_id", "text", "source", (F.col("doc_id") % 30).alias("year"))
    return search.latest_first(search.build_index(docs, ["source", "text"]), docs, ["that", "src1"], True, {"source": 4.0, "text": 1.0}, 50, 10)
