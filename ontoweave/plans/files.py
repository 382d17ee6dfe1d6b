"""Files of several formats, written from the driver's tables and read back whole."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators.lineage import shared_dir
from ..sources import archives as A
from ..sources import ontologies as O
from ..sources import xml as X
from .registry import query, table


def _fresh(spark, name):
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("select kind, count(*) as rows, count(distinct p_partkey) as parts, min(p_name) as first_name, sum(p_size)::bigint as sizes, 0::bigint as bad from part, (values ('zip'), ('tar'), ('tar.gz')) k(kind) group by kind")
def src_12_19_archives(spark, d):
    """Parts as members of zip, tar and compressed tar archives; two of their five columns are read back."""
    part = table(spark, d, "part").select(*(F.col(c).cast("string") for c in ("p_partkey", "p_name", "p_brand", "p_type", "p_size")))
    found = None
    for kind in ("zip", "tar", "tar.gz"):
        path = _fresh(spark, "archives")
        A.write_archives(part.repartition(3, "p_partkey"), path, kind, member_rows=400)
        rows = A.read_archives(spark, path, ["p_partkey", "p_name", "p_size"]).groupBy(F.lit(kind).alias("kind")).agg(
            F.count("p_partkey").alias("rows"), F.count_distinct("p_partkey").alias("parts"), F.min("p_name").alias("first_name"), F.sum(F.col("p_size").cast("long")).alias("sizes"), F.count("_error").alias("bad"))
        found = rows if found is None else found.unionByName(rows)
    return found


@query("select o_orderkey, o_custkey, l_linenumber as line, l_partkey as part, l_returnflag as flag from orders join lineitem on o_orderkey = l_orderkey")
def src_13_15_nested_xml(spark, d):
    """Orders with their lines as nested XML records, flattened again."""
    li = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_linenumber").alias("_number"), F.col("l_partkey").alias("part"), F.col("l_returnflag").alias("flag"))).alias("line"))
    records = table(spark, d, "orders").join(li, F.expr("o_orderkey = l_orderkey")).select(F.col("o_orderkey").alias("_id"), F.col("o_custkey").alias("customer"), F.struct("line").alias("lines"))
    path = _fresh(spark, "xml")
    records.write.format("xml").option("rowTag", "order").option("rootTag", "orders").option("maxRecordsPerFile", X.RECORDS_PER_FILE).save(path)
    read = X.read_records(spark, path, "order", "_id long, customer long, lines struct<line: array<struct<_number: int, part: long, flag: string>>>")
    return read.select(F.col("_id").alias("o_orderkey"), F.col("customer").alias("o_custkey"), F.inline("lines.line")).select("o_orderkey", "o_custkey", F.col("_number").alias("line"), "part", "flag")


@query("""
with e as (select 'region:' || r_regionkey as a, 'nation:' || n_nationkey as b from region join nation on r_regionkey = n_regionkey union all select 'nation:' || n_nationkey, 'supplier:' || s_suppkey from nation join supplier on n_nationkey = s_nationkey),
n as (select 'region:' || r_regionkey as x from region join nation on r_regionkey = n_regionkey join supplier on n_nationkey = s_nationkey union select 'nation:' || n_nationkey from nation join supplier on n_nationkey = s_nationkey union select 'supplier:' || s_suppkey from supplier)
select x as ancestor, x as descendant, 0 as distance from n union all select a, b, 1 from e semi join n on b = x union all select e.a, f.b, 2 from e join e f on e.b = f.a""")
def src_14_xml_classification(spark, d):
    """Regions, nations and suppliers as one nested classification, walked to all pairs of ancestor and descendant."""
    named = lambda t, c: F.concat(F.lit(f"{t}:"), F.col(c).cast("string")).alias("_id")
    low = table(spark, d, "supplier").groupBy("s_nationkey").agg(F.collect_list(F.struct(named("supplier", "s_suppkey"))).alias("node"))
    mid = table(spark, d, "nation").join(low, F.expr("n_nationkey = s_nationkey")).groupBy("n_regionkey").agg(F.collect_list(F.struct(named("nation", "n_nationkey"), "node")).alias("node"))
    top = table(spark, d, "region").join(mid, F.expr("r_regionkey = n_regionkey")).select(named("region", "r_regionkey"), "node")
    path = _fresh(spark, "classification")
    top.write.format("xml").option("rowTag", "class").option("rootTag", "classification").save(path)
    read = X.read_records(spark, path, "class", "_id string, node array<struct<_id: string, node: array<struct<_id: string>>>>")
    return X.walk(read, "node", "_id", 3)


@query("select o_orderkey as id, case when o_orderkey % 5 = 0 then 'revised' else o_orderpriority end as title, case when o_orderkey % 5 = 0 then '2' else '1' end as version from orders where o_orderkey % 7 <> 0 or o_orderkey % 5 = 0")
def src_22_xml_replay(spark, d):
    """Orders as citations: a first file of all, a second that deletes some, a third that writes some again."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("_id"), F.col("o_orderpriority").alias("title"))
    path = _fresh(spark, "citations")
    steps = {"1-baseline": ("citation", o.withColumn("version", F.lit("1"))), "2-deletes": ("deleted", o.where("_id % 7 = 0").select("_id", F.lit("x").alias("why"))), "3-updates": ("citation", o.where("_id % 5 = 0").select("_id", F.lit("revised").alias("title"), F.lit("2").alias("version")))}
    for name, (tag, rows) in steps.items():
        rows.write.format("xml").option("rowTag", tag).option("rootTag", "set").save(f"{path}/step={name}")
    step = F.regexp_extract(F.col("_metadata.file_path"), "step=([^/]+)/", 1)
    read = lambda tag, schema: spark.read.format("xml").option("rowTag", tag).schema(schema).load(f"{path}/step=*").withColumn("file", step).withColumnRenamed("_id", "id")
    return X.replay(read("citation", "_id long, title string, version string"), read("deleted", "_id long"), ["id"]).select("id", "title", "version")


def _stanzas(spark, d):
    """Parts below their brands and types as ontology stanzas, with a synonym each; every tenth part is obsolete."""
    p = table(spark, d, "part")
    ident = F.concat(F.lit("P:"), F.col("p_partkey").cast("string"))
    low = p.select(F.concat(
        F.lit("[Term]\nid: "), ident, F.lit("\nname: "), "p_name", F.lit('\nsynonym: "'), F.upper("p_name"), F.lit('" EXACT []\nis_a: B:'), "p_brand", F.lit(" ! brand\nis_a: T:"), "p_type",
        F.lit("\nrelationship: size_of S:"), F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 10 == 0, "\nis_obsolete: true").otherwise("")).alias("value"))
    high = p.select(F.explode(F.array(F.concat(F.lit("B:"), "p_brand"), F.concat(F.lit("T:"), "p_type"))).alias("id")).distinct().select(F.concat(F.lit("[Term]\nid: "), "id", F.lit("\nname: "), "id", F.lit("\nis_a: ROOT")).alias("value"))
    path = _fresh(spark, "stanzas")
    low.unionByName(high).write.option("lineSep", "\n\n").text(path)
    return O.obo_stanzas(spark, path)


@query("""
with l as (select 'P:' || p_partkey as id, * from part), h as (select 'B:' || p_brand as id from part union select 'T:' || p_type from part)
select 'is_a' as what, id, 'B:' || p_brand as value from l where p_partkey % 10 <> 0 union all select 'is_a', id, 'T:' || p_type from l where p_partkey % 10 <> 0 union all select 'is_a', id, 'ROOT' from h
union all select 'EXACT', id, upper(p_name) from l union all select 'size_of', id, 'S:' || p_size from l
union all select case when p_partkey % 10 = 0 then 'obsolete' else 'name' end, id, p_name from l union all select 'name', id, id from h""")
def src_01_02_03_04_ontology_stanzas(spark, d):
    """Names, parents, synonyms and relations of parts, scanned from ontology stanzas."""
    terms = _stanzas(spark, d)
    names = terms.select(F.when(F.col("obsolete"), "obsolete").otherwise("name").alias("what"), "id", F.col("name").alias("value"))
    parents = O.obo_is_a(terms).select(F.lit("is_a").alias("what"), F.col("child").alias("id"), F.col("parent").alias("value"))
    synonyms = O.obo_synonyms(terms).select(F.col("scope").alias("what"), "id", F.col("name").alias("value"))
    relations = O.obo_relations(terms).select(F.col("relation").alias("what"), "id", F.col("target").alias("value"))
    return names.unionByName(parents).unionByName(synonyms).unionByName(relations)


@query("select 'HGNC:' || p_partkey as hgnc_id, upper(p_name) as name, 'symbol' as kind from part union select 'HGNC:' || p_partkey, upper(p_brand), 'alias' from part union select 'HGNC:' || p_partkey, upper(p_type), 'alias' from part union select 'HGNC:' || p_partkey, 'OLD' || p_size, 'previous' from part where p_size % 3 = 0")
def src_06_gene_table(spark, d):
    """Parts as a table of genes with symbols, aliases and earlier symbols, scanned again."""
    p = table(spark, d, "part")
    rows = p.select(F.concat(F.lit("HGNC:"), F.col("p_partkey").cast("string")).alias("hgnc_id"), F.col("p_name").alias("symbol"), F.concat("p_brand", F.lit("| "), "p_type").alias("alias_symbol"),
                    F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("old"), F.col("p_size").cast("string"))).alias("prev_symbol"))
    path = _fresh(spark, "genes")
    rows.write.csv(path, sep="\t", header=True)
    return O.gene_names(spark, path)


@query("""
with r as (select 'OMIM:' || o_custkey as disease, 'HP:' || l_partkey as term, l_linenumber as n, l_orderkey as k from orders join lineitem on o_orderkey = l_orderkey),
f as (select *, k % 11 = 0 as denied, case n % 4 when 0 then 0.0 when 1 then 0.5 when 2 then 0.25 else null end as f from r)
select disease, term, count(*) filter (where not denied) as rows, count(*) filter (where not denied and n % 4 <> 0) as present from f group by all""")
def src_07_08_09_annotation_table(spark, d):
    """Customers' lines as an annotation table with comments, NOT rows and three forms of frequency, scanned again."""
    n, none = F.col("l_linenumber") % 4, F.lit(None).cast("string")
    li = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.expr("o_orderkey = l_orderkey"))
    often = F.when(n == 0, "0%").when(n == 1, "1/2").when(n == 2, "25%")
    rows = li.select(F.concat(F.lit("OMIM:"), F.col("o_custkey").cast("string")), F.lit("name"), F.when(F.col("l_orderkey") % 11 == 0, "NOT"), F.concat(F.lit("HP:"), F.col("l_partkey").cast("string")), F.lit("PMID:1"), F.lit("PCS"), none, often, none, none, F.lit("P"), F.lit("x")).toDF(*(f"c{i}" for i in range(12)))
    path = _fresh(spark, "annotations")
    lines = rows.select(F.array_join(F.array(*(F.coalesce(F.col(c), F.lit("")) for c in rows.columns)), "\t").alias("value"))
    comments = lines.sparkSession.range(3).select(F.concat(F.lit("# comment "), F.col("id").cast("string")).alias("value"))
    comments.unionByName(lines).write.text(path)
    read = O.annotation_table(spark, path)
    key = [F.col("database_id").alias("disease"), F.col("hpo_id").alias("term")]
    every = read.select(*key, (F.coalesce("qualifier", F.lit("")) != "NOT").cast("long").alias("rows"), F.lit(0).cast("long").alias("present"))
    present = O.present_annotations(read).select(*key, F.lit(0).cast("long").alias("rows"), F.lit(1).cast("long").alias("present"))
    return every.unionByName(present).groupBy("disease", "term").agg(F.sum("rows").alias("rows"), F.sum("present").alias("present"))


@query("""
select 'case:' || o_custkey as id, 'OMIM:' || o_custkey as disease, count(distinct l_partkey) filter (where l_returnflag <> 'R') as observed, count(distinct l_partkey) filter (where l_returnflag = 'R') as excluded
from orders join lineitem on o_orderkey = l_orderkey group by all""")
def src_25_patient_records(spark, d):
    """Customers as patient records in JSON: parts returned are excluded terms, the others observed ones."""
    li = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.expr("o_orderkey = l_orderkey"))
    term = F.struct(F.struct(F.concat(F.lit("HP:"), F.col("l_partkey").cast("string")).alias("id")).alias("type"), (F.col("l_returnflag") == "R").alias("excluded"))
    of = F.array(F.struct(F.struct(F.concat(F.lit("OMIM:"), F.col("o_custkey").cast("string")).alias("id")).alias("term")))
    path = _fresh(spark, "patients")
    li.groupBy("o_custkey").agg(F.collect_list(term).alias("phenotypicFeatures")).select(F.concat(F.lit("case:"), F.col("o_custkey").cast("string")).alias("id"), "phenotypicFeatures", of.alias("diseases")).write.json(path)
    return O.cases(spark, path, lines=True).select("id", "disease", F.size("observed").cast("long").alias("observed"), F.size("excluded").cast("long").alias("excluded"))
