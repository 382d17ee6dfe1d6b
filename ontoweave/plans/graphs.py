"""Ontology, ranking, similarity, identity and graph queries, bound to the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.scores import degree_specificity
from ..operators import graph, identity, ontology, similarity
from ..operators.lineage import parts_for, settle
from .bindings import ONTOLOGY_SQL, annotations, closed, index, is_a, lines_by_order
from .registry import query, table


@query(ONTOLOGY_SQL + "select descendant, ancestor, depth from closed")
def gr_01_closure(spark, d):
    return closed(spark, d)


@query(ONTOLOGY_SQL + "select descendant from closed where ancestor = 'brand:Brand#12'")
def gr_02_descendants(spark, d):
    return closed(spark, d).where("ancestor = 'brand:Brand#12'").select("descendant")


@query(ONTOLOGY_SQL + "select descendant as node, depth from closed where ancestor = 'brand:Brand#13' order by depth, node limit 60")
def gr_03_bounded_breadth_first(spark, d):
    return closed(spark, d).where("ancestor = 'brand:Brand#13'").select(F.col("descendant").alias("node"), "depth").orderBy("depth", "node").limit(60)


@query(ONTOLOGY_SQL + "select descendant as node, coalesce(arg_min(ancestor, depth || ancestor) filter (ancestor like 'type:%' or ancestor like 'brand:%'), 'Other') as category from closed group by 1")
def gr_04_top_category(spark, d):
    shut = closed(spark, d)
    return ontology.top_category(shut, shut.where("ancestor like 'type:%' or ancestor like 'brand:%'").select("ancestor").distinct())


@query(ONTOLOGY_SQL + ", s as (select n from nodes where n like 'type:%') select ancestor as start, descendant as node, depth from closed join s on ancestor = n where depth <= 1 union all select descendant, ancestor, -depth from closed join s on descendant = n where depth = 1")
def gr_05_family(spark, d):
    edges = is_a(spark, d)
    start = edges.where("child like 'type:%'").select(F.col("child").alias("node")).distinct()
    up = ontology.reach(edges, start, 1, down=False).where("depth = 1")
    return ontology.reach(edges, start, 1).unionByName(up.withColumn("depth", -F.col("depth")))


@query(ONTOLOGY_SQL + "select n as node, (select count(*) from is_a where child = n) as parents, (select count(*) from is_a where parent = n) as children from nodes")
def gr_06_one_hop(spark, d):
    edges = is_a(spark, d)
    ends = edges.select(F.col("child").alias("node"), F.lit(1).alias("p"), F.lit(0).alias("c")).union(edges.select("parent", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("p").alias("parents"), F.sum("c").alias("children"))


@query(ONTOLOGY_SQL + "select entity, term, round(freq, 6) as freq from prop where term not like 'part:%'")
def o_agg_04_propagated_frequency(spark, d):
    shut, ann = closed(spark, d), settle(annotations(spark, d), "annotations")
    return ontology.propagate(ann, shut.where("ancestor not like 'part:%'")).withColumn("freq", F.round("freq", 6))


@query(ONTOLOGY_SQL + "select term, df, round(ic, 6) as ic, round(specificity, 6) as specificity from weights")
def o_agg_05_06_information_content(spark, d):
    weights = index(spark, d)[3]
    return weights.select("term", "df", F.round("ic", 6).alias("ic"), F.round("specificity", 6).alias("specificity"))


@query("with m as (select c_custkey, r_name from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey), p as (select distinct o_custkey, p_brand from orders join lineitem on o_orderkey = l_orderkey join part on l_partkey = p_partkey) select r_name, p_brand, count(distinct c_custkey) as entities from m join p on o_custkey = c_custkey group by all")
def gr_30_regions(spark, d):
    """An entity is in a region when the region is among its ancestors: customer - nation - region."""
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.expr("c_nationkey = n_nationkey")).join(table(spark, d, "region"), F.expr("n_regionkey = r_regionkey"))
    li = table(spark, d, "lineitem").join(table(spark, d, "part"), F.expr("l_partkey = p_partkey"))
    p = table(spark, d, "orders").join(li, F.expr("o_orderkey = l_orderkey")).select("o_custkey", "p_brand").distinct()
    return c.join(p, F.expr("o_custkey = c_custkey")).groupBy("r_name", "p_brand").agg(F.count_distinct("c_custkey").alias("entities"))


def _supplier_features(spark, d):
    li = table(spark, d, "lineitem").join(table(spark, d, "part"), F.expr("l_partkey = p_partkey"))
    return (
        li.select(F.col("l_suppkey").alias("entity"), F.lit("pathway").alias("kind"), F.col("p_brand").alias("feature"))
        .union(li.select("l_suppkey", F.lit("phenotype"), F.col("p_size").cast("string"))).union(li.select("l_suppkey", F.lit("gene"), F.col("l_partkey").cast("string"))).distinct()
    )


TRIO_SQL = """
with li as (select l_suppkey, p_brand, p_size, l_partkey from lineitem join part on l_partkey = p_partkey),
f as (select distinct l_suppkey as entity, 'pathway' as kind, p_brand as feature from li union select distinct l_suppkey, 'phenotype', p_size::varchar from li union select distinct l_suppkey, 'gene', l_partkey::varchar from li),
n as (select entity, kind, count(*) as n from f group by all),
s as (select a.entity as anchor, b.entity, kind, count(*) as shared from f a join f b using (kind, feature) where a.entity = 1 and b.entity <> 1 group by all),
j as (select anchor, s.entity, kind, shared::double / (x.n + y.n - shared) as j from s join n x using (entity, kind) join n y on y.entity = anchor and y.kind = s.kind),
w as (select anchor, entity, coalesce(max(j) filter (kind = 'pathway'), 0) as pathway, coalesce(max(j) filter (kind = 'phenotype'), 0) as phenotype, coalesce(max(j) filter (kind = 'gene'), 0) as gene from j group by all)
select anchor, entity, round(0.45::double * pathway + 0.35::double * phenotype + 0.2::double * gene, 4) as score,
  case when (phenotype > 0 and 0.45::double * pathway + 0.35::double * phenotype + 0.2::double * gene >= 0.2) or 0.45::double * pathway + 0.35::double * phenotype + 0.2::double * gene >= 0.25 then 'medium' else 'low' end as confidence,
  round(pathway, 6) as pathway, round(phenotype, 6) as phenotype, round(gene, 6) as gene from w
"""


@query(TRIO_SQL)
def gr_32_trio_similarity(spark, d):
    f = _supplier_features(spark, d)
    found = similarity.trio_similarity(f, f.where("entity = 1").select("entity").distinct())
    return found.select("anchor", "entity", "score", "confidence", *(F.round(c, 6).alias(c) for c in ("pathway", "phenotype", "gene")))


@query("with r as (select o_custkey, l_partkey, list(distinct o_orderkey) as refs from orders join lineitem on o_orderkey = l_orderkey group by all), c as (select o_custkey, min(o_orderkey) as held from orders group by 1) select r.o_custkey, l_partkey from r join c using (o_custkey) where not (len(refs) = 1 and refs[1] = held)")
def gr_39_holdout(spark, d):
    """Annotations that rest on the held-out reference alone are hidden, for each case by itself."""
    o = table(spark, d, "orders")
    refs = o.join(table(spark, d, "lineitem"), F.expr("o_orderkey = l_orderkey")).groupBy("o_custkey", "l_partkey").agg(F.min("o_orderkey").alias("low"), F.max("o_orderkey").alias("high"))
    held = o.groupBy("o_custkey").agg(F.min("o_orderkey").alias("held"))
    return refs.join(held, "o_custkey").where("not (low = high and low = held)").select("o_custkey", "l_partkey")


@query("select o_custkey as \"case\", l_partkey from (select distinct o_custkey, l_partkey from orders join lineitem on o_orderkey = l_orderkey) where substr(md5('5:' || o_custkey || ':' || l_partkey), 1, 1) < '8'")
def gr_40_perturbed_sample(spark, d):
    """Half of each case's terms, by a seeded hash."""
    x = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.expr("o_orderkey = l_orderkey")).select(F.col("o_custkey").alias("case"), "l_partkey").distinct()
    draw = F.md5(F.concat_ws(":", F.lit("5"), F.col("case").cast("string"), F.col("l_partkey").cast("string")))
    return x.where(F.substring(draw, 1, 1) < "8")


@query("with recursive e as (select doc_id as a, min(doc_id) over (partition by md5(text)) as b from documents) select a as node, b as component from e where a <> b or b in (select b from e group by 1 having count(*) > 1)")
def gr_21_publication_components(spark, d):
    """Records are one publication when they share an identifier; here documents and the hashes of their texts."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("a"), F.md5("text").alias("k"))
    links = docs.join(docs.groupBy("k").agg(F.min("a").alias("b"), F.count("*").alias("n")).where("n > 1"), "k").select("a", "b")
    return identity.connected_components(links)


def _text_words(spark, d):
    """The words of each different text, named by its smallest document."""
    one = table(spark, d, "documents").groupBy("text").agg(F.min("doc_id").alias("entity"))
    return one.select("entity", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[\\p{L}]+"), 0))).alias("feature"))


@query("with f as (select distinct 'part:' || l_partkey as process, l_suppkey::varchar as member from lineitem), p as (select process, list_sort(list(member)) as members from f group by 1 having count(*) > 1) select process, len(members)::int as size, 'pathway-' || substr(sha256('[\"pathway\", \"' || process || '\", [' || list_aggregate(list_transform(members, lambda x: '\"' || x || '\"'), 'string_agg', ', ') || ']]'), 1, 20) as id from p")
def gr_23_25_pathway_groups(spark, d):
    """Suppliers that sell one part."""
    li = table(spark, d, "lineitem").select(F.concat(F.lit("part:"), F.col("l_partkey").cast("string")).alias("process"), F.col("l_suppkey").cast("string").alias("member"))
    return identity.shared_process_groups(li.distinct()).select("process", F.size("members").alias("size"), "id")


@query()
def gr_24_complete_link(spark, d):
    """Clusters of texts that share four tenths of their words, each with each."""
    pairs = similarity.jaccard_pairs(_text_words(spark, d), 0.4)
    return identity.complete_link(pairs.select("a", "b", F.col("jaccard").alias("value")), 0.4)


@query()
def gr_15_veto_merge(spark, d):
    """Documents are linked by text and by length with their labels' numbers; a merge may not join two of one kind."""
    docs = table(spark, d, "documents").select("doc_id", F.md5("text").alias("k"), "n_chars", "source")
    a = docs.select(F.concat("source", F.lit(":"), F.col("doc_id").cast("string")).alias("a"), "k", "n_chars", "doc_id")
    first = a.groupBy("k").agg(F.min_by("a", "doc_id").alias("b"))
    same = a.join(first, "k").where("a <> b").select("a", "b", F.col("doc_id").alias("ord"))
    near = a.groupBy("n_chars").agg(F.min_by("a", "doc_id").alias("b"))
    return identity.veto_merge(same.union(a.join(near, "n_chars").where("a <> b").select("a", "b", (F.col("doc_id") + 1_000_000_000).alias("ord"))), ["src0", "src1", "src2"])


def _trade(spark, d):
    """Edges supplier - part - customer with the order as evidence."""
    li = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.expr("o_orderkey = l_orderkey"))
    s, p, c = (F.concat(F.lit(f"{n}:"), F.col(k).cast("string")) for n, k in (("supplier", "l_suppkey"), ("part", "l_partkey"), ("customer", "o_custkey")))
    edge = lambda src, relation: F.struct(src.alias("src"), p.alias("dst"), F.lit(relation).alias("relation"))
    shared = (F.col("l_shipdate").cast("string").substr(1, 4).alias("source"), F.array(F.concat(F.lit("order:"), F.col("l_orderkey").cast("string"))).alias("evidence"))
    # Both edges of a line come from its one row, so the tables are joined once.
    return li.select(F.inline(F.array(edge(s, "sells"), edge(c, "orders"))), *shared).select("src", "dst", "relation", "source", "evidence")


TRADE_SQL = """with li as (select * from lineitem join orders on o_orderkey = l_orderkey),
e as (select 'supplier:' || l_suppkey as src, 'part:' || l_partkey as dst, 'sells' as relation, substr(l_shipdate::varchar, 1, 4) as source, 'order:' || l_orderkey as proof from li
  union all select 'customer:' || o_custkey, 'part:' || l_partkey, 'orders', substr(l_shipdate::varchar, 1, 4), 'order:' || l_orderkey from li)"""


@query(TRADE_SQL + "select src, dst, relation, source, list_sort(list(distinct proof)) as evidence from e group by all")
def gr_19_build_graph(spark, d):
    """Ends and proofs are numbers until the edges are merged: thrice their key, with one more for suppliers and two for customers."""
    lines = lines_by_order(spark, d, "l_suppkey", F.col("l_shipdate").cast("string").substr(1, 4).alias("source"))
    edge = lambda key, kind, relation: F.struct((F.col(key) * 3 + kind).alias("src"), F.lit(relation).alias("relation"))
    edges = lines.select(F.inline(F.array(edge("l_suppkey", 1, "sells"), edge("o_custkey", 2, "orders"))), (F.col("l_partkey") * 3).alias("dst"), "source", F.col("o_orderkey").alias("proof"))
    merged = graph.build_graph(edges, parts_for(table(spark, d, "lineitem").count() * 2))
    sold = F.col("relation") == "sells"
    src = F.when(sold, F.concat(F.lit("supplier:"), F.expr("(src - 1) div 3").cast("string"))).otherwise(F.concat(F.lit("customer:"), F.expr("(src - 2) div 3").cast("string")))
    evidence = F.sort_array(F.transform("evidence", lambda k: F.concat(F.lit("order:"), k.cast("string"))))
    return merged.select(src.alias("src"), F.concat(F.lit("part:"), F.expr("dst div 3").cast("string")).alias("dst"), "relation", "source", evidence.alias("evidence"))


@query(TRADE_SQL + ", ends as (select src as n, dst as o from e union select dst, src from e), deg as (select n, count(*) as degree from ends group by 1) select n as node, degree, round(greatest(0.05, 1 - log10(1 + degree) / 4), 6) as specificity from deg")
def gr_53_degree_specificity(spark, d):
    e = _trade(spark, d)
    deg = e.select(F.col("src").alias("node"), F.col("dst").alias("o")).union(e.select("dst", "src")).distinct().groupBy("node").agg(F.count("*").alias("degree"))
    return deg.withColumn("specificity", F.round(degree_specificity(F.col("degree")), 6))


@query(TRADE_SQL + ", ends as (select src as n, dst as o, relation from e union select dst, src, relation from e), deg as (select n, count(distinct o) as degree from ends group by 1), h as (select n, count(distinct o) as named from ends where o like 'customer:%' group by 1 having count(distinct o) >= 2) select n as node, named, round(named * greatest(0.05, 1 - log10(1 + degree) / 4), 6) as score from h join deg using (n) order by score desc, node limit 25")
def gr_62_convergence_hubs(spark, d):
    e = _trade(spark, d)
    both = e.select(F.col("src").alias("node"), F.col("dst").alias("o")).union(e.select("dst", "src")).distinct()
    spec = both.groupBy("node").agg(F.round(degree_specificity(F.count("*")), 12).alias("specificity"))
    named = e.where("relation = 'orders'").select(F.col("src").alias("node")).distinct()
    found = graph.convergence_hubs(e, named, named.where("false"), spec, 25)
    return found.select("node", "named", F.round("score", 6).alias("score"))


@query()
def gr_17_frontier_expansion(spark, d):
    e = _trade(spark, d)
    ways = F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))
    both = e.select(F.inline(ways), "source").withColumn("weight", -F.length("dst"))
    return graph.expand_frontier(both, spark.createDataFrame([("supplier:1",)], "node string"), 2, 5, 50)


@query(TRADE_SQL + ", recursive_base as (select 'supplier:1' as node), r1 as (select distinct dst as node, 1 as length from e where src = 'supplier:1'), r2 as (select distinct src as node, 2 as length from e join r1 on dst = node where src <> 'supplier:1') select 'supplier:1' as node, 0 as length, null as via union all select node, length, 'supplier:1' from r1 union all select node, length, (select min(dst) from e join r1 x on x.node = dst where src = r2.node) from r2")
def gr_60_breadth_first_paths(spark, d):
    return graph.shortest_paths(_trade(spark, d), spark.createDataFrame([("supplier:1",)], "node string"), 2)


@query("select 'unknown_part' as issue, count(*) as n from lineitem where l_partkey not in (select p_partkey from part) union all select 'unknown_order', count(*) from lineitem where l_orderkey not in (select o_orderkey from orders) union all select 'short_label', count(*) from part where length(p_name) < 6 union all select 'repeated_text', count(*) from (select text from documents group by 1 having count(*) > 1)")
def gr_63_integrity(spark, d):
    li, p = table(spark, d, "lineitem"), table(spark, d, "part")
    n = F.count("*").alias("n")
    issue = lambda name, rows: rows.agg(n).select(F.lit(name).alias("issue"), "n")
    return (
        issue("unknown_part", li.join(p, F.expr("l_partkey = p_partkey"), "left_anti")).union(issue("unknown_order", li.join(table(spark, d, "orders"), F.expr("l_orderkey = o_orderkey"), "left_anti")))
        .union(issue("short_label", p.where("length(p_name) < 6"))).union(issue("repeated_text", table(spark, d, "documents").groupBy("text").count().where("count > 1")))
    )
