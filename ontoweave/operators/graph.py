"""Edge tables: building, expanding, path finding and checking."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import settle


def build_graph(edges: DataFrame, parts: int) -> DataFrame:
    """Parallel edges (src, dst, relation, source, proof) merged by relation and source: no loops; ``evidence``, the list of their different proofs.

    Most edges have few parallels, so they are dealt to ``parts`` partitions as they are and lists are only made there.
    """
    key = ["src", "dst", "relation", "source"]
    dealt = edges.where("src <> dst").repartition(parts, *key)
    return dealt.groupBy(*key).agg(F.array_distinct(F.collect_list("proof")).alias("evidence"))


def expand_frontier(edges: DataFrame, start: DataFrame, rounds: int, per_source: int, frontier: int) -> DataFrame:
    """(node, round, support): nodes reached from ``start`` (node) over edges (src, dst, source, weight).

    Each round asks every source for at most ``per_source`` best edges of each frontier node; of the new nodes the
    ``frontier`` with most distinct sources are asked next.
    """
    best = Window.partitionBy("source", "src").orderBy(F.desc("weight"), "dst")
    known = settle(start.select("node", F.lit(0).alias("round"), F.lit(0).cast("long").alias("support")), "frontier")
    asked = known.select("node")
    for r in range(1, rounds + 1):
        # Only edges of the nodes asked are made different and ranked; the nodes are settled, so that Spark knows how few they are.
        near = edges.join(asked.withColumnRenamed("node", "src"), "src", "left_semi").select("src", "dst", "source", "weight").distinct()
        hits = near.withColumn("n", F.row_number().over(best)).where(F.col("n") <= per_source).groupBy(F.col("dst").alias("node")).agg(F.count_distinct("source").alias("support"))
        fresh = settle(hits.join(known, "node", "left_anti").select("node", F.lit(r).alias("round"), "support"), "frontier")
        known = known.unionByName(fresh)
        if r < rounds:
            asked = settle(fresh.orderBy(F.desc("support"), "node").limit(frontier).select("node"), "asked")
    return known


def shortest_paths(edges: DataFrame, start: DataFrame, max_length: int) -> DataFrame:
    """(node, length, via): breadth-first distances over undirected edges (src, dst) with the smallest predecessor.

    Each round reads the edges once, against the nodes that the one before found; parallel edges need no merging, as the smallest
    predecessor does that.
    """
    both = edges.select(F.inline(F.array(F.struct(F.col("src").alias("node"), F.col("dst").alias("to")), F.struct(F.col("dst").alias("node"), F.col("src").alias("to")))))
    known = fresh = settle(start.select("node", F.lit(0).alias("length"), F.lit(None).cast(start.schema["node"].dataType).alias("via")), "paths")
    for length in range(1, max_length + 1):
        step = both.join(fresh, "node").groupBy("to").agg(F.min("node").alias("via"))
        fresh = settle(step.withColumnRenamed("to", "node").join(known, "node", "left_anti").select("node", F.lit(length).alias("length"), "via"), "paths")
        if fresh.isEmpty():
            break
        known = known.unionByName(fresh)
    return known


def convergence_hubs(edges: DataFrame, named: DataFrame, excluded: DataFrame, specificity: DataFrame, n: int) -> DataFrame:
    """Nodes next to two or more distinct ``named`` (node) nodes over non-xref edges, by count times specificity."""
    kept = edges.where(~F.col("relation").startswith("xref"))
    both = kept.select(F.col("src").alias("node"), F.col("dst").alias("other")).union(kept.select("dst", "src"))
    near = both.join(named.withColumnRenamed("node", "other"), "other", "left_semi").join(excluded, "node", "left_anti")
    counted = near.groupBy("node").agg(F.count_distinct("other").alias("named")).where("named >= 2")
    scored = counted.join(specificity, "node", "left").withColumn("score", F.col("named") * F.coalesce("specificity", F.lit(0.5)))
    return scored.orderBy(F.desc("score"), "node").limit(n)
