"""Hierarchies: transitive closure, neighbourhoods, propagated annotations and information content.

Edges are (child, parent); closures are (descendant, ancestor, depth) and include every node itself at depth 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scores import information_content
from .lineage import parts_for, settle


def closure(is_a: DataFrame, max_depth: int = 64) -> DataFrame:
    """Reflexive transitive closure with the smallest depth, by semi-naive rounds over the nodes that are parents.

    Each round joins only the pairs that the one before found, so cycles end and no round repeats work. Rounds are
    written to the shared folder. Nodes that are nobody's parent, of which there are most, take part in no round: their ancestors
    are their parents' ones, by one join, in partitions of bounded size.
    """
    edges = settle(is_a.select("child", "parent").where("child <> parent"), "edges")
    parents = settle(edges.select(F.col("parent").alias("child")).distinct(), "parents")
    upper = settle(edges.join(parents, "child", "left_semi").distinct(), "upper")
    known = fresh = settle(parents.select(F.col("child").alias("descendant"), F.col("child").alias("ancestor"), F.lit(0).alias("depth")), "closure")
    deepest = None
    for depth in range(1, max_depth + 1):
        step = fresh.join(upper.toDF("ancestor", "up"), "ancestor").select("descendant", F.col("up").alias("ancestor")).distinct()
        fresh = settle(step.join(known, ["descendant", "ancestor"], "left_anti").withColumn("depth", F.lit(depth)), "closure")
        if fresh.isEmpty():
            deepest = depth - 1
            break
        known = known.unionByName(fresh)
    if deepest is None:
        raise ValueError(f"deeper than {max_depth}")
    low = edges.join(parents, "child", "left_anti").repartition(parts_for(edges.count()), "child")
    met = low.join(known.toDF("parent", "ancestor", "above"), "parent")
    pair = lambda ancestor, depth: F.struct(F.col(ancestor).alias("ancestor"), depth.alias("depth"))
    own = F.array(pair("ancestor", F.col("above") + 1), pair("child", F.lit(0)))
    ways = met.select(F.col("child").alias("descendant"), F.inline(F.when(F.col("above") == 0, own).otherwise(F.slice(own, 1, 1))))
    leaves = settle(ways.groupBy("descendant", "ancestor").agg(F.min("depth").alias("depth")), "closure")
    if deepest + 1 >= max_depth and not leaves.where(F.col("depth") >= max_depth).isEmpty():
        raise ValueError(f"deeper than {max_depth}")
    return known.unionByName(leaves)


def reach(is_a: DataFrame, start: DataFrame, steps: int, down: bool = True) -> DataFrame:
    """(start, node, depth) within ``steps`` of each start (column node), breadth-first."""
    edges = is_a.toDF("to", "node") if down else is_a.toDF("node", "to")
    known = fresh = start.select(F.col("node").alias("start"), "node", F.lit(0).alias("depth")).distinct()
    for depth in range(1, steps + 1):
        step = fresh.join(edges, "node").select("start", F.col("to").alias("node")).distinct()
        fresh = settle(step.join(known, ["start", "node"], "left_anti").withColumn("depth", F.lit(depth)), "reach")
        known = known.unionByName(fresh)
    return known


def _carried(annotations: DataFrame, closed: DataFrame, *columns: str) -> DataFrame:
    """(entity, *columns, ancestors): a term's ancestors travel as one list with each annotation to its entity, dealt by entity in partitions of bounded size."""
    n = parts_for(max(annotations.count(), closed.count()))
    up = closed.select(F.col("descendant").alias("term"), "ancestor").repartition(n, "term").groupBy("term").agg(F.collect_list("ancestor").alias("ancestors"))
    # The lists of one of these partitions are few, so the annotations need no sort.
    near = annotations.select("entity", "term", *columns).repartition(n, "term").join(up.hint("shuffle_hash"), "term").select("entity", *columns, "ancestors")
    return near.repartition(n, "entity")


def propagate(annotations: DataFrame, closed: DataFrame) -> DataFrame:
    """(entity, term, freq): annotations (entity, term, freq) carried to all ancestors, highest frequency wins.

    Both tables are counted first, so they should be settled; lists of ancestors are only parted at their entity.
    """
    near = _carried(annotations, closed, "freq")
    return near.select("entity", F.explode("ancestors").alias("term"), "freq").groupBy("entity", "term").agg(F.max("freq").alias("freq"))


def term_weights(propagated: DataFrame) -> DataFrame:
    """(term, df, ic, specificity) over the entities of ``propagated``."""
    total = propagated.select(F.count_distinct("entity")).first()[0]
    return _weights(propagated.groupBy("term").agg(F.count("*").alias("df")), total)  # (entity, term) is unique


def annotation_weights(annotations: DataFrame, closed: DataFrame) -> DataFrame:
    """The ``term_weights`` of annotations (entity, term) carried to all ancestors, where these pairs are only counted and not written.

    Each entity is counted once more under no term, which gives their number in the same pass.
    """
    near = _carried(annotations, closed).select("entity", F.explode(F.concat("ancestors", F.array(F.lit(None)))).alias("term")).distinct()
    counted = settle(near.groupBy("term").agg(F.count("*").alias("df"), F.count("entity").alias("named")), "counted")
    total = counted.where("term is null").first()
    return _weights(counted.where("term is not null").drop("named"), total["named"] if total else 0)


def _weights(counted: DataFrame, total: int) -> DataFrame:
    ic = information_content(F.col("df"), F.lit(float(max(total, 1))))
    share = F.try_divide(F.col("ic"), F.ln(F.lit(float(total)))) if total > 1 else F.lit(0.0)
    return counted.withColumn("ic", ic).withColumn("specificity", F.coalesce(share, F.lit(0.0)))


def top_category(closed: DataFrame, tops: DataFrame) -> DataFrame:
    """(node, category): the nearest of ``tops`` (ancestor) above each node, the smaller name on ties, else 'Other'."""
    found = closed.join(tops, "ancestor").groupBy("descendant").agg(F.min(F.struct("depth", "ancestor")).alias("best"))
    nodes = closed.select("descendant").distinct()
    return nodes.join(found, "descendant", "left").select(F.col("descendant").alias("node"), F.coalesce("best.ancestor", F.lit("Other")).alias("category"))
