"""What joins an entity to another one, and what is established in it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import noisy_or
from .lineage import parts_for, settle

# The weight of a shared or linked neighbour by its kind, and of phenotypes, each and at most.
KIND_WEIGHTS = {"gene": 0.5, "pathway": 0.8, "process": 0.6, "cell_type": 0.5, "cell": 0.5, "anatomy": 0.4}
PHENOTYPE_EACH, PHENOTYPE_MOST, PHENOTYPE_LINKED, CAUSAL_GENE = 0.15, 0.6, 0.3, 1.0
INPUT, SHARES_MECHANISM, HIERARCHY, SIBLING, TYPED_SYMPTOM = 1.0, 0.9, 0.6, 0.4, 0.7


def _kind_weight(kind: str):
    return F.coalesce(F.create_map(*(F.lit(x) for pair in KIND_WEIGHTS.items() for x in pair))[F.col(kind)], F.lit(None).cast("double"))


def bridges(inputs: DataFrame, near: DataFrame, kinds: DataFrame, symptoms: DataFrame, generic: DataFrame) -> DataFrame:
    """(input, node, basis, via, weight, shared): every way in which a node is connected to each of ``inputs`` (input).

    ``near`` (node, other, relation, causal, hierarchy, child) holds each edge from both sides. A disease is connected by sharing a
    mechanism, by being a parent or subtype, by each common gene (more if causal for both), process or the like, by its common
    phenotypes taken together, and as a sibling below a parent outside ``generic`` (node). Other nodes are connected by a direct edge.
    Nodes in ``symptoms`` (input, node) were typed by the user. Only neighbours of ``inputs`` are joined, so the work is that of
    the asked inputs; both sides are first reduced to one row a pair of neighbours.
    """
    flag = lambda name, cond: F.max(F.coalesce(cond, F.lit(False))).alias(name)
    up = F.col("hierarchy") & ~F.col("child")
    merged = lambda rows: rows.groupBy("node", "other").agg(
        flag("causal", F.col("causal")), flag("hierarchy", F.col("hierarchy")), flag("up", up), flag("shares", F.col("relation") == "shares_mechanism_with"))
    asked = settle(inputs.select("input").where("input is not null").distinct(), "asked")
    mine = settle(merged(near.where("other is not null").join(asked.toDF("node"), "node", "left_semi")).withColumnRenamed("node", "input"), "mine")
    of = lambda nodes: kinds.join(nodes, "node", "left_semi").groupBy(F.col("node").alias("k")).agg(F.min("kind").alias("kind"))
    own = settle(mine.join(of(mine.select(F.col("other").alias("node"))), F.col("other") == F.col("k")).drop("k"), "own")
    row = lambda df, basis, via, weight: df.select("input", F.col("other").alias("node"), F.lit(basis).alias("basis") if isinstance(basis, str) else basis.alias("basis"), via.alias("via"), weight.cast("double").alias("weight"), F.lit(1).cast("long").alias("shared"))
    none = F.lit(None).cast("string")
    itself = asked.select("input", F.col("input").alias("node"), F.lit("input").alias("basis"), none.alias("via"), F.lit(INPUT).alias("weight"), F.lit(1).cast("long").alias("shared"))
    typed = symptoms.join(asked, "input", "left_semi").where("node <> input").select("input", "node", F.lit("symptom").alias("basis"), none.alias("via"), F.lit(TYPED_SYMPTOM).alias("weight"), F.lit(1).cast("long").alias("shared")).distinct()
    others = own.where("other <> input")
    direct = others.where("kind = 'disease'")
    ways = [itself, typed, row(direct.where("shares"), "shares_mechanism", none, F.lit(SHARES_MECHANISM)), row(direct.where("hierarchy"), "hierarchy", none, F.lit(HIERARCHY))]
    linked = F.when((F.col("kind") == "gene") & F.col("causal"), CAUSAL_GENE).otherwise(F.coalesce(_kind_weight("kind"), F.lit(PHENOTYPE_LINKED)))
    ways.append(row(others.where("kind <> 'disease'"), F.concat(F.lit("linked "), F.col("kind")), none, linked))

    # Of all other edges those count that lead to a neighbour of an input; they are found before they are merged.
    there = settle(merged(near.where("node is not null").join(own.select("other").distinct(), "other", "left_semi")), "there")
    diseases = there.join(of(there.select("node")).where("kind = 'disease'").select(F.col("k").alias("node")), "node", "left_semi")
    met = own.select("input", F.col("other").alias("m"), "kind", F.col("causal").alias("causal_here"), F.col("up").alias("up_here")).join(
        diseases.select("node", F.col("other").alias("m"), "causal", "up"), "m").where("node <> input")
    met = met.join(generic.select(F.col("node").alias("m"), F.lit(True).alias("generic")).distinct(), "m", "left")
    weight = (
        F.when(F.col("kind") == "gene", F.when(F.col("causal") & F.col("causal_here"), CAUSAL_GENE).otherwise(KIND_WEIGHTS["gene"]))
        .when(F.col("kind") == "disease", F.when(F.col("up") & F.col("up_here") & F.col("generic").isNull(), SIBLING)).otherwise(_kind_weight("kind")))
    basis = F.when(F.col("kind") == "disease", "sibling").otherwise(F.concat(F.lit("shared "), F.col("kind")))
    ways.append(met.where("kind <> 'phenotype'").select("input", "node", basis.alias("basis"), F.col("m").alias("via"), weight.alias("weight"), F.lit(1).cast("long").alias("shared")).where("weight is not null"))
    signs = met.where("kind = 'phenotype'").groupBy("input", "node").agg(F.count("*").alias("shared"))
    ways.append(signs.select("input", "node", F.lit("shared phenotype").alias("basis"), none.alias("via"), F.least(F.lit(PHENOTYPE_MOST), PHENOTYPE_EACH * F.col("shared")).alias("weight"), "shared"))
    found = ways[0]
    for way in ways[1:]:
        found = found.unionByName(way)
    return found


def mechanisms(inputs: DataFrame, edges: DataFrame, papers: DataFrame, kinds: DataFrame, causal: DataFrame, n: int, wanted: tuple[str, ...] = ("gene", "pathway", "process", "cell_type"), name: Callable[[str], Column] = F.col) -> DataFrame:
    """(input, node, papers, confidence, place): the ``n`` best supported nodes of the ``wanted`` kinds that are established in each input.

    ``inputs`` (input, entity): an input's own entities and its models. ``edges`` (edge, src, dst, confidence, mostly_negative, solution,
    context) establish the end that is not one of these entities; a solution's edge establishes its target also if its
    ``context`` is one. ``papers`` (edge, paper) are counted once a node. ``causal`` (input, node) of the source graph count with
    confidence 1 where no edge tells. Edges that are mostly negative or without confidence establish nothing. ``name`` makes of the column
    of a node what ties are ordered by, where nodes are numbers.
    """
    good = edges.where("not coalesce(mostly_negative, false) and confidence > 0")
    of = inputs.select("input", "entity").distinct()
    at = lambda end, m, rows: rows.join(of.withColumnRenamed("entity", end), end).select("input", F.col(m).alias("node"), "edge", "confidence")
    told = at("src", "dst", good).unionByName(at("dst", "src", good)).unionByName(at("context", "dst", good.where("solution"))).where("node is not null").distinct()
    told = told.join(of.withColumnRenamed("entity", "node"), ["input", "node"], "left_anti")
    # Confidence and papers both read what is told, so it is settled.
    told = settle(told.join(kinds.where(F.col("kind").isin(*wanted)).select("node").distinct(), "node", "left_semi"), "told")
    sure = told.groupBy("input", "node").agg(noisy_or(F.col("confidence")).alias("confidence"))
    of = parts_for(told.count())
    proof = told.select("input", "node", "edge").repartition(of, "edge").join(papers.repartition(of, "edge"), "edge").groupBy("input", "node").agg(F.count_distinct("paper").alias("papers"))
    rest = causal.select("input", "node").distinct().join(kinds.where(F.col("kind").isin(*wanted)).select("node").distinct(), "node", "left_semi").join(sure, ["input", "node"], "left_anti")
    every = sure.join(proof, ["input", "node"], "left").na.fill(0, ["papers"]).unionByName(rest.select("input", "node", F.lit(1.0).alias("confidence"), F.lit(0).cast("long").alias("papers")))
    every = every.withColumn("confidence", F.round("confidence", 9))  # sums of logarithms differ in their last digits by the order of rows
    place = F.row_number().over(Window.partitionBy("input").orderBy(F.desc("papers"), F.desc("confidence"), name("node")))
    return every.withColumn("place", place).where(F.col("place") <= n).select("input", "node", "papers", "confidence", "place")
