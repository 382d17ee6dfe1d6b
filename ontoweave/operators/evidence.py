"""Confidence of edges from papers, and candidates that act on something an input is linked to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import noisy_or
from .topk import best_per_key

# Weights of evidence levels and of shared kinds.
LEVELS = {
    "clinical_trial": 0.9, "observational": 0.7, "registered_trial": 0.6, "case_report": 0.5, "animal": 0.5, "database": 0.4, "in_vitro": 0.35, "in_silico": 0.2, "review": 0.2,
}
SECONDHAND = ("review", "in_silico")
ABSTRACT = 0.7
NEGATIVE = 0.25


def level_weight(level: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for item in LEVELS.items() for x in item)), level), F.lit(0.2))


def edge_confidence(quotes: DataFrame) -> DataFrame:
    """(edge, papers, negative_papers, confidence, mostly_negative) of quotes (edge, paper, level, effect, abstract).

    Each paper counts with its heaviest quote; a negative result at second hand does not count; mixed results count half.
    """
    weight = level_weight(F.col("level")) * F.when(F.col("abstract"), F.lit(ABSTRACT)).otherwise(F.lit(1.0))
    negative = F.col("effect").isin("negative", "null")
    own = quotes.where(~(negative & F.col("level").isin(*SECONDHAND))).withColumn("weight", weight)
    papers = best_per_key(own, ["edge", "paper"], [F.desc("weight"), "effect"])
    supports = F.col("effect").isin("positive", "na", "mixed")
    used = F.when(supports, F.col("weight") * F.when(F.col("effect") == "mixed", 0.5).otherwise(1.0))
    scored = papers.groupBy("edge").agg(F.count("*").alias("papers"), F.count_if(negative).alias("negative_papers"), F.count_if(supports).alias("supporting"), noisy_or(used).alias("confidence"))
    return scored.select("edge", "papers", "negative_papers", F.round("confidence", 3).alias("confidence"), (F.col("negative_papers") > F.col("supporting")).alias("mostly_negative"))


def candidate_solutions(edges: DataFrame, bridges: DataFrame) -> DataFrame:
    """(solution, score, paths): edges (solution, target, confidence, mostly_negative) to targets with a bridge (target, weight).

    The best bridge of a target counts; mostly negative edges count a quarter; paths are combined as independent.
    """
    best = bridges.groupBy("target").agg(F.max("weight").alias("weight"))
    path = F.col("confidence") * F.col("weight") * F.when(F.col("mostly_negative"), F.lit(NEGATIVE)).otherwise(F.lit(1.0))
    return edges.join(best, "target").withColumn("path", path).groupBy("solution").agg(F.round(noisy_or(F.col("path")), 3).alias("score"), F.count("*").alias("paths"))


def gap_status(count: Column) -> Column:
    """untested, barely_tested (up to 3 papers), tested, or unknown without a count."""
    return F.when(count.isNull(), "unknown").when(count == 0, "untested").when(count <= 3, "barely_tested").otherwise("tested")
