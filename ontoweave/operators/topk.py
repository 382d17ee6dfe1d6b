"""Ranked selections within groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column | str], n: int, rank: str = "rn") -> DataFrame:
    """The first ``n`` rows of each group; Spark limits each task's rows before the shuffle (WindowGroupLimit)."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(rank) <= n)


def best_per_key(df: DataFrame, key: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """One row for each key: the first by ``order``."""
    return top_per_group(df, key, order, 1, "_nth").drop("_nth")


def round_robin(df: DataFrame, group: str, within: Sequence[Column | str], limit: int, distinct: Sequence[str] = ()) -> DataFrame:
    """The first of every group, then the second of every group, ...; a repeated ``distinct`` key keeps its first turn.

    Adds ``turn`` (place within its group) and ``place`` (from 1, in the interleaved order).
    """
    rows = df.withColumn("turn", F.row_number().over(Window.partitionBy(group).orderBy(*within)))
    if distinct:
        rows = best_per_key(rows, distinct, ["turn", group])
    # No group gives more than ``limit`` rows to the result, so the final order is over few rows.
    rows = rows.where(F.col("turn") <= limit).orderBy("turn", group).limit(limit)
    return rows.withColumn("place", F.row_number().over(Window.orderBy("turn", group)))


def rank_of_truth(ranking: DataFrame, truth: DataFrame, case: str, item: str) -> DataFrame:
    """For each case of ``truth`` (case, item) the best ``rank`` of ranking (case, item, rank), null if not found."""
    found = ranking.join(truth, [case, item]).groupBy(case).agg(F.min("rank").alias("rank"))
    return truth.select(case).distinct().join(found, case, "left")
