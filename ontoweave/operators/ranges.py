"""Joins on nearness of numbers and records that win by order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def near_join(left: DataFrame, right: DataFrame, x: str, y: str, within: float) -> DataFrame:
    """Rows of ``left`` and ``right`` with |x - y| <= within, by an equi-join on bins of that width.

    Each row of ``left`` goes to its own bin and both neighbours, each row of ``right`` to its own, so every pair meets
    once and nothing is compared across bins.
    """
    own = F.floor(F.col(x) / F.lit(within))
    three = left.withColumn("_bin", F.explode(F.array(own - 1, own, own + 1)))
    one = right.withColumn("_bin", F.floor(F.col(y) / F.lit(within)))
    return three.join(one, "_bin").where(F.abs(F.col(x) - F.col(y)) <= F.lit(within)).drop("_bin")
