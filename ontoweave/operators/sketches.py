"""States of sketches by period, stored once and merged over any range of periods."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sketch_states(events: DataFrame, period: str, item: str, value: str, log_size: int = 14) -> DataFrame:
    """(period, items, quantiles, rows): for each period a HyperLogLog state of ``item`` and a KLL state of the double ``value``.

    Nulls are in neither. States have a size that does not depend on the rows, so a period may hold any number of them.
    """
    return events.groupBy(F.col(period).alias("period")).agg(
        F.hll_sketch_agg(F.col(item), log_size).alias("items"), F.expr(f"kll_sketch_agg_double(cast(`{value}` as double), 400)").alias("quantiles"), F.count("*").alias("rows"))


def merged_states(states: DataFrame, ranges: DataFrame) -> DataFrame:
    """(range_id, distinct, median, rows) over the states of each of ranges (range_id, first, last), both included.

    Ranges are taken apart into their periods, so states meet them by an equality.
    """
    days = ranges.select("range_id", F.explode(F.sequence("first", "last")).alias("period"))
    met = states.join(days, "period").groupBy("range_id").agg(F.hll_union_agg("items").alias("items"), F.expr("kll_merge_agg_double(quantiles)").alias("quantiles"), F.sum("rows").alias("rows"))
    return met.select("range_id", F.hll_sketch_estimate("items").alias("distinct"), F.expr("kll_sketch_get_quantile_double(quantiles, 0.5d)").alias("median"), "rows")
