"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ..operators.lineage import settle, shared_dir

__all__ = ["by_bytes", "materialise", "semi_join_checked", "shared_dir", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialise(df: DataFrame, name: str, batch_bytes: int = 8 << 20) -> DataFrame:
    """``df`` written once to the shared folder and read back. Python operators in it get Arrow batches of about ``batch_bytes``,
    by a setting that holds for this write alone; Spark's default of 64 MB makes two tasks of an executor hold much more."""
    conf, name_of = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    before = conf.get(name_of)
    conf.set(name_of, str(batch_bytes))
    try:
        return settle(df, name)
    finally:
        conf.set(name_of, before)


def semi_join_checked(big: DataFrame, small: DataFrame, key: str, max_rows: int = 1_000_000) -> DataFrame:
    """Rows of ``big`` whose key is in ``small``.

    ``small`` is broadcast only when a count shows at most ``max_rows`` keys; beyond that both sides are shuffled.
    """
    keys = small.select(key).where(small[key].isNotNull()).distinct()
    if keys.count() <= max_rows:
        keys = keys.hint("broadcast")
    else:
        keys = keys.hint("merge")
    return big.join(keys, key, "left_semi")


def by_bytes(batches: Iterator[pa.RecordBatch], column: int, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in pieces that end once the texts of a column come to ``most_bytes``.

    Spark itself bounds the bytes of the batches that it sends (spark.sql.execution.arrow.maxBytesPerBatch); this bounds
    what a Python operator makes of them at once.
    """
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        before = np.cumsum(lengths) - lengths
        starts = np.flatnonzero(np.diff(before // most_bytes, prepend=-1)) if batch.num_rows else [0]
        for a, b in zip(starts, [*starts[1:], batch.num_rows], strict=True):
            yield batch.slice(a, b - a)
