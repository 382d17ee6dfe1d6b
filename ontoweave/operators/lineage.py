"""Cutting the lineage of iterative plans through a folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. A session on one machine that names none gets a temporary one of its own; on a cluster
    that would be a folder of the driver alone, so there it is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    app = spark.sparkContext
    if not app.master.startswith("local") or app.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if app.applicationId not in _OWN:
        _OWN[app.applicationId] = tempfile.mkdtemp(prefix="ontoweave-")
    return _OWN[app.applicationId]


def settle(df: DataFrame, name: str = "step") -> DataFrame:
    """``df`` written once to the shared folder and read back: a short plan that survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parts_for(rows: int, each: int = 250_000) -> int:
    """How many partitions hold ``rows`` with about ``each`` in one. Spark merges partitions by their compressed bytes, which says little
    of the memory that short, similar strings take, so steps that hold their rows in hash maps or sorts ask for a number."""
    return max(1, -(-rows // each))
