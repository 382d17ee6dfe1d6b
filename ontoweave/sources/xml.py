"""Records of XML files: nested rows by tag, nested classifications, and files that are replayed in order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Records of one file where files are written: a file is read whole by one task.
RECORDS_PER_FILE = 50_000


def read_records(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    """The elements ``tag`` of all files under ``path`` by an explicit schema, with ``file``; attributes are columns that begin with _.

    Elements that a schema does not fit are counted out by the source's own rule: their fields are null.
    """
    return spark.read.format("xml").option("rowTag", tag).schema(schema).load(path).withColumn("file", F.col("_metadata.file_name"))


def replay(upserts: DataFrame, deletes: DataFrame, key: Sequence[str]) -> DataFrame:
    """The rows of ``upserts`` (key, file, ...) that stand after all files in the order of their names.

    ``deletes`` (key, file) take away what was written up to their file, that file included; a later file may write it again.
    Of rows that repeat a key in a file the greatest stands. The last row of a key is found by aggregation: a key written in every
    file is no group in one task.
    """
    row = F.struct("file", *[c for c in upserts.columns if c not in {"file", *key}])
    last = upserts.groupBy(*key).agg(F.max(row).alias("row"))
    gone = deletes.groupBy(*key).agg(F.max("file").alias("gone"))
    return last.join(gone, list(key), "left").where(F.col("gone").isNull() | (F.col("gone") < F.col("row.file"))).select(*key, "row.*")


def walk(df: DataFrame, nested: str, identifier: str, depth: int) -> DataFrame:
    """(ancestor, descendant, distance) of all nodes of a nested classification, each node with itself."""
    level: Column = F.array(F.struct(F.col(identifier).alias("id"), F.array(F.col(identifier)).alias("path"), F.col(nested).alias("below")))
    rows = df.select(F.inline(level))
    found = rows.select("path")
    for i in range(1, depth):
        deeper = i < depth - 1
        rows = rows.select("path", F.explode("below").alias("n")).select(F.concat("path", F.array(F.col(f"n.{identifier}"))).alias("path"), *([F.col(f"n.{nested}").alias("below")] if deeper else []))
        found = found.unionByName(rows.select("path"))
    pairs = found.select("path", F.posexplode("path").alias("at", "ancestor"))
    return pairs.select("ancestor", F.element_at("path", -1).alias("descendant"), (F.size("path") - 1 - F.col("at")).alias("distance")).groupBy("ancestor", "descendant").agg(F.min("distance").alias("distance"))
