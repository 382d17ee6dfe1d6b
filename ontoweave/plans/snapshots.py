"""Snapshots written from the driver's tables, a failed attempt, and what is read back."""

from __future__ import annotations

import uuid

from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from ..operators.lineage import shared_dir
from ..sources import snapshot as S
from .registry import query, table

COLUMNS = {
    "nation": ["n_nationkey", "n_name", "n_regionkey"], "customer": ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"], "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"],
}
KINDS = {"customer": "sqlite", "part": "sqlite"}


def _digest_sql(name):
    text = " || '|' || ".join(f"coalesce({c}::varchar, '\\N')" for c in sorted(COLUMNS[name]))
    return f"select '{name}' as table_name, '{KINDS.get(name, 'jsonl.gz')}' as kind, count(*) as rows, coalesce(sum(('0x' || substr(md5({text}), 1, 15))::bigint::hugeint), 0)::varchar as digest, count(*) as listed from {name}"


@query(" union all ".join(map(_digest_sql, COLUMNS)))
def snk_02_03_05_snapshot(spark, d):
    """Rows and digests of a snapshot's tables, read back with checksums after a later attempt to replace it has failed."""
    path = f"{shared_dir(spark)}/snapshot-{uuid.uuid4().hex}"
    tables = {name: table(spark, d, name).select(*columns) for name, columns in COLUMNS.items()}
    told = S.write_snapshot(spark, path, tables, KINDS, rows_per_file=20_000)
    lost = tables["orders"].withColumn("o_orderstatus", F.when(F.col("o_orderkey") >= 0, F.raise_error(F.lit("lost"))).otherwise(F.col("o_orderstatus")))
    try:
        S.write_snapshot(spark, path, tables | {"nation": tables["nation"].limit(3), "orders": lost}, KINDS)
    except PySparkException:
        pass  # the attempt is meant to fail
    else:
        raise AssertionError("the second attempt did not fail")
    found = None
    for name in COLUMNS:
        one = S.row_digest(S.read_snapshot(spark, path, name)).select(F.lit(name).alias("table_name"), F.lit(KINDS.get(name, "jsonl.gz")).alias("kind"), "rows", "digest", F.lit(told["tables"][name]["rows"]).cast("long").alias("listed"))
        found = one if found is None else found.unionByName(one)
    return found
