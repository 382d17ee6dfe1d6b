"""Sharding by jump consistent hashing (Lamping and Veach, 2014), in Spark expressions only.

A 64-bit key walks a pseudo-random sequence of jumps; the last shard number below the shard count is its shard.
No ring table is kept, and appending a shard moves rows only into the new one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

# Fixed values of the published algorithm: the multiplier 2862933555777941757 as two 32-bit halves.
_MUL_HIGH, _MUL_LOW = divmod(2862933555777941757, 1 << 32)
_MASK32 = (1 << 32) - 1


def _high(key: Column) -> Column:
    return F.shiftrightunsigned(key, 32)


def _low(key: Column) -> Column:
    return key.bitwiseAND(F.lit(_MASK32))


def _next_key(high: Column, low: Column) -> tuple[Column, Column]:
    """key * multiplier + 1 modulo 2**64 on 32-bit halves; no product exceeds 63 bits, so ANSI mode never objects."""

    def by_low(x: Column) -> tuple[Column, Column]:
        """x * _MUL_LOW for a 32-bit x, as (bits 32 and up, low 32 bits)."""
        tail = x.bitwiseAND(F.lit(0xFFFF)) * F.lit(_MUL_LOW)
        head = F.shiftrightunsigned(x, 16) * F.lit(_MUL_LOW)
        total = tail + F.shiftleft(head.bitwiseAND(F.lit(_MASK32)), 16)
        return F.shiftrightunsigned(total, 32) + F.shiftleft(F.shiftrightunsigned(head, 32), 16), _low(total)

    carry, low_product = by_low(low)
    added = low_product + F.lit(1)
    _, cross = by_low(high)
    top = carry + F.shiftrightunsigned(added, 32) + _low(low * F.lit(_MUL_HIGH)) + cross
    return _low(top), _low(added)


def jump_hash(key: Column, shards: int) -> tuple[Column, Column]:
    """Columns (shard among ``shards``, shard once one more is appended) of a long key; a null key counts as 0."""
    key = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    start = F.struct(
        _high(key).alias("high"), _low(key).alias("low"),
        F.lit(-1).cast("long").alias("at"), F.lit(0).cast("long").alias("jump"),
    )

    def walk(state: Column, _: Column) -> Column:
        high, low = _next_key(state["high"], state["low"])
        # The paper's (key >> 33) is the upper half without its lowest bit.
        share = F.lit(float(1 << 31)) / (F.shiftrightunsigned(high, 1) + F.lit(1)).cast("double")
        jump = ((state["jump"] + F.lit(1)).cast("double") * share).cast("long")
        moved = F.struct(high.alias("high"), low.alias("low"), state["jump"].alias("at"), jump.alias("jump"))
        return F.when(state["jump"] < F.lit(shards), moved).otherwise(state)

    # Each jump goes at least one shard up, so ``shards`` steps always suffice.
    end = F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, walk)
    shard = end["at"].cast("int")
    return shard, F.when(end["jump"] == F.lit(shards), F.lit(shards)).otherwise(shard).cast("int")


def shard_documents(docs: DataFrame, shards: int = 24, rows_per_slice: int = 50_000) -> DataFrame:
    """Every document with its shard and a gapless slot inside it.

    Null texts have no bytes (size 8, CRC of nothing), null ids hash as 0, repeated rows get slots of their own and
    an empty table gives no rows; other columns are ignored. A shard is numbered in hashed slices of bounded size, each
    starting where the one before ends, so that no task holds a whole shard; texts are never shuffled.
    """
    total = docs.count()
    slices = max(1, math.ceil(total / shards / rows_per_slice))
    shard, grown = jump_hash(F.col("doc_id"), shards)
    # The hash is evaluated once a row: struct() keeps both results of one walk together.
    place = F.struct(shard.alias("shard"), grown.alias("grown_shard"))
    cut = F.pmod(F.xxhash64("doc_id"), F.lit(slices)).cast("int")
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + F.lit(8)).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        place.alias("place"), cut.alias("slice"),
    ).select("doc_id", "size", "text_crc32", "place.shard", "place.grown_shard", "slice")
    counts = docs.select(shard.alias("shard"), cut.alias("slice")).groupBy("shard", "slice").count()
    upto = Window.partitionBy("shard").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "slice", F.coalesce(F.sum("count").over(upto), F.lit(0)).alias("start"))
    within = Window.partitionBy("shard", "slice").orderBy("doc_id", "text_crc32", "size")
    return (
        rows.withColumn("nth", F.row_number().over(within))
        .join(starts, ["shard", "slice"])
        .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("start") + F.col("nth") - 1).cast("long").alias("slot"), "grown_shard")
    )


def op2_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))
