"""Structured Streaming forms of the event operators; each has a batch equivalent."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.snapshot import file_system, replace


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """A stream over a folder of Parquet files with the events' schema."""
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    return spark.readStream.schema(schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, window: str = "1 hour", slide: str | None = None, late: str = "2 hours") -> DataFrame:
    """Counts and sums by window and type; rows later than the watermark are left out of a stream."""
    return (
        events.withWatermark("ts", late).groupBy(F.window("ts", window, slide) if slide else F.window("ts", window), "event_type")
        .agg(F.count("*").alias("n"), F.sum("value").alias("total"))
        .select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", "total")
    )


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions of each user, ended by a gap."""
    return (
        events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
        .select("user_id", F.date_format("session_window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")
    )


def deduplicated(events: DataFrame, late: str = "2 hours") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


BUCKETS = 16


def last_writer(target: str, buckets: int = BUCKETS):
    """A foreachBatch writer that keeps the last version of each key (columns key, ord, value, deleted) below ``target``.

    Keys are in buckets by hash. A batch writes the buckets that its keys are in, below ``batch=n``, and then a small file that
    says in which batch's folder each bucket stands; so a few changed keys cost their buckets alone, a crash leaves the former
    state, and a repeated batch starts again from the state before it. Folders that neither this state nor the one before
    names are dropped. Deletions stay as rows with their order: a late older version can't bring a key back. read_last() shows
    the rows that are not deleted. The number of buckets of a target must not change.
    """
    from ..operators.topk import best_per_key

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.select("*", F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int").alias("bucket"))
        rows.persist()
        try:
            touched = sorted(r["bucket"] for r in rows.select("bucket").distinct().collect())  # as many as there are buckets at most
            system, root = file_system(target)
            states = _states(system, root)
            before = max((n for n in states if n < number), default=None)
            held = {} if before is None else states[before]
            paths = [f"{target}/batch={held[b]}/bucket={b}" for b in touched if b in held]
            if paths:
                rows = rows.unionByName(spark.read.schema(batch.schema).option("basePath", target).parquet(*paths).select(*batch.columns).withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int")))
            last = best_per_key(rows, ["key"], [F.desc("ord"), F.desc("deleted")])
            last.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{target}/batch={number}")
        finally:
            rows.unpersist()
        now = held | {b: number for b in touched}
        replace(system, f"{root}/state-{number}.json", json.dumps(now).encode())
        for n in [n for n in states if n < number and n != before]:
            system.delete_file(f"{root}/state-{n}.json")
        named = {*now.values(), *held.values()}
        for info in system.get_file_info(fs.FileSelector(root)):
            if info.base_name.startswith("batch=") and int(info.base_name.removeprefix("batch=")) not in named:
                system.delete_dir(info.path)

    return write


def _states(system: fs.FileSystem, root: str) -> dict[int, dict[int, int]]:
    """Of each batch that is known whole, the batch in whose folder each bucket stands."""
    names = [i.base_name for i in system.get_file_info(fs.FileSelector(root, allow_not_found=True))]
    numbers = [int(n[6:-5]) for n in names if n.startswith("state-") and n.endswith(".json")]
    read = lambda n: json.loads(system.open_input_stream(f"{root}/state-{n}.json", compression=None).read())
    return {n: {int(b): at for b, at in read(n).items()} for n in numbers}


def read_last(spark: SparkSession, target: str) -> DataFrame | None:
    """(key, ord, value, deleted) of the keys that last_writer() holds; None before the first batch with rows."""
    states = _states(*file_system(target))
    held = states[max(states)] if states else {}
    if not held:
        return None
    return spark.read.option("basePath", target).parquet(*(f"{target}/batch={n}/bucket={b}" for b, n in sorted(held.items()))).drop("batch", "bucket").where("not deleted")


def streamed_counter(events: DataFrame, window: int, most: int, late: str = "0 seconds") -> DataFrame:
    """fixed_window_counter() as a stream: (key, at, id, hits, allowed) of events (key, at, id, ts), ``at`` being whole seconds of ``ts``.

    A key's state is the end of its window and its hits. It expires once the watermark has passed that end, as the next hit then
    opens a window in any case. The events of a batch are counted in the order of time; those of later batches come after
    them, and events behind the watermark are left out.
    """

    def count(key: tuple, pieces: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        reset, n = state.get if state.exists else (0, 0)
        rows = pd.concat(pieces).sort_values(["at", "id"])  # a key's rows of one batch, which the trigger bounds
        hits = []
        for at in rows["at"].tolist():
            if reset <= at:
                reset, n = at + window, 0
            n += 1
            hits.append(n)
        if reset * 1000 > state.getCurrentWatermarkMs():
            state.update((reset, n))
            state.setTimeoutTimestamp(reset * 1000)
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"key": rows["key"], "at": rows["at"], "id": rows["id"], "hits": hits, "allowed": [h <= most for h in hits]})

    rows = events.where("at is not null").withWatermark("ts", late).select(*(F.col(c).cast("long").alias(c) for c in ("key", "at", "id")), "ts")
    return rows.groupBy("key").applyInPandasWithState(count, "key long, at long, id long, hits long, allowed boolean", "reset long, hits long", "append", "EventTimeTimeout")
