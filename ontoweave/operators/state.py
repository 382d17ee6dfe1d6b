"""State over ordered events, in batch form."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .topk import best_per_key


def fixed_window_counter(events: DataFrame, window: int, most: int) -> DataFrame:
    """(key, at, id, hits, allowed): a window opens at a key's first hit and restarts with the first hit at or after its end.

    ``events``: (key, at, id) with whole seconds; events of a null key form one key. Where a window starts depends on the
    one before, so events are sorted by key and time and stream through their tasks; between batches a task holds one key, one
    start and one count, so a key of any size takes no more memory than others.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, reset, n = object(), 0, 0
        for batch in batches:
            hits = []
            for key, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if key != last or reset <= at:
                    last, reset, n = key, at + window, 0
                n += 1
                hits.append(n)
            hits = pa.array(hits, pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, hits, pc.less_equal(hits, most)], names=["key", "at", "id", "hits", "allowed"])

    rows = events.select(*(F.col(c).cast("long").alias(c) for c in ("key", "at", "id"))).where("at is not null")
    return rows.repartition("key").sortWithinPartitions("key", "at", "id").mapInArrow(fold, "key long, at long, id long, hits long, allowed boolean")


def upsert(feed: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last version of each key of a feed with a boolean ``deleted``; keys whose last version is a deletion go."""
    return best_per_key(feed, [key], [F.desc(c) for c in order]).where("not deleted")


def live_entries(events: DataFrame, ttl: int, capacity: int) -> DataFrame:
    """(key, at): of a cache that keeps keys for ``ttl`` seconds and at most ``capacity``, what is left after all events (key, at)."""
    last = events.groupBy("key").agg(F.max("at").alias("at"))
    now = events.agg(F.max("at").alias("now")).first()["now"]
    return last.where(F.col("at") > (now or 0) - ttl).orderBy(F.desc("at"), "key").limit(capacity)


def delta_fold(events: DataFrame) -> DataFrame:
    """(stream, text, complete): events (stream, ord, kind, text); 'append' adds text, 'reset' clears it, 'complete' ends the stream."""
    w = Window.partitionBy("stream").orderBy("ord").rowsBetween(0, Window.unboundedFollowing)
    later = events.withColumn("cleared", F.max((F.col("kind") == "reset").cast("int")).over(w))
    parts = F.array_sort(F.collect_list(F.when((F.col("kind") == "append") & (F.col("cleared") == 0), F.struct("ord", "text"))))
    folded = later.groupBy("stream").agg(parts.alias("parts"), F.max((F.col("kind") == "complete").cast("int")).alias("complete"))
    return folded.select("stream", F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("text"), (F.col("complete") == 1).alias("complete"))


def stage_states(events: DataFrame) -> DataFrame:
    """(job, stage, state, attempts) after a restart, of events (job, stage, ord, kind): queued, running, done or failed.

    A stage once done stays so, as a resumed job skips it; one that was running when all ended has failed; else its last kind
    counts. Events of a null kind count for nothing.
    """
    last = F.max_by("kind", "ord")
    state = F.when(F.max(F.col("kind") == "done"), "done").when(last == "running", "failed").otherwise(last)
    return events.where("kind is not null").groupBy("job", "stage").agg(state.alias("state"), F.count_if(F.col("kind") == "running").alias("attempts"))
