"""The last-writer sink's buckets and the streamed counter's state."""

import os
import random

from pyspark.sql import functions as F

from ontoweave.operators import state
from ontoweave.streaming import windows

ROWS = "key long, ord long, value string, deleted boolean"


def folders(target):
    return {n: {b for b in os.listdir(f"{target}/{n}") if b.startswith("bucket")} for n in os.listdir(target) if n.startswith("batch")}


def test_a_batch_rewrites_its_buckets_alone(spark, tmp_path):
    target = str(tmp_path / "t")
    write = windows.last_writer(target, buckets=8)
    assert windows.read_last(spark, target) is None
    write(spark.range(200).select(F.col("id").alias("key"), F.lit(1).cast("long").alias("ord"), F.lit("a").alias("value"), F.lit(False).alias("deleted")), 0)
    assert len(folders(target)["batch=0"]) == 8
    one = spark.createDataFrame([(7, 2, "b", False)], ROWS)
    write(one, 1)
    assert len(folders(target)["batch=1"]) == 1
    read = lambda: {r.key: r.value for r in windows.read_last(spark, target).collect()}
    assert read() == {i: "b" if i == 7 else "a" for i in range(200)}
    write(one, 1)  # a batch that is repeated changes nothing
    assert read()[7] == "b" and len(read()) == 200
    write(spark.createDataFrame([(7, 3, None, True), (8, 0, "old", False), (None, 1, "n", False)], ROWS), 2)
    write(spark.createDataFrame([(7, 1, "late", False)], ROWS), 3)
    got = read()
    assert 7 not in got and got[8] == "a" and got[None] == "n" and len(got) == 200
    write(spark.createDataFrame([], ROWS), 4)
    assert read() == got
    # A batch whose state was never written does not count.
    os.makedirs(f"{target}/batch=5/bucket=0")
    assert read() == got
    write(spark.createDataFrame([(900, 1, "z", False)], ROWS), 6)
    assert "batch=5" not in folders(target) and len(read()) == 201


def test_streamed_counter_equals_the_batch_one(spark, tmp_path):
    rng = random.Random(6)
    repr_time = lambda r: (r[0], r[2])
    rows = sorted(((rng.randrange(2000), rng.choice([1, 2, 3, None]), i) for i in range(400)), key=repr_time)
    schema = "at long, key long, id long"
    for i in range(5):
        part = spark.createDataFrame(rows[80 * i : 80 * i + 80], schema).withColumn("ts", F.timestamp_seconds("at"))
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(f"{schema}, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = windows.streamed_counter(stream, 50, 3).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/log").trigger(availableNow=True).start()
    query.awaitTermination()
    want = state.fixed_window_counter(spark.createDataFrame(rows, schema), 50, 3)
    order = ["key", "at", "id", "hits", "allowed"]
    tied = lambda df: sorted((repr(tuple(r[c] for c in order)) for r in df.collect()))
    assert tied(spark.read.parquet(f"{tmp_path}/out")) == tied(want)
    # Windows of fifty seconds: the state of a key that was last seen long before the end is gone.
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 4
