"""Snapshots: round trips, failed attempts, damaged files."""

import os

import pytest
from pyspark.sql import functions as F

from ontoweave.sources import snapshot as S


@pytest.mark.parametrize("kind", ["jsonl.gz", "sqlite"])
def test_round_trip(spark, tmp_path, kind):
    rows = [(1, "é\n\"|", 1.5, True), (None, None, None, None), (2**62, "", -0.0, False)]
    df = spark.createDataFrame(rows, 'a long, `b "x"` string, c double, d boolean')
    path = f"file:{tmp_path}/s"
    told = S.write_snapshot(spark, path, {"t": df, "none": df.limit(0)}, {"t": kind, "none": kind}, rows_per_file=2)
    assert sorted(map(repr, S.read_snapshot(spark, path, "t").collect())) == sorted(map(repr, df.collect()))
    assert S.read_snapshot(spark, path, "none").collect() == [] and told["tables"]["t"]["rows"] == 3
    assert S.row_digest(S.read_snapshot(spark, path, "t")).collect() == S.row_digest(df).collect()


def test_a_failed_attempt_leaves_the_former_snapshot(spark, tmp_path):
    path = f"{tmp_path}/s"
    good = spark.range(0, 100, 1, 4).withColumn("x", F.lit("a"))
    first = S.write_snapshot(spark, path, {"t": good, "u": good})
    bad = good.withColumn("x", F.when(F.col("id") == 99, F.raise_error(F.lit("lost"))).otherwise("b"))
    with pytest.raises(Exception, match="lost"):
        S.write_snapshot(spark, path, {"t": good.limit(5), "u": bad})
    assert S.manifest(path) == first
    assert S.read_snapshot(spark, path, "t").count() == 100 and S.read_snapshot(spark, path, "u").where("x = 'a'").count() == 100
    kept = {f["name"] for f in first["tables"]["u"]["files"]}
    assert {n for n in os.listdir(f"{path}/u") if not n.endswith(".json")} == kept  # what the failed job wrote is gone
    assert S.prune(path) == 2 and S.read_snapshot(spark, path, "t").count() == 100  # the five rows and their list
    second = S.write_snapshot(spark, path, {"t": good.limit(5), "u": good})
    assert second["version"] != first["version"] and S.read_snapshot(spark, path, "t").count() == 5


def test_damaged_files_are_reported(spark, tmp_path):
    path = f"{tmp_path}/s"
    told = S.write_snapshot(spark, path, {"t": spark.range(0, 10, 1, 1)})
    name = told["tables"]["t"]["files"][0]["name"]
    with open(f"{path}/t/{name}", "ab") as f:
        f.write(b"x")
    with pytest.raises(Exception, match="not what its manifest says"):
        S.read_snapshot(spark, path, "t").count()
