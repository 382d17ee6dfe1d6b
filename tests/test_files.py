"""Archives with bad members, replayed files and nested classifications."""

import io
import tarfile
import zipfile

import pytest

from ontoweave.sources import archives as A
from ontoweave.sources import xml as X


@pytest.mark.parametrize("kind", ["zip", "tar", "tar.gz"])
def test_archives_round_trip(spark, tmp_path, kind):
    rows = [("1", 'a\t"b"\n', None), ("2", "é", "x"), (None, "", "y")] * 4
    df = spark.createDataFrame(rows, "a string, b string, c string")
    path = f"file:{tmp_path}/{kind}"
    A.write_archives(df.coalesce(2), path, kind, member_rows=2)
    got = A.read_archives(spark, path, ["c", "b", "missing"])
    assert sorted(map(repr, [tuple(r[:3]) for r in got.collect()])) == sorted(map(repr, [(c, b or None, None) for _, b, c in rows]))
    if kind != "tar.gz":
        assert got.rdd.getNumPartitions() == got.select(A.MEMBER).distinct().count()
    A.write_archives(df.limit(0), f"{path}-none", kind)
    assert A.read_archives(spark, f"{path}-none", ["a"]).count() == 0


def test_bad_members_are_reported(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("good.tsv", "a\tb\n1\t2\n3\n5\t6\n")
        z.writestr("other.txt", "a\n9\n")
        z.writestr("bad.tsv", "a\tb\n1\t2\n" * 500)
    data = bytearray((tmp_path / "a.zip").read_bytes())
    data[data.index(b"bad.tsv") + 40] ^= 0xFF  # stored, so its checksum no longer fits
    (tmp_path / "a.zip").write_bytes(data)
    (tmp_path / "broken.zip").write_bytes(b"no archive")
    whole = io.BytesIO()
    with tarfile.open(fileobj=whole, mode="w:gz") as t:
        info = tarfile.TarInfo("x.tsv")
        body = b"a\tb\n7\t8\n" + b"".join(b"%d\t%d\n" % (i, i * i) for i in range(50_000))
        info.size = len(body)
        t.addfile(info, io.BytesIO(body))
    (tmp_path / "cut.tar.gz").write_bytes(whole.getvalue()[:-20_000])
    got = A.read_archives(spark, str(tmp_path), ["a"], "*.tsv").collect()
    by = lambda m: [(r.a, r["_error"]) for r in got if r["_member"] == m]
    assert by("good.tsv") == [("1", None), (None, "line 3 has 1 of 2 fields"), ("5", None)]
    assert by("bad.tsv")[-1][0] is None and "CRC" in by("bad.tsv")[-1][1]
    assert by("broken.zip")[0][1].startswith("BadZipFile") and not by("other.txt")
    assert by("x.tsv")[0] == ("7", None) and [r for r in got if r["_member"] in ("x.tsv", "cut.tar.gz")][-1]["_error"]


def test_replay(spark):
    ups = spark.createDataFrame([(1, "a", "old"), (1, "c", "new"), (2, "a", "x"), (3, "a", "x"), (3, "c", "again"), (4, "b", "p"), (4, "b", "q"), (None, "a", "n")], "id int, file string, v string")
    gone = spark.createDataFrame([(2, "b"), (3, "b"), (1, "b"), (4, "b"), (9, "a")], "id int, file string")
    assert {tuple(r) for r in X.replay(ups, gone, ["id"]).select("id", "v").collect()} == {(1, "new"), (3, "again"), (None, "n")}
    assert X.replay(ups.limit(0), gone, ["id"]).count() == 0


def test_walk(spark, tmp_path):
    (tmp_path / "c.xml").write_text('<all><n i="r"><n2 i="x"><n3 i="y"/><n3 i="z"/></n2><n2 i="y"/></n></all>')
    schema = "_i string, n2 array<struct<_i: string, n3: array<struct<_i: string>>>>"
    read = X.read_records(spark, str(tmp_path), "n", schema).selectExpr("_i as i", "transform(n2, a -> struct(a._i as i, transform(a.n3, b -> struct(b._i as i)) as below)) as below")
    got = {tuple(r) for r in X.walk(read, "below", "i", 3).collect()}
    assert got == {("r", "r", 0), ("x", "x", 0), ("y", "y", 0), ("z", "z", 0), ("r", "x", 1), ("r", "y", 1), ("x", "y", 1), ("x", "z", 1), ("r", "z", 2)}
