"""Every registered query of the library: equal to its DuckDB form, or at least a stable result."""

import datetime
import math
import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from ontoweave import plans

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool) or isinstance(value, (str, bytes)):
        return value
    if isinstance(value, datetime.datetime):
        return str(value)
    if isinstance(value, (list, tuple)) or hasattr(value, "tolist"):
        return tuple(map(plain, value.tolist() if hasattr(value, "tolist") else value)) if not hasattr(value, "item") or getattr(value, "ndim", 0) else plain(value.item())
    return float(f"{float(value):.9g}")


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted((tuple(map(plain, r)) for r in frame.itertuples(index=False, name=None)), key=repr)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, duck, name):
    got = plans.QUERIES[name](spark, SMALL).toPandas()
    if name not in plans.ORACLE_SQL:
        assert len(got.columns)
        return
    want = duck.sql(plans.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_the_entry_works_without_the_llm_folders(tmp_path):
    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root, tmp_path / "copy", ignore=shutil.ignore_patterns(".git", "llm", "__pycache__"))
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), [q for q in e.queries() if q.startswith('op') or q == 'pipeline'])"
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", capture_output=True, text=True, env={**os.environ, "PYTHONPATH": ""})
    assert said.stdout.split() == [str(len(plans.QUERIES)), str(len(plans.ORACLE_SQL)), "[]"], said.stderr
