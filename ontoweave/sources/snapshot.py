"""Snapshots of tables as a Python data source: files with checksums, published by one manifest.

Tasks write JSON lines or SQLite databases of bounded size to names of their own. A job's commit lists its files; a snapshot
is published by replacing one small file once all tables are written, so a job that fails anywhere leaves the former
snapshot as it was. Scans plan a partition a file and check each file's SHA-256 before they parse it.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import sqlite3
import uuid
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import functions as F
from pyspark.sql import types as T

CURRENT = "CURRENT.json"


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return (fs.LocalFileSystem(), path.rstrip("/")) if path.startswith("/") else fs.FileSystem.from_uri(path)


def as_lines(rows: list[dict], names: list[str]) -> bytes:
    return gzip.compress("".join(json.dumps({n: r[n] for n in names}, ensure_ascii=False) + "\n" for r in rows).encode(), mtime=0)


def of_lines(data: bytes) -> list[dict]:
    return [json.loads(line) for line in gzip.decompress(data).decode().splitlines() if line]


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def as_sqlite(rows: list[dict], names: list[str]) -> bytes:
    """A database with the table ``rows``, built in memory and analysed."""
    with sqlite3.connect(":memory:") as db:
        db.execute(f"create table rows ({', '.join(map(quoted, names))})")
        db.executemany(f"insert into rows values ({', '.join('?' * len(names))})", [[r[n] for n in names] for r in rows])
        db.commit()
        db.execute("analyze")
        return db.serialize()


def of_sqlite(data: bytes) -> list[dict]:
    with sqlite3.connect(":memory:") as db:
        db.deserialize(data)
        found = db.execute("select * from rows")
        return [dict(zip([c[0] for c in found.description], r, strict=True)) for r in found]


FORMATS = {"jsonl.gz": (as_lines, of_lines), "sqlite": (as_sqlite, of_sqlite)}


class Written(D.WriterCommitMessage):
    def __init__(self, files: list[dict]):
        self.files = files


class SnapshotWriter(D.DataSourceArrowWriter):
    def __init__(self, options: dict, schema: T.StructType):
        self.path, self.kind, self.job = options["path"], options.get("kind", "jsonl.gz"), options["job"]
        self.rows, self.names = int(options.get("fileRows", 100_000)), schema.names

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = file_system(self.path)
        system.create_dir(root, recursive=True)
        files, held = [], []
        part, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex[:12]

        def flush(rows: list[dict]) -> None:
            data = FORMATS[self.kind][0](rows, self.names)
            name = f"{self.job}-{part:05d}-{attempt}-{len(files):03d}.{self.kind}"
            with system.open_output_stream(f"{root}/{name}", compression=None) as out:
                out.write(data)
            files.append({"name": name, "bytes": len(data), "rows": len(rows), "sha256": hashlib.sha256(data).hexdigest()})

        for batch in iterator:
            held += batch.to_pylist()
            while len(held) >= self.rows:
                flush(held[: self.rows])
                held = held[self.rows :]
        if held:
            flush(held)
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        """The job's list of files; files of attempts that are not in it go."""
        system, root = file_system(self.path)
        system.create_dir(root, recursive=True)
        files = [f for m in messages if m for f in m.files]
        replace(system, f"{root}/{self.job}.json", json.dumps(sorted(files, key=lambda f: f["name"])).encode())
        drop(system, root, self.job, {f["name"] for f in files} | {f"{self.job}.json"})

    def abort(self, messages: list[Written | None]) -> None:
        drop(*file_system(self.path), self.job, set())


def replace(system: fs.FileSystem, path: str, data: bytes) -> None:
    """``path`` with new content, by a file of another name that is moved over it."""
    fresh = f"{path}.{uuid.uuid4().hex}"
    with system.open_output_stream(fresh, compression=None) as out:
        out.write(data)
    system.move(fresh, path)


def drop(system: fs.FileSystem, root: str, job: str, but: set[str]) -> None:
    for info in system.get_file_info(fs.FileSelector(root, allow_not_found=True)):
        if info.base_name.startswith(job) and info.base_name not in but:
            system.delete_file(info.path)


class SnapshotReader(D.DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType):
        self.path, self.table, self.schema = options["path"], options["table"], schema

    def partitions(self) -> Sequence[D.InputPartition]:
        entry = manifest(self.path)["tables"][self.table]
        return [D.InputPartition((f, entry["kind"])) for f in entry["files"]] or [D.InputPartition(None)]

    def read(self, partition: D.InputPartition) -> Iterator[tuple]:
        if partition.value is None:
            return
        told, kind = partition.value
        system, root = file_system(self.path)
        data = system.open_input_stream(f"{root}/{self.table}/{told['name']}", compression=None).read()
        if hashlib.sha256(data).hexdigest() != told["sha256"]:
            raise ValueError(f"{told['name']} is not what its manifest says")
        for row in FORMATS[kind][1](data):
            yield tuple(bool(row[f.name]) if isinstance(f.dataType, T.BooleanType) and row[f.name] is not None else row[f.name] for f in self.schema.fields)


class SnapshotSource(D.DataSource):
    """``snapshot``: reads ``table`` of the published snapshot at ``path``; its schema is the manifest's or one with fewer columns."""

    @classmethod
    def name(cls) -> str:
        return "snapshot"

    def schema(self) -> T.StructType:
        return T.StructType.fromJson(manifest(self.options["path"])["tables"][self.options["table"]]["schema"])

    def reader(self, schema: T.StructType) -> SnapshotReader:
        return SnapshotReader(dict(self.options), schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> SnapshotWriter:
        return SnapshotWriter(dict(self.options), schema)


def manifest(path: str) -> dict:
    """The published snapshot: its version, and for each table kind, schema, files and rows."""
    system, root = file_system(path)
    return json.loads(system.open_input_stream(f"{root}/{CURRENT}", compression=None).read())


def write_snapshot(spark: SparkSession, path: str, tables: Mapping[str, DataFrame], kinds: Mapping[str, str] | None = None, rows_per_file: int = 100_000) -> dict:
    """Writes the tables and publishes them together; returns the manifest.

    Columns are strings, whole numbers, doubles and booleans. ``kinds`` says jsonl.gz, the default, or sqlite by table. The
    version is the hash of the files' checksums. Files of the former snapshot stay for its readers; ``prune`` drops them.
    """
    spark.dataSource.register(SnapshotSource)
    system, root = file_system(path)
    told = {}
    for name, df in tables.items():
        job, kind = uuid.uuid4().hex, (kinds or {}).get(name, "jsonl.gz")
        df.write.format("snapshot").mode("append").options(kind=kind, job=job, fileRows=str(rows_per_file)).save(f"{path.rstrip('/')}/{name}")
        files = json.loads(system.open_input_stream(f"{root}/{name}/{job}.json", compression=None).read())
        told[name] = {"kind": kind, "schema": df.schema.jsonValue(), "rows": sum(f["rows"] for f in files), "files": files, "job": job}
    version = hashlib.sha256("\n".join(sorted(f["sha256"] for t in told.values() for f in t["files"])).encode()).hexdigest()[:16]
    published = {"version": version, "tables": told}
    replace(system, f"{root}/{CURRENT}", json.dumps(published).encode())
    return published


def read_snapshot(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A table of the snapshot that is published when the scan is planned."""
    spark.dataSource.register(SnapshotSource)
    return spark.read.format("snapshot").option("table", table).load(path)


def prune(path: str) -> int:
    """Drops what no published table names; returns the number of files dropped."""
    system, root = file_system(path)
    dropped = 0
    for name, t in manifest(path)["tables"].items():
        keep = {f["name"] for f in t["files"]} | {f"{t['job']}.json"}
        for info in system.get_file_info(fs.FileSelector(f"{root}/{name}")):
            if info.base_name not in keep:
                system.delete_file(info.path)
                dropped += 1
    return dropped


def row_digest(df: DataFrame) -> DataFrame:
    """(rows, digest): a sum over rows that does not depend on their order; null is written as N with a backslash."""
    text = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in sorted(df.columns)))
    number = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("decimal(20,0)")
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(number), F.lit(0)).cast("string").alias("digest"))
