"""Archives of delimited members as a Python data source: a partition a member, only wanted columns kept, bad members reported.

Zip archives are planned from their directory and plain tar archives from their headers. A compressed tar can only be read
from its start, so it is one partition whose members are streamed.
"""

from __future__ import annotations

import csv
import fnmatch
import gzip
import io
import tarfile
import uuid
import zipfile
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import types as T

from .snapshot import file_system

MEMBER, ERROR = "_member", "_error"


def archives(system: fs.FileSystem, root: str) -> list[str]:
    """The archive files of a folder, or the file itself."""
    info = system.get_file_info(root)
    listed = [info] if info.is_file else system.get_file_info(fs.FileSelector(root, recursive=True))
    return sorted(i.path for i in listed if i.is_file and i.path.endswith((".zip", ".tar", ".tar.gz", ".tgz")))


def members(system: fs.FileSystem, path: str) -> list[str] | None:
    """Names of an archive's members; None if they can only be met by reading it from its start."""
    if path.endswith(".zip"):
        with system.open_input_file(path) as file, zipfile.ZipFile(directory(file)) as z:
            return [i.filename for i in z.infolist() if not i.is_dir()]
    if path.endswith(".tar"):
        with system.open_input_file(path) as file, tarfile.open(fileobj=file, mode="r:") as t:
            return [m.name for m in t if m.isfile()]
    return None


def directory(file: pa.NativeFile):
    """A file in which the end record of a zip archive can be sought; Arrow's files refuse places before their beginning."""
    return io.BytesIO(file.read()) if file.size() < 1 << 17 else file


class Forward(io.RawIOBase):
    """A stream that is only read on, which members of compressed tar archives are."""

    def __init__(self, stream):
        self.stream = stream

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        data = self.stream.read(len(buffer))
        buffer[: len(data)] = data
        return len(data)


def opened(system: fs.FileSystem, path: str, member: str | None, pattern: str) -> Iterator[tuple[str, io.BufferedIOBase]]:
    """(name, stream) of the member, or of all members of a compressed tar that the pattern fits."""
    if path.endswith(".zip"):
        with system.open_input_file(path) as file, zipfile.ZipFile(directory(file)) as z, z.open(member) as stream:
            yield member, stream
    elif member is not None:
        with system.open_input_file(path) as file, tarfile.open(fileobj=file, mode="r:") as t:
            yield member, t.extractfile(member)
    else:
        with system.open_input_stream(path, compression=None) as file, tarfile.open(fileobj=file, mode="r|gz") as t:
            for m in t:
                if m.isfile() and fnmatch.fnmatch(m.name, pattern):
                    yield m.name, t.extractfile(m)


class ArchiveReader(D.DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType):
        self.path, self.pattern, self.delimiter = options["path"], options.get("members", "*"), options.get("delimiter", "\t")
        self.schema = schema

    def partitions(self) -> Sequence[D.InputPartition]:
        system, root = file_system(self.path)
        found = []
        for path in archives(system, root):
            try:
                names = members(system, path)
            except (OSError, ValueError, zipfile.BadZipFile, tarfile.TarError) as e:
                found.append((path, None, f"{type(e).__name__}: {e}"))
                continue
            found += [(path, None, None)] if names is None else [(path, n, None) for n in names if fnmatch.fnmatch(n, self.pattern)]
        return [D.InputPartition(x) for x in found] or [D.InputPartition(None)]

    def read(self, partition: D.InputPartition) -> Iterator[tuple]:
        if partition.value is None:
            return
        path, member, error = partition.value
        name = member or path.rsplit("/", 1)[-1]
        if error:
            yield self._row(name, {}, error)
            return
        try:
            for name, stream in opened(file_system(self.path)[0], path, member, self.pattern):
                plain = io.BufferedReader(Forward(gzip.open(stream) if name.endswith(".gz") else stream), 1 << 16)
                lines = csv.reader(io.TextIOWrapper(plain, "utf-8", newline=""), delimiter=self.delimiter)
                head = next(lines, [])
                at = {c: i for i, c in enumerate(head)}
                wanted = [(f.name, at[f.name]) for f in self.schema if f.name in at]
                for number, line in enumerate(lines, 2):
                    if len(line) != len(head):
                        yield self._row(name, {}, f"line {number} has {len(line)} of {len(head)} fields")
                    else:
                        yield self._row(name, {c: line[i] for c, i in wanted}, None)
        except (OSError, EOFError, ValueError, csv.Error, zipfile.BadZipFile, tarfile.TarError) as e:
            yield self._row(name, {}, f"{type(e).__name__}: {e}")

    def _row(self, member: str, values: dict, error: str | None) -> tuple:
        return tuple(member if f.name == MEMBER else error if f.name == ERROR else values.get(f.name) or None for f in self.schema)


class ArchiveWriter(D.DataSourceArrowWriter):
    """One archive a task, with members of up to ``memberRows`` rows; abandoned attempts leave files of names that no commit keeps."""

    def __init__(self, options: dict, schema: T.StructType):
        self.path, self.kind, self.rows, self.names, self.job = options["path"], options.get("kind", "zip"), int(options.get("memberRows", 10_000)), schema.names, uuid.uuid4().hex[:12]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> D.WriterCommitMessage:
        system, root = file_system(self.path)
        system.create_dir(root, recursive=True)
        part = TaskContext.get().partitionId()
        name = f"{self.job}-{part:05d}-{uuid.uuid4().hex[:8]}.{self.kind}"
        with system.open_output_stream(f"{root}/{name}", compression=None) as out:
            archive = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) if self.kind == "zip" else tarfile.open(fileobj=out, mode="w|gz" if self.kind == "tar.gz" else "w|")
            with archive:
                held, made = [], 0
                for batch in iterator:
                    held += batch.to_pylist()
                    while len(held) >= self.rows:
                        self._add(archive, f"{part:05d}-{made:03d}.tsv", held[: self.rows])
                        held, made = held[self.rows :], made + 1
                if held:
                    self._add(archive, f"{part:05d}-{made:03d}.tsv", held)
        return Kept(name)

    def _add(self, archive, name: str, rows: list[dict]) -> None:
        text = io.StringIO(newline="")
        table = csv.writer(text, delimiter="\t", lineterminator="\n")
        table.writerow(self.names)
        table.writerows(["" if r[n] is None else r[n] for n in self.names] for r in rows)
        data = text.getvalue().encode()
        if isinstance(archive, zipfile.ZipFile):
            archive.writestr(name, data)
        else:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            archive.addfile(info, io.BytesIO(data))

    def commit(self, messages: list) -> None:
        self._drop({m.name for m in messages if m})

    def abort(self, messages: list) -> None:
        self._drop(set())

    def _drop(self, keep: set[str]) -> None:
        system, root = file_system(self.path)
        for info in system.get_file_info(fs.FileSelector(root, allow_not_found=True)):
            if info.base_name.startswith(self.job) and info.base_name not in keep:
                system.delete_file(info.path)


class Kept(D.WriterCommitMessage):
    def __init__(self, name: str):
        self.name = name


class ArchiveSource(D.DataSource):
    @classmethod
    def name(cls) -> str:
        return "archive"

    def reader(self, schema: T.StructType) -> ArchiveReader:
        return ArchiveReader(dict(self.options), schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(dict(self.options), schema)


def write_archives(df: DataFrame, path: str, kind: str = "zip", member_rows: int = 10_000) -> None:
    """``df`` (strings) as zip, tar or tar.gz archives of tab-separated members, one archive a partition."""
    df.sparkSession.dataSource.register(ArchiveSource)
    df.write.format("archive").mode("append").options(kind=kind, memberRows=str(member_rows)).save(path)


def read_archives(spark: SparkSession, path: str, columns: Sequence[str], pattern: str = "*", delimiter: str = "\t") -> DataFrame:
    """(columns, _member, _error) as strings; empty fields are null.

    A line with another number of fields than its header, and a member or archive that can't be read on, is a row with
    ``_error`` and no values; what was read before it stays. Columns that a member lacks are null.
    """
    spark.dataSource.register(ArchiveSource)
    schema = ", ".join(f"`{c}` string" for c in (*columns, MEMBER, ERROR))
    return spark.read.format("archive").schema(schema).options(members=pattern, delimiter=delimiter).load(path)
