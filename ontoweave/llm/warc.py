"""WARC archives as a Python data source.

Writing makes one gzip member a record, each with its length in an extra field, and a manifest once all tasks are done.
Reading plans partitions from the manifest's record boundaries (files of other makers are one partition each), inflates
and parses a record's headers first, holds them against the pushed predicates, and steps over the payload of records
that fail them or when no payload is asked for.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, shared_dir, table

SCHEMA = "record_id string, record_type string, uri string, date string, refers_to string, payload_digest string, payload_bytes long, payload binary"
# Fixed values of the format.
VERSION, REVISIT_PROFILE = b"WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEADERS = {"record_id": "warc-record-id", "record_type": "warc-type", "uri": "warc-target-uri", "date": "warc-date", "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest"}
MANIFEST, EPOCH = "_manifest-", "1970-01-01T00:00:00Z"
#: A header of this writer for records whose names hold spaces or control characters.
ENCODED = "X-Header-Encoding"


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


def packed(record: bytes, level: int = 6) -> bytes:
    """A record as a gzip member whose extra field ``sl`` holds its own and the record's length."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(record) + deflate.flush()
    size = 24 + len(body) + 8
    if max(size, len(record)) < 1 << 32:
        head = struct.pack("<4BI2BH2sHII", 0x1F, 0x8B, 8, 4, 0, 0, 255, 12, b"sl", 8, size, len(record))
    else:
        head = struct.pack("<4BI2B", 0x1F, 0x8B, 8, 0, 0, 0, 255)
    return head + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def plain(value: str | None) -> bool:
    """Whether a value can stand in a header line as it is."""
    return value is None or not any(c <= " " or c == "\x7f" for c in value)


def percent_encoded(text: str) -> str:
    return "".join(c if c > " " and c not in "%\x7f" else f"%{ord(c):02X}" for c in text)


def percent_decoded(value: str) -> str:
    first, *parts = value.split("%")
    return first + "".join(chr(int(p[:2], 16)) + p[2:] for p in parts)


def record_bytes(row: dict) -> bytes:
    """A response record with its payload, or a revisit record with the response's headers alone."""
    revisit = row["record_type"] == "revisit"
    payload = b"" if revisit else row["payload"] or b""
    length = row["payload_bytes"] if row["payload_bytes"] is not None else len(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    names = [row["record_id"] or f"urn:uuid:{uuid.uuid4()}", row["uri"], row["refers_to"]]
    encoded = not all(map(plain, names))
    record_id, uri, refers_to = (percent_encoded(x) if encoded and x is not None else x for x in names)
    lines = [("WARC-Type", row["record_type"]), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", row["date"] or EPOCH), ("WARC-Target-URI", uri)]
    lines += [("WARC-Payload-Digest", None if row["payload_digest"] is None else f"sha256:{row['payload_digest']}"), (ENCODED, "percent" if encoded else None)]
    if revisit:
        lines += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", None if refers_to is None else f"<{refers_to}>")]
    lines += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(http) + len(payload)))]
    head = "".join(f"{name}: {value}\r\n" for name, value in lines if value is not None)
    return b"".join([VERSION, b"\r\n", head.encode(), b"\r\n", http, payload, b"\r\n\r\n"])


def parse_headers(block: bytes) -> dict[str, str]:
    """Names in lower case with their values; folded lines are joined."""
    found: dict[str, str] = {}
    name = None
    for line in block.split(b"\r\n")[1:]:
        text = line.decode("utf-8", "replace")
        if text[:1] in (" ", "\t") and name:
            found[name] += " " + text.strip(" \t")
        elif ":" in text:
            name, _, value = text.partition(":")
            name = name.strip().lower()
            found[name] = value.strip(" \t")
    return found


class Test(NamedTuple):
    """A predicate on a header column that a scan can decide: the class name of the filter and its value."""

    column: str
    kind: str
    value: object


def holds(test: Test, row: dict) -> bool:
    has = row.get(test.column)
    if test.kind in ("IsNull", "IsNotNull"):
        return (has is None) == (test.kind == "IsNull")
    if test.kind == "EqualNullSafe" and (has is None or test.value is None):
        return has is None and test.value is None
    if has is None:
        return False
    # Strings compare by their bytes, as Spark's do.
    a, b = (x.encode() if isinstance(x, str) else x for x in (has, test.value if test.kind != "In" else None))
    return {
        "EqualTo": lambda: a == b, "EqualNullSafe": lambda: a == b, "In": lambda: has in test.value, "StringStartsWith": lambda: a.startswith(b),
        "StringEndsWith": lambda: a.endswith(b), "StringContains": lambda: b in a, "GreaterThan": lambda: a > b, "GreaterThanOrEqual": lambda: a >= b,
        "LessThan": lambda: a < b, "LessThanOrEqual": lambda: a <= b,
    }[test.kind]()


DECIDABLE = ("EqualTo", "EqualNullSafe", "In", "IsNull", "IsNotNull", "StringStartsWith", "StringEndsWith", "StringContains", "GreaterThan", "GreaterThanOrEqual", "LessThan", "LessThanOrEqual")


class Window:
    """A file read at growing positions through one buffer; a step over more than the buffer reads nothing between."""

    def __init__(self, file, size: int, block: int = 1 << 18):
        self.file, self.size, self.block, self.at, self.held, self.fetched = file, size, block, 0, b"", 0

    def get(self, at: int, n: int) -> memoryview:
        """Up to ``n`` bytes from ``at``."""
        n = min(n, self.size - at)
        if at < self.at or at + n > self.at + len(self.held):
            self.file.seek(at)
            self.at, self.held = at, self.file.read(min(max(n, self.block), self.size - at))
            self.fetched += len(self.held)
        return memoryview(self.held)[at - self.at : at - self.at + n]


class Member:
    """The record at a position of a file, inflated only as far as it is asked for."""

    def __init__(self, window: Window, at: int, gzip: bool):
        self.window, self.start, self.at, self.gzip, self.text = window, at, at, gzip, bytearray()
        self.skip = None
        if gzip:
            head = bytes(window.get(at, 24))
            if head[:3] != b"\x1f\x8b\x08":
                raise ValueError(f"no gzip member at {at}")
            if len(head) == 24 and head[3] & 4 and head[12:14] == b"sl" and struct.unpack("<H", head[14:16])[0] == 8:
                self.skip = struct.unpack("<I", head[16:20])[0]
            self.inflate, self.fed = zlib.decompressobj(31), b""

    def more(self, n: int, feed: int = 1 << 16) -> bytes:
        """The next bytes, at most ``n``; empty at the end."""
        if not self.gzip:
            piece = bytes(self.window.get(self.at, n)) if self.at < self.window.size else b""
            self.at += len(piece)
            return piece
        while not self.inflate.eof:
            if not self.fed:
                self.fed = bytes(self.window.get(self.at, feed))
                if not self.fed:
                    raise ValueError(f"the record at {self.start} ends early")
                self.at += len(self.fed)
            piece = self.inflate.decompress(self.fed, n)
            self.fed = self.inflate.unconsumed_tail
            if piece:
                return piece
        return b""

    def upto(self, mark: bytes, begin: int) -> int:
        """Where ``mark``, sought from ``begin``, ends in ``text``; inflates until it is met."""
        seen = begin
        while (at := self.text.find(mark, max(begin, seen - len(mark)))) < 0:
            seen = len(self.text)
            piece = self.more(2048, 2048)
            if not piece:
                raise ValueError(f"no end of the headers of the record at {self.start}")
            self.text += piece
        return at + len(mark)

    def end(self, length: int) -> int:
        """The position after this record, whose text is ``length`` bytes; steps over what is not needed."""
        if not self.gzip:
            return self.start + length
        if self.skip:
            return self.start + self.skip
        while self.more(1 << 20):
            pass
        return self.at - len(self.inflate.unused_data)


class WarcReader(D.DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType):
        self.path, self.split_bytes = options["path"], int(options.get("splitBytes", 128 << 20))
        self.schema, self.tests = schema, []

    def pushFilters(self, filters: list) -> Iterator:
        for f in filters:
            kind, column = type(f).__name__, ".".join(getattr(f, "attribute", ()))
            if kind in DECIDABLE and column in {*HEADERS, "payload_bytes"}:
                self.tests.append(Test(column, kind, getattr(f, "value", None)))
            else:
                yield f

    def partitions(self) -> Sequence[D.InputPartition]:
        """Runs of whole records of about ``splitBytes``; without a manifest, whole files."""
        system, root = file_system(self.path)
        found = []
        for name, size, marks in committed_files(system, root):
            begin = 0
            for at in [*marks, size]:
                if at > begin and (at - begin >= self.split_bytes or at == size):
                    found.append(D.InputPartition((f"{root}/{name}", begin, at)))
                    begin = at
        return found or [D.InputPartition(None)]

    def read(self, partition: D.InputPartition) -> Iterator[pa.RecordBatch]:
        names = [f.name for f in self.schema.fields]
        types = pa.schema([(f.name, pa.int64() if isinstance(f.dataType, T.LongType) else pa.binary() if isinstance(f.dataType, T.BinaryType) else pa.string()) for f in self.schema.fields])
        if partition.value is None:
            return
        path, begin, end = partition.value
        held, weight = [], 0
        for row in records(file_system(self.path)[0], path, begin, end, self.tests, "payload" in names, "payload_bytes" in names or any(t.column == "payload_bytes" for t in self.tests)):
            held.append(row)
            weight += 200 + len(row.get("payload") or b"")
            if weight >= 4 << 20:
                yield pa.RecordBatch.from_pylist(held, types)
                held, weight = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, types)


def committed_files(system: fs.FileSystem, root: str) -> list[tuple[str, int, list[int]]]:
    """(name, size, record boundaries) of the files that manifests name, or of all WARC files where there is no manifest."""
    listed = {info.base_name: info for info in system.get_file_info(fs.FileSelector(root, allow_not_found=True)) if info.is_file}
    manifests = {n: json.loads(system.open_input_stream(f"{root}/{n}").read()) for n in listed if n.startswith(MANIFEST)}
    replaced = {old for m in manifests.values() for old in m["replaces"]}
    if manifests:
        return sorted((f["name"], f["bytes"], f["marks"]) for n, m in manifests.items() if n not in replaced for f in m["files"])
    return sorted((n, info.size, []) for n, info in listed.items() if n.endswith((".warc", ".warc.gz")))


def records(system: fs.FileSystem, path: str, begin: int, end: int, tests: Sequence[Test], with_payload: bool, with_length: bool) -> Iterator[dict]:
    """Rows of the records that start in [begin, end) and pass the tests."""
    with system.open_input_file(path) as file:
        window, at = Window(file, file.size()), begin
        gzip = bytes(window.get(begin, 2)) == b"\x1f\x8b"
        while at < end:
            record = Member(window, at, gzip)
            body = record.upto(b"\r\n\r\n", 0)
            if not record.text.startswith(b"WARC/"):
                raise ValueError(f"{path}: no WARC record at {at}")
            head = parse_headers(bytes(record.text[: body - 4]))
            length = int(head.get("content-length", 0))
            row = {c: head.get(h) for c, h in HEADERS.items()}
            for c in ("record_id", "refers_to"):
                row[c] = row[c] and row[c].removeprefix("<").removesuffix(">")
            if ENCODED.lower() in head:
                row |= {c: row[c] and percent_decoded(row[c]) for c in ("record_id", "refers_to", "uri")}
            row["payload_digest"] = row["payload_digest"] and row["payload_digest"].removeprefix("sha256:")
            if all(holds(t, row) for t in tests if t.column != "payload_bytes"):
                http = head.get("content-type", "").startswith("application/http")
                starts = body
                if http and (with_length or with_payload):
                    starts = record.upto(b"\r\n\r\n", body)
                    told = parse_headers(bytes(record.text[body : starts - 4])).get("content-length")
                    row["payload_bytes"] = int(told) if told else body + length - starts
                else:
                    row["payload_bytes"] = length
                if all(holds(t, row) for t in tests if t.column == "payload_bytes"):
                    if with_payload:
                        while len(record.text) < body + length:
                            piece = record.more(1 << 20)
                            if not piece:
                                raise ValueError(f"{path}: the record at {at} ends early")
                            record.text += piece
                        row["payload"] = bytes(record.text[starts : body + length])
                    yield row
            at = record.end(body + length + 4)


class Written(D.WriterCommitMessage):
    def __init__(self, files: list[dict]):
        self.files = files


class WarcWriter(D.DataSourceArrowWriter):
    """Files of up to ``fileBytes``, named after the job, the partition and the attempt; only a commit's manifest makes them count."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite, self.job = options["path"], overwrite, uuid.uuid4().hex
        self.file_bytes, self.mark_bytes = int(options.get("fileBytes", 1 << 30)), int(options.get("markBytes", 16 << 20))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = file_system(self.path)
        system.create_dir(root, recursive=True)
        files, out = [], None
        part, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex[:12]
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None or files[-1]["bytes"] >= self.file_bytes:
                    if out:
                        out.close()
                    files.append({"name": f"{self.job}-{part:05d}-{attempt}-{len(files):03d}.warc.gz", "bytes": 0, "records": 0, "marks": []})
                    out = system.open_output_stream(f"{root}/{files[-1]['name']}", compression=None)
                f, member = files[-1], packed(record_bytes(row))
                if f["bytes"] - (f["marks"][-1] if f["marks"] else 0) >= self.mark_bytes:
                    f["marks"].append(f["bytes"])
                out.write(member)
                f["bytes"], f["records"] = f["bytes"] + len(member), f["records"] + 1
        if out:
            out.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = file_system(self.path)
        system.create_dir(root, recursive=True)
        files = [f for m in messages if m for f in m.files]
        names = [i.base_name for i in system.get_file_info(fs.FileSelector(root))]
        old = [n for n in names if n.startswith(MANIFEST)] if self.overwrite else []
        with system.open_output_stream(f"{root}/.{self.job}") as out:
            out.write(json.dumps({"files": files, "replaces": old}).encode())
        system.move(f"{root}/.{self.job}", f"{root}/{MANIFEST}{self.job}.json")
        self._drop(system, root, {f["name"] for f in files})  # attempts that were lost or came second

    def abort(self, messages: list[Written | None]) -> None:
        self._drop(*file_system(self.path), set())

    def _drop(self, system: fs.FileSystem, root: str, but: set[str]) -> None:
        for info in system.get_file_info(fs.FileSelector(root, allow_not_found=True)):
            if info.base_name.startswith(self.job) and info.base_name not in but:
                system.delete_file(info.path)


class WarcSource(D.DataSource):
    """``spark.read.format("warc")`` and ``df.write.format("warc")``; options ``path``, ``splitBytes``, ``fileBytes``.

    A scan whose schema has no ``payload`` column decodes none.
    """

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: T.StructType) -> WarcReader:
        return WarcReader(dict(self.options), schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format known to the session, with predicates pushed to Python sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def write_archive(rows: DataFrame, path: str, mode: str = "append") -> None:
    """Writes (columns of SCHEMA); columns that are missing are null."""
    register(rows.sparkSession)
    given = T.StructType.fromDDL(SCHEMA)
    full = rows.select(*(F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in given))
    full.write.format("warc").mode(mode).save(path)


def read_archive(spark: SparkSession, path: str, *columns: str, **options: str) -> DataFrame:
    """The archive's records with these columns, or all."""
    register(spark)
    schema = T.StructType.fromDDL(SCHEMA)
    return spark.read.format("warc").schema(T.StructType([f for f in schema if not columns or f.name in columns])).options(**options).load(path)


def archive_records(pages: DataFrame, least_bytes: int = 100, most_broadcast: int = 100_000) -> DataFrame:
    """(page_id, columns of SCHEMA): a record for each row of pages (page_id, url, html).

    Of equal payloads of ``least_bytes`` or more the row with the smallest page_id is a response, the others are revisits
    of it; a null page_id comes last, and of rows that repeat the smallest page_id one is the response. Null html is an
    empty payload and a null url no header. Other columns of ``pages`` are left out; no rows give no records.

    First rows are found by a partial aggregation on digests. Payloads of a ten-thousandth or more of the repeated rows
    are at most ten thousand and are broadcast; so are all, if they are at most ``most_broadcast``; the rest is joined by
    digest, to which rows that are settled already are not sent.
    """
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").alias("uri"), payload.alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha2("payload", 256))
    rows = materialise(rows.withColumn("row", F.monotonically_increasing_id()), "pages")
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "row")
    firsts = rows.where(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest").agg(F.min(order).alias("first"), F.count("*").alias("copies")).where("copies > 1")
    firsts = materialise(firsts, "firsts")
    total = firsts.agg(F.count("*").alias("n"), F.sum("copies").alias("copies")).first()
    of = F.struct("first", "copies").alias("found")
    if total["n"] <= most_broadcast:
        told = rows.join(F.broadcast(firsts.select("payload_digest", of)), "payload_digest", "left")
    else:
        hot = F.col("copies") * 10_000 >= total["copies"]
        near = rows.join(F.broadcast(firsts.where(hot).select("payload_digest", of.alias("near"))), "payload_digest", "left")
        settled = F.col("near").isNotNull() | (F.col("payload_bytes") < least_bytes)
        near = near.withColumn("key", F.when(settled, F.concat(F.lit("-"), F.col("row"))).otherwise(F.col("payload_digest")))
        told = near.join(firsts.where(~hot).select(F.col("payload_digest").alias("key"), of.alias("far")).hint("merge"), "key", "left").withColumn("found", F.coalesce("near", "far"))
    revisit = F.col("found").isNotNull() & (F.col("found.first.row") != F.col("row"))
    urn = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(c.cast("string"), F.lit("null")))
    return told.select(
        "page_id", urn(F.col("page_id")).alias("record_id"), F.when(revisit, "revisit").otherwise("response").alias("record_type"), "uri", F.lit(EPOCH).alias("date"),
        F.when(revisit, urn(F.col("found.first.page_id"))).alias("refers_to"), "payload_digest", "payload_bytes", F.when(~revisit, F.col("payload")).alias("payload"),
    )


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as WARC and read back: revisits by their headers alone, responses with length and digest of the payload read."""
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archive(archive_records(table(spark, sf_dir, "pages")), path)
    number = lambda c: F.substring_index(F.col(c), ":", -1).try_cast("long")
    revisits = read_archive(spark, path, "record_id", "record_type", "refers_to", "payload_digest", "payload_bytes").where("record_type = 'revisit'")
    responses = read_archive(spark, path, "record_id", "record_type", "payload").where("record_type = 'response'")
    none = F.lit(None).cast("string").alias("refers_to")
    both = revisits.unionByName(responses.select("record_id", "record_type", none, F.sha2("payload", 256).alias("payload_digest"), F.octet_length("payload").cast("long").alias("payload_bytes")))
    return both.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))


OP11_SQL = """
with p as (select page_id, coalesce(html, '') as html from pages),
f as (select *, octet_length(encode(html))::bigint as payload_bytes, row_number() over (partition by html order by page_id nulls last) as nth,
    first_value(page_id) over (partition by html order by page_id nulls last) as first_id from p)
select page_id, payload_bytes, sha256(html) as payload_digest, case when payload_bytes >= 100 and nth > 1 then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= 100 and nth > 1 then first_id end as refers_to from f
"""
