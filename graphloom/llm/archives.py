"""Legacy ARC archives converted to WARC.

An ARC file begins with a version block that names the fields of its header lines (version 1: URL, IP-address, Archive-date, Content-type,
Archive-length; version 2 adds Result-code, Checksum, Location, Offset and Filename before the length). Each record is a
header line with those fields and as many bytes as it declares. The converter reads records one by one, gives each the identifiers that WARC
wants (record id from archive and offset, ISO time from the 14 digits, block and payload digests), and writes one WARC
for each ARC. Of records with equal payloads of at least ``REVISIT_BYTES`` that with the smallest page_id is a response, and the others
are revisits that refer to it; only digests and names are grouped for that, by partial minima, so a payload that a third of all pages
share moves no payload.

Archives lie in the folder that driver and executors share, in gzip members of one record each. Tasks write to names of their own attempt and report
them, and only reported names are read. A reader holds one record at a time.

Null html is an empty payload. A null url is written as urn:page:<page_id>, spaces in urls as %20. Pages without page_id are written and come
back with null; they sort after all others when a response is chosen. Of repeated rows one is the response and the rest revisit it. Empty tables give no rows.
Other columns are not read.
"""

from __future__ import annotations

import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm._shared import cut, new_folder, partitions, split_join
from graphloom.llm._text import as_bytes

REVISIT_BYTES = 100
ARCHIVE_BYTES = 16 << 20
CRAWL_DATE = "20240101000000"
LEVEL = 1
#: Names of the fields of a header line, by version.
FIELDS = {1: "URL IP-address Archive-date Content-type Archive-length", 2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FILES = "name string, records long"


def _member(data: bytes) -> bytes:
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class Members(io.RawIOBase):
    """The bytes of a file of gzip members, or of a plain one, with the place where each member begins."""

    def __init__(self, raw, size: int = 1 << 20):
        self.raw, self.size, self.held, self.at, self.z = raw, size, raw.read(size), 0, None
        self.plain = not self.held.startswith(b"\x1f\x8b")

    def readable(self) -> bool:
        return True

    def readinto(self, out) -> int:
        while self.held or (more := self.raw.read(self.size)):
            if not self.held:
                self.held = more
            if self.plain:
                data, self.held = self.held[: len(out)], self.held[len(out) :]
            else:
                self.z = self.z or zlib.decompressobj(31)
                data = self.z.decompress(self.held, len(out))
                if self.z.eof:
                    self.held, self.z = self.z.unused_data, None
                else:
                    self.held = self.z.unconsumed_tail
            if data:
                out[: len(data)] = data
                return len(data)
        return 0


def _open(folder: str, name: str) -> tuple[object, io.BufferedReader]:
    store, root = pyarrow.fs.FileSystem.from_uri(folder)
    raw = store.open_input_stream(f"{root}/{name}")
    return raw, io.BufferedReader(Members(raw), 1 << 18)


def _exactly(stream: io.BufferedReader, n: int) -> bytes:
    data = stream.read(n)
    if len(data) != n:
        raise ValueError(f"the archive ends {n - len(data)} bytes before the declared length")
    return data


class Writer:
    """Archives of one task, each closed at ARCHIVE_BYTES."""

    def __init__(self, folder: str, kind: str):
        (self.store, self.root), self.kind, self.number, self.out = pyarrow.fs.FileSystem.from_uri(folder), kind, 0, None
        self.store.create_dir(self.root, recursive=True)

    def open(self, stem: str = "") -> str:
        self.name = f"{stem or f'{TaskContext.get().partitionId():06d}-{self.number:06d}'}-{uuid.uuid4().hex}.{self.kind}.gz"
        self.out, self.size, self.records, self.number = self.store.open_output_stream(f"{self.root}/{self.name}"), 0, 0, self.number + 1
        return self.name

    def add(self, record: bytes) -> None:
        data = _member(record)
        self.out.write(data)
        self.size, self.records = self.size + len(data), self.records + 1

    def close(self) -> pa.RecordBatch:
        self.out.close()
        self.out = None
        return pa.RecordBatch.from_pylist([{"name": self.name, "records": self.records}], pa.schema([("name", pa.string()), ("records", pa.int64())]))


def _http(page_id: int | None, payload: bytes) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Page-Id: {'' if page_id is None else page_id}\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload


def write_arcs(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Packs pages as ARC files, of version 1 and 2 in turn. Returns their names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, version = Writer(folder, "arc"), 1
        for batch in batches:
            for name, link, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), as_bytes(batch.column(2)), strict=True):
                if not writer.out:
                    version = 1 + (writer.number + TaskContext.get().partitionId()) % 2
                    title = writer.open()
                    body = f"{version} 0 crawl\n{FIELDS[version]}\n\n".encode()
                    extra = " 200 - - 0 -" if version == 2 else ""
                    writer.add(f"filedesc://{title} 0.0.0.0 {CRAWL_DATE} text/plain{extra} {len(body)}\n".encode() + body + b"\n")
                block = _http(name, payload)
                link = (link or f"urn:page:{name}").replace(" ", "%20").replace("\n", "%0A").replace("\r", "%0D")
                extra = f" 200 {hashlib.md5(payload).hexdigest()} - {writer.size} {writer.name}" if version == 2 else ""
                writer.add(f"{link} 0.0.0.0 {CRAWL_DATE} text/html{extra} {len(block)}\n".encode() + block + b"\n")
                if writer.size >= ARCHIVE_BYTES:
                    yield writer.close()
        if writer.out:
            yield writer.close()

    rows = pages.select(pages[page_id].cast("long").alias("page_id"), pages[url].cast("string").alias("url"), pages[html].cast("string").alias("html"))
    return cut(rows.mapInArrow(run, FILES))


def arc_records(stream: io.BufferedReader) -> Iterator[dict]:
    """Header fields, by name, and block of each record after the version block; `number` counts them."""
    fields, number = FIELDS[1].split(), 0
    while line := stream.readline():
        if not line.strip():
            continue
        values = line.decode("utf-8", "replace").rstrip("\r\n").split(" ")
        if line.startswith(b"filedesc://"):
            body = _exactly(stream, int(values[-1])).decode("utf-8", "replace").split("\n")
            version = int(body[0].split(" ")[0])
            fields = body[1].split() if len(body) > 1 and body[1].strip() else FIELDS[version].split()
            continue
        if len(values) != len(fields):
            raise ValueError(f"{len(values)} fields in a header line of {len(fields)}: {line[:200]!r}")
        record = dict(zip(fields, values, strict=True))
        record["block"] = _exactly(stream, int(record["Archive-length"]))
        record["number"] = number
        number += 1
        yield record


def _parts(block: bytes) -> tuple[bytes, bytes, dict[str, str]]:
    """HTTP head, payload and headers of a block; a block without a head is all payload."""
    end = block.find(b"\r\n\r\n") if block.startswith(b"HTTP/") else -1
    head, payload = (block[: end + 4], block[end + 4 :]) if end >= 0 else (b"", block)
    lines = (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])
    return head, payload, {k.strip().lower(): v.strip() for k, _, v in lines if k}


def _number(text: str | None) -> int | None:
    return int(text) if text else None


def iso_time(digits: str) -> str:
    """2024-01-01T00:00:00Z of 14 digits; shorter ones are filled up with the least values."""
    x = digits[:14] + "00000101000000"[len(digits[:14]) :]
    return f"{x[:4]}-{x[4:6]}-{x[6:8]}T{x[8:10]}:{x[10:12]}:{x[12:14]}Z"


def record_id(arc: str, number: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{arc}#{number}')}>"


DIGESTS = "arc string, number long, page_id long, size long, digest string, url string, date string"


def _digests(arcs: DataFrame, folder: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for arc in batch.column(0).to_pylist():
                raw, stream = _open(folder, arc)
                out = []
                for r in arc_records(stream):
                    _, payload, headers = _parts(r["block"])
                    out.append((arc, r["number"], _number(headers.get("x-page-id")), len(payload), hashlib.sha256(payload).hexdigest(), r["URL"], iso_time(r["Archive-date"])))
                raw.close()
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], [x.split()[0] for x in DIGESTS.split(", ")])

    return cut(arcs.mapInArrow(run, DIGESTS))


def _warc(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [("WARC-Type", kind), *headers, ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines).encode() + b"\r\n" + block + b"\r\n\r\n"


def convert(arcs: DataFrame, arc_folder: str, warc_folder: str) -> DataFrame:
    """Writes a WARC for each ARC (name) and returns the names of the WARCs."""
    spark = arcs.sparkSession
    arcs = arcs.select("name").repartition(max(partitions(spark), 1), "name")
    seen = _digests(arcs, arc_folder)
    large = seen.where(F.col("size") >= REVISIT_BYTES)
    first = large.groupBy("digest").agg(F.count("*").alias("n"), F.min(F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", "arc", "number", "url", "date")).alias("o")).where("n > 1")
    again = split_join(large.select("arc", "number", "digest"), cut(first), ["digest"], "n").where((F.col("arc") != F.col("o.arc")) | (F.col("number") != F.col("o.number")))
    # As many rows for an archive as it has records.
    by_arc = again.groupBy(F.col("arc").alias("name")).agg(F.collect_list(F.struct("number", F.col("o.arc").alias("arc"), F.col("o.number").alias("first"), F.col("o.url").alias("url"), F.col("o.date").alias("date"))).alias("again"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = Writer(warc_folder, "warc")
        for batch in batches:
            for arc, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                known, (raw, stream) = {x["number"]: x for x in found or ()}, _open(arc_folder, arc)
                title = writer.open(arc.split(".")[0])
                info = f"software: graphloom\r\nformat: WARC File Format 1.1\r\nconvertedFrom: {arc}\r\n".encode()
                writer.add(_warc("warcinfo", [("WARC-Record-ID", record_id(arc, -1)), ("WARC-Date", iso_time(CRAWL_DATE)), ("WARC-Filename", title), ("Content-Type", "application/warc-fields")], info))
                for r in arc_records(stream):
                    head, payload, _ = _parts(r["block"])
                    headers = [("WARC-Record-ID", record_id(arc, r["number"])), ("WARC-Date", iso_time(r["Archive-date"])), ("WARC-Target-URI", r["URL"]), ("WARC-IP-Address", r["IP-address"]), ("WARC-Payload-Digest", f"sha256:{hashlib.sha256(payload).hexdigest()}"), ("Content-Type", "application/http; msgtype=response" if head else r["Content-type"])]
                    if x := known.get(r["number"]):
                        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(x["arc"], x["first"])), ("WARC-Refers-To-Target-URI", x["url"]), ("WARC-Refers-To-Date", x["date"])]
                        writer.add(_warc("revisit", headers, head or f"Content-Length: {len(payload)}\r\n\r\n".encode()))
                    else:
                        writer.add(_warc("response" if head else "resource", headers, r["block"]))
                raw.close()
                yield writer.close()

    return cut(arcs.join(by_arc, "name", "left").select("name", "again").mapInArrow(run, FILES))


RECORDS = "record_id string, page_id long, payload_bytes long, payload_digest string, record_type string, refers string, url string, date string"


def read_warcs(warcs: DataFrame, folder: str) -> DataFrame:
    """One row for each record but warcinfo; digests of responses are computed again and compared with what the archive says."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                raw, stream = _open(folder, name)
                out = []
                while line := stream.readline():
                    if not line.startswith(b"WARC/"):
                        continue
                    headers = {}
                    while line := stream.readline().strip():
                        key, _, value = line.decode("utf-8", "replace").partition(":")
                        headers[key.strip().lower()] = value.strip()
                    block = _exactly(stream, int(headers["content-length"]))
                    if headers["warc-type"] == "warcinfo":
                        continue
                    _, payload, http = _parts(block)
                    digest = headers["warc-payload-digest"].partition(":")[2]
                    if headers["warc-type"] == "revisit":
                        size = int(http.get("content-length", 0))
                    elif hashlib.sha256(payload).hexdigest() == digest:
                        size = len(payload)
                    else:
                        raise ValueError(f"{name}: digest of {headers['warc-record-id']}")
                    out.append((headers["warc-record-id"], _number(http.get("x-page-id")), size, digest, headers["warc-type"], headers.get("warc-refers-to"), headers.get("warc-target-uri"), headers["warc-date"]))
                raw.close()
                kinds = (pa.string(), pa.int64(), pa.int64(), *(pa.string(),) * 5)
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], [x.split()[0] for x in RECORDS.split(", ")])

    n = max(partitions(warcs.sparkSession), 1)
    return warcs.select("name").repartition(n, "name").mapInArrow(run, RECORDS)


def op7_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as ARC files, converted to WARC, and read back from there."""
    folder = new_folder(spark, "archives")
    arcs = write_arcs(spark.read.parquet(f"{sf_dir}/pages.parquet"), f"{folder}/arc")
    records = cut(read_warcs(convert(arcs, f"{folder}/arc", f"{folder}/warc"), f"{folder}/warc"))
    # A response is named once for all that refer to it.
    named = records.where("refers IS NULL").select(F.col("record_id").alias("refers"), F.col("page_id").alias("refers_to"))
    out = records.where("refers IS NULL").withColumn("refers_to", F.lit(None).cast("long"))
    times = records.where("refers IS NOT NULL").groupBy("refers").agg(F.count("*").alias("n"))
    again = split_join(records.where("refers IS NOT NULL"), cut(named.join(times, "refers")), ["refers"], "n").select(*out.columns)
    return out.union(again).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= {REVISIT_BYTES} AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN payload_bytes >= {REVISIT_BYTES} AND page_id <> first THEN first END AS refers_to FROM f"""
