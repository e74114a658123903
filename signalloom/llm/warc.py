"""Legacy web archives (ARC, versions 1 and 2) to WARC, and WARC back to rows.

An ARC file begins with a `filedesc` record, whose block states the version and the names of a header line's fields;
each record is such a line, a block of the length that its last field declares, and a line feed. `convert` reads
header lines by the file's version and blocks by their declared lengths, and writes one WARC record for each ARC record:

- identifier: a UUID from SHA-1 of the archive's name and the record's offset, so a repeated run gives the same;
- timestamp: the archive date (8 to 14 digits, missing ones filled up), or 1970 where it is none;
- type: filedesc becomes warcinfo, a block that begins with an HTTP status line response, any other resource;
- digests: SHA-1 of the payload, which is what follows the HTTP header.

Of responses with equal payloads of `least` bytes or more the one of the highest rank stays, the others become revisit
records, which keep the HTTP header only and refer to it by identifier, URI and date. The rank is a whole number
in an HTTP header field (RANK here); records without it come last, equal ones in the order of their identifiers.

Files are written by Spark's text writer, one row a file, so its commit protocol holds and nothing but Spark touches
the file system; a file ends after the record that passes FILE_BYTES. Two passes read the ARC files: the first
gives digests, the second writes. Decisions meet their archive by its name; digests and identifiers that many records
share are joined by broadcast (`skew.lookup`), so no group of copies lands in one task.

Edge cases: a null page id is ranked last and comes back as null; a null URL becomes `urn:none`, white space and control
characters in one are percent-encoded; null html is an empty payload; a header line that can't be parsed is passed over
up to the next one that can; a block cut off by the end of its file is kept and marked as truncated; repeated rows are
records of their own, of which one stays a response; an empty table gives an empty archive and no rows; other
columns of the table are not archived.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, map_batches, release_memory, remove_folder, shared_folder, table, truncate_lineage
from .skew import lookup

FILE_BYTES = 32 << 20
#: Of the files' gzip: on pages a fifth of the usual level's time for an eighth more bytes.
LEVEL = "BEST_SPEED"
LEAST = 1000
RANK = "X-Page-Id"
NO_URL = "urn:none"
#: The date of pages, which have none.
STAMP = "20000101000000"
#: The fields of both versions' header lines, and the profile of revisit records.
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: URL and type may hold blanks in old archives, so lines are read from the date outwards.
LINES = {
    1: re.compile(rb"(.*) (\S+) (\d{8,14}) (.*) (\d+)"),
    2: re.compile(rb"(.*) (\S+) (\d{8,14}) (.*) (\S+) (\S+) (\S+) (\S+) (\S+) (\d+)"),
}


@dataclass
class Record:
    offset: int
    url: str
    ip: str
    date: str  # ISO 8601
    mime: str
    block: bytes
    whole: bool


def iso_date(digits: str) -> str:
    """WARC-Date of an ARC date; missing parts are the earliest, an impossible one 1970."""
    d = digits + "00000101000000"[len(digits) :]
    y, mo, day, h, mi, s = d[:4], d[4:6], d[6:8], d[8:10], d[10:12], d[12:14]
    sound = "01" <= mo <= "12" and "01" <= day <= "31" and h <= "23" and mi <= "59" and s <= "59"
    return f"{y}-{mo}-{day}T{h}:{mi}:{s}Z" if sound else "1970-01-01T00:00:00Z"


def opened(data: bytes) -> io.BufferedIOBase:
    """The bytes of an archive, unpacked while they are read; any number of gzip members."""
    return gzip.GzipFile(fileobj=io.BytesIO(data)) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)


def arc_records(data: bytes) -> Iterator[Record]:
    """All records of an ARC file, the filedesc first; offsets count unpacked bytes."""
    f, version = opened(data), 1
    at = f.tell()
    while line := f.readline():
        head, bare = None, line.rstrip(b"\r\n")
        if bare:  # a file's own record has its version's line, or the old one
            head = LINES[version].fullmatch(bare) or (LINES[2].fullmatch(bare) if bare.startswith(b"filedesc:") else None)
            if head and bare.startswith(b"filedesc:"):
                head = LINES[2].fullmatch(bare) or head
        if head:
            n = int(head[head.lastindex])
            block = f.read(n)
            url, ip, date, mime = (head[i].decode("utf-8", "replace") for i in range(1, 5))
            if url.startswith("filedesc:"):
                first = block.split(b"\n", 1)[0].split()
                version = 2 if first[:1] == [b"2"] else 1
            yield Record(at, url, ip, iso_date(date), mime, block, len(block) == n)
        at = f.tell()


def split_http(block: bytes) -> tuple[bytes, bytes] | None:
    """HTTP header with its blank line, and the payload; None for a block that is no HTTP response."""
    if not block.startswith(b"HTTP/"):
        return None
    ends = [(block.find(sep), len(sep)) for sep in (b"\r\n\r\n", b"\n\n")]
    ends = [(i, k) for i, k in ends if i >= 0]
    cut = min(i + k for i, k in ends) if ends else len(block)
    return block[:cut], block[cut:]


def rank_of(header: bytes, field: str) -> int | None:
    m = re.search(rb"(?im)^%s:[ \t]*(-?\d{1,19})[ \t]*\r?$" % re.escape(field.encode()), header)
    return int(m[1]) if m and -(1 << 63) <= int(m[1]) < 1 << 63 else None


def record_id(archive: str, offset: int) -> str:
    d = hashlib.sha1(f"{archive}\n{offset}".encode()).digest()[:16]
    return f"<urn:uuid:{uuid.UUID(bytes=d, version=5)}>"


def sha1_label(payload: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()


def warc_record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """One record without the two line ends behind it."""
    lines = [f"{k}: {v}" for k, v in [*fields, ("Content-Length", str(len(block)))] if v]
    return ("WARC/1.1\r\n" + "\r\n".join(lines) + "\r\n\r\n").encode() + block


def warc_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Named fields (lower-case) and block of each record of a WARC file, by the declared lengths."""
    f = opened(data)
    while line := f.readline():
        if not line.startswith(b"WARC/"):
            continue
        fields = {}
        while (line := f.readline()).strip():
            k, _, v = line.decode("utf-8", "replace").partition(":")
            fields[k.strip().lower()] = v.strip()
        yield fields, f.read(int(fields.get("content-length", "0")))


# --- files


def gathered(pieces: Iterator[bytes], opening: Callable[[int], bytes], end: bytes, most: int) -> Iterator[pa.RecordBatch]:
    """Rows of one file each: opening(number of the file), then pieces until `most` bytes are reached, with `end` between them."""
    parts: list[bytes] = []
    size = made = 0
    for p in pieces:
        if not parts:
            parts, made = [opening(made)], made + 1
        parts.append(p)
        size += len(p)
        if size >= most:
            yield pa.RecordBatch.from_arrays([pa.array([end.join(parts)], pa.binary())], names=["content"])
            parts, size = [], 0
    if parts:
        yield pa.RecordBatch.from_arrays([pa.array([end.join(parts)], pa.binary())], names=["content"])
    release_memory()


def fields_of(**types: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in types.items()])


CONTENT = fields_of(content=T.BinaryType())


def write_files(rows: DataFrame, path: str, end: str) -> None:
    """A gzip file for each row's bytes, which `end` closes; the text writer takes bytes as they are."""
    files = rows.select(F.col("content").cast("string").alias("value"))
    files.write.option("lineSep", end).option("maxRecordsPerFile", 1).option("compression", "gzip").option("zlib.compress.level", LEVEL).text(path)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(archive, content): the files under a path, each by the last part of its own."""
    bound_batches(spark)
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("archive"), "content")


# --- ARC from pages


def filedesc(version: int, number: int) -> bytes:
    body = f"{version} 0 signalloom\n{FIELDS[version]}\n".encode()
    return header_line(version, f"filedesc://{number}.arc", "text/plain", STAMP, len(body)) + body


def header_line(version: int, url: str, mime: str, date: str, length: int) -> bytes:
    more = "200 - - 0 - " if version == 2 else ""
    return f"{url} 0.0.0.0 {date} {mime} {more}{length}\n".encode("utf-8", "surrogatepass")


def write_arc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> None:
    """Pages as ARC files, of version 1 and 2 by turns; an id is the RANK field of its HTTP header."""
    src = pages.select(*[F.col(f"`{c}`").cast(t).alias(n) for c, t, n in ((id_col, "long", "i"), (url_col, "string", "u"), (body_col, "string", "b"))])
    bound_batches(pages.sparkSession)
    most = FILE_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        version = 1 + TaskContext.get().partitionId() % 2

        def opening(made: int) -> bytes:
            return filedesc(version, made)

        def records() -> Iterator[bytes]:
            nonlocal version
            size = 0
            for batch in batches:
                for i, u, b in zip(*(c.to_pylist() for c in batch.columns)):
                    body = (b or "").encode("utf-8", "surrogatepass")
                    rank = "" if i is None else f"{RANK}: {i}\r\n"
                    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{rank}Content-Length: {len(body)}\r\n\r\n".encode() + body
                    url = re.sub(r"[\s\x00-\x20\x7f]", lambda m: quote(m[0]), u or NO_URL)
                    record = header_line(version, url, "text/html", STAMP, len(block)) + block
                    size += len(record)
                    yield record
                    if size >= most:
                        version, size = 3 - version, 0

        yield from gathered(records(), opening, b"\n", most)

    write_files(src.mapInArrow(run, CONTENT), path, "\n")


# --- ARC to WARC

DIGESTS = fields_of(archive=T.StringType(), offset=T.LongType(), id=T.StringType(), uri=T.StringType(), date=T.StringType(), rank=T.LongType(), digest=T.StringType(), bytes=T.LongType())


def arc_digests(files: DataFrame, rank: str = RANK) -> DataFrame:
    """A row for each response of ARC files (archive, content): place, identifier, URI, date, rank, payload digest and size."""

    def make():
        def run(b: pa.RecordBatch) -> dict:
            out: dict[str, list] = {f.name: [] for f in DIGESTS}
            for name, data in zip(b.column(0).to_pylist(), b.column(1)):
                for r in arc_records(data.as_py()):
                    http = split_http(r.block)
                    if http is not None:
                        row = (name, r.offset, record_id(name, r.offset), r.url, r.date, rank_of(http[0], rank), sha1_label(http[1]), len(http[1]))
                        for k, v in zip(out, row):
                            out[k].append(v)
            return out

        return run

    return map_batches(files, make, DIGESTS)


def revisits(digests: DataFrame, least: int = LEAST) -> DataFrame:
    """(archive, at, refers): for each archive the offsets of its revisit records, and identifier, URI and date of what they refer to."""
    order = F.struct(F.col("rank").isNotNull().alias("a"), F.col("rank").alias("b"), F.col("id").alias("c"))
    large = digests.filter(F.col("bytes") >= least)
    first = large.groupBy("digest").agg(F.max_by(F.struct("id", "uri", "date"), order).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    met = lookup(large.select("archive", "offset", "id", "digest"), first, ["digest"]).filter(F.col("first.id") != F.col("id"))
    refers = F.concat_ws(" ", "first.id", "first.date", "first.uri")  # the URI last: it may hold blanks
    grouped = met.groupBy("archive").agg(F.array_sort(F.collect_list(F.struct(F.col("offset").alias("at"), refers.alias("refers")))).alias("x"))
    return grouped.select("archive", F.col("x.at").alias("at"), F.col("x.refers").alias("refers"))


def converted(name: str, data: bytes, refers: dict[int, str]) -> Iterator[bytes]:
    """The WARC records of one ARC file; refers: identifier, date and URI by the offsets of revisit records."""
    for r in arc_records(data):
        http = split_http(r.block)
        fields = [("WARC-Record-ID", record_id(name, r.offset)), ("WARC-Date", r.date)]
        if r.url.startswith("filedesc:"):
            yield warc_record([("WARC-Type", "warcinfo"), *fields, ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\nconverted-from: " + name.encode() + b"\r\n")
            continue
        fields += [("WARC-Target-URI", r.url), ("WARC-IP-Address", "" if r.ip == "0.0.0.0" else r.ip), ("WARC-Truncated", "" if r.whole else "unspecified")]
        if http is None:
            yield warc_record([("WARC-Type", "resource"), *fields, ("WARC-Block-Digest", sha1_label(r.block)), ("Content-Type", r.mime)], r.block)
            continue
        fields += [("WARC-Payload-Digest", sha1_label(http[1])), ("Content-Type", "application/http; msgtype=response")]
        if r.offset in refers:
            to, date, uri = refers[r.offset].split(" ", 2)
            yield warc_record([("WARC-Type", "revisit"), *fields, ("WARC-Profile", PROFILE), ("WARC-Refers-To", to), ("WARC-Refers-To-Date", date), ("WARC-Refers-To-Target-URI", uri)], http[0])
        else:
            yield warc_record([("WARC-Type", "response"), *fields, ("WARC-Block-Digest", sha1_label(r.block))], r.block)


def convert(spark: SparkSession, arc: str, warc: str, rank: str = RANK, least: int = LEAST) -> None:
    """ARC files under a path to WARC files in another: one or more for each, of FILE_BYTES and a record at most."""
    chosen = revisits(truncate_lineage(arc_digests(read_files(spark, arc), rank)), least)
    # hashed, not sorted: rows of `files` are whole archives, those of `chosen` a few bytes for each revisit
    most = FILE_BYTES
    files = read_files(spark, arc).join(chosen.hint("shuffle_hash"), "archive", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[bytes]:
            for b in batches:
                for i in range(b.num_rows):
                    name, data, at, refers = (c[i].as_py() for c in b.columns)
                    yield from converted(name, data, dict(zip(at or (), refers or ())))

        yield from gathered(records(), lambda _: warc_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", "1970-01-01T00:00:00Z"), ("Content-Type", "application/warc-fields")], b"software: signalloom\r\n"), b"\r\n\r\n", most)

    write_files(files.select("archive", "content", "at", "refers").mapInArrow(run, CONTENT), warc, "\r\n\r\n")


# --- WARC to rows

READ = fields_of(id=T.StringType(), type=T.StringType(), uri=T.StringType(), date=T.StringType(), rank=T.LongType(), payload_digest=T.StringType(), payload_bytes=T.LongType(), refers_id=T.StringType())


def read_warc(spark: SparkSession, path: str, rank: str = RANK) -> DataFrame:
    """A row for each response and revisit record under a path. Digest (lower-case hex) and size are those of the payload
    at hand, for revisits the stated digest and null."""

    def make():
        def run(b: pa.RecordBatch) -> dict:
            out: dict[str, list] = {f.name: [] for f in READ}
            for data in b.column(1):
                for fields, block in warc_records(data.as_py()):
                    kind = fields.get("warc-type")
                    if kind not in ("response", "revisit"):
                        continue
                    header, payload = split_http(block) or (b"", block)
                    if kind == "response":
                        digest, n = hashlib.sha1(payload).hexdigest(), len(payload)
                    else:
                        digest, n = base64.b32decode(fields["warc-payload-digest"].partition(":")[2]).hex(), None
                    row = (fields["warc-record-id"], kind, fields.get("warc-target-uri"), fields.get("warc-date"), rank_of(header, rank), digest, n, fields.get("warc-refers-to"))
                    for k, v in zip(out, row):
                        out[k].append(v)
            return out

        return run

    return map_batches(read_files(spark, path), make, READ)


def resolved(records: DataFrame) -> DataFrame:
    """Records of `read_warc` with refers_to, the rank of what a revisit refers to, and the payload's size from there."""
    responses = records.filter("type = 'response'").select(F.col("id").alias("refers_id"), F.col("rank").alias("refers_to"), F.col("payload_bytes").alias("__bytes"))
    out = lookup(records, responses, ["refers_id"])
    return out.withColumn("payload_bytes", F.coalesce("payload_bytes", "__bytes")).drop("__bytes")


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as ARC files, those converted to WARC, and the WARC files read back."""
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write_arc(table(spark, sf_dir, "pages"), f"{folder}/arc")
    convert(spark, f"{folder}/arc", f"{folder}/warc")
    remove_folder(spark, f"{folder}/arc")
    out = resolved(truncate_lineage(read_warc(spark, f"{folder}/warc")))
    return out.select(F.col("rank").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), "refers_to")
