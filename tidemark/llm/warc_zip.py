"""WARC records in ZIP packages: a writer, and a reader that finds and range-reads records without extraction.

A package is a ZIP file with two stored members, ``archive/data.warc.gz``, one gzip member for each WARC record, and
``indexes/index.cdxj``, a line for each record with its offset and length in the archive.  The reader parses the end
record, the ZIP64 locator and end record, the central directory with its ZIP64 extra fields and the members' local
headers, reads the index and then only the byte ranges of records, near ones together.

Files go to a folder that executors share, through pyarrow's file systems.  A task names its files after its own attempt
and they count only once the manifest, a table that Spark commits, has them; so a lost or repeated task leaves files
that nobody reads, and no record twice.

Defined cases: a null payload counts as empty; of records with equal payloads of at least ``LEAST`` bytes that with the
smallest page_id is the response and others revisit it; rows with the same page_id and payload are all responses; a null
page_id is never referred to; a null URL is empty, and control characters in URLs are escaped; an empty table gives no
packages and an empty result; columns other than page_id, url and html are not read, whatever
their names.
"""

from __future__ import annotations

import gzip
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import narrowed, new_folder, table

LEAST, PACKAGE_BYTES, RANGE_BYTES = 100, 24 << 20, 4 << 20
ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
# Fixed values of the ZIP format.
LOCAL, CENTRAL, END, END64, LOCATOR = 0x04034B50, 0x02014B50, 0x06054B50, 0x06064B50, 0x07064B50
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF
STORED, ZIP64_EXTRA, UTF8_NAME, VERSION64, DOS_DAY = 0, 1, 0x800, 45, 33


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def zip_bytes(members: list[tuple[str, bytes]], zip64: bool = True) -> list[bytes]:
    """The parts of a ZIP file with stored members; ``zip64`` writes sizes and offsets in ZIP64 fields."""
    parts, directory, at = [], [], 0
    for name, data in members:
        raw, crc = name.encode(), zlib.crc32(data)
        small = FULL32 if zip64 else len(data)
        extra = struct.pack("<HHQQ", ZIP64_EXTRA, 16, len(data), len(data)) if zip64 else b""
        head = struct.pack("<IHHHHHIIIHH", LOCAL, VERSION64, UTF8_NAME, STORED, 0, DOS_DAY, crc, small, small, len(raw), len(extra)) + raw + extra
        extra = struct.pack("<HHQQQ", ZIP64_EXTRA, 24, len(data), len(data), at) if zip64 else b""
        directory.append(struct.pack("<IHHHHHHIIIHHHHHII", CENTRAL, VERSION64, VERSION64, UTF8_NAME, STORED, 0, DOS_DAY, crc, small, small, len(raw), len(extra), 0, 0, 0, 0, FULL32 if zip64 else at) + raw + extra)
        parts += [head, data]
        at += len(head) + len(data)
    whole = b"".join(directory)
    parts.append(whole)
    n = len(members)
    if zip64:
        parts.append(struct.pack("<IQHHIIQQQQ", END64, 44, VERSION64, VERSION64, 0, 0, n, n, len(whole), at))
        parts.append(struct.pack("<IIQI", LOCATOR, 0, at + len(whole), 1))
        n, size, start = FULL16, FULL32, FULL32
    else:
        size, start = len(whole), at
    parts.append(struct.pack("<IHHHHIIH", END, 0, 0, n, n, size, start, 0))
    return parts


@dataclass
class Member:
    name: str
    method: int
    size: int
    header: int


def members(f: BinaryIO, length: int) -> list[Member]:
    """The central directory of a ZIP or ZIP64 file of ``length`` bytes; reads only its end and the directory."""

    def at(place: int, n: int) -> bytes:
        f.seek(place)
        return f.read(n)

    tail_at = max(0, length - 22 - FULL16)
    tail = at(tail_at, length - tail_at)
    end = tail.rfind(struct.pack("<I", END))
    while end >= 0 and end + 22 + struct.unpack_from("<H", tail, end + 20)[0] != len(tail):
        end = tail.rfind(struct.pack("<I", END), 0, end)
    if end < 0:
        raise ValueError("no end record: this is not a ZIP file")
    n, size, start = struct.unpack_from("<HII", tail, end + 10)
    if FULL16 == n or FULL32 in (size, start):
        magic, _, place, _ = struct.unpack("<IIQI", at(tail_at + end - 20, 20))
        if magic != LOCATOR:
            raise ValueError("the ZIP64 locator is missing")
        fields = struct.unpack("<IQHHIIQQQQ", at(place, 56))
        if fields[0] != END64:
            raise ValueError("the ZIP64 end record is missing")
        n, size, start = fields[7:10]
    raw, found, p = at(start, size), [], 0
    for _ in range(n):
        magic, *_ = struct.unpack_from("<I", raw, p)
        if magic != CENTRAL:
            raise ValueError("the central directory is broken")
        method = struct.unpack_from("<H", raw, p + 10)[0]
        packed, plain, name_n, extra_n, comment_n = struct.unpack_from("<IIHHH", raw, p + 20)
        header = struct.unpack_from("<I", raw, p + 42)[0]
        name = raw[p + 46 : p + 46 + name_n].decode()
        e, stop = p + 46 + name_n, p + 46 + name_n + extra_n
        while e + 4 <= stop:
            kind, n_bytes = struct.unpack_from("<HH", raw, e)
            if kind == ZIP64_EXTRA:
                wide = iter(struct.unpack_from(f"<{n_bytes // 8}Q", raw, e + 4))
                plain = next(wide) if plain == FULL32 else plain
                packed = next(wide) if packed == FULL32 else packed
                header = next(wide) if header == FULL32 else header
            e += 4 + n_bytes
        found.append(Member(name, method, packed, header))
        p = stop + comment_n
    return found


def data_offset(f: BinaryIO, member: Member) -> int:
    """Where a member's bytes begin; only stored members can be read in ranges."""
    if member.method != STORED:
        raise ValueError(f"{member.name} is compressed")
    f.seek(member.header)
    head = f.read(30)
    if struct.unpack_from("<I", head)[0] != LOCAL:
        raise ValueError(f"{member.name} has no local header")
    name_n, extra_n = struct.unpack_from("<HH", head, 26)
    return member.header + 30 + name_n + extra_n


_CONTROL = re.compile(r"[\x00-\x20\x7f]")


def record_bytes(page_id: int | None, url: str | None, payload: bytes | None, digest: str, n_bytes: int, refers_to: int | None) -> bytes:
    """One gzip member with a response record, or a revisit record if ``refers_to`` is given."""
    name = lambda i: f"<urn:page:{i}>"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % n_bytes
    block = http if refers_to is not None else http + (payload or b"")
    kind = "response" if refers_to is None else "revisit"
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {name(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z"]
    lines += ["WARC-Target-URI: " + _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url or ""), f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {n_bytes}"]
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {name(refers_to)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 4, mtime=0)


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers by lower-case name, and the payload behind the HTTP header."""
    raw = gzip.decompress(raw)
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("this is not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    block = rest[: int(headers["content-length"])]
    return headers, block.partition(b"\r\n\r\n")[2]


_PAGE = re.compile(r"<urn:page:(-?\d+)>")


def _page(name: str | None) -> int | None:
    found = _PAGE.fullmatch(name or "")
    return int(found[1]) if found else None


def _writer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _filesystem(folder)
        held, lines, at = [], [], 0

        def package() -> pa.RecordBatch:
            nonlocal held, lines, at
            path = f"{root}/pages-{uuid.uuid4().hex}.wacz"
            with files.open_output_stream(path) as out:
                for part in zip_bytes([(ARCHIVE, b"".join(held)), (INDEX, "".join(sorted(lines)).encode())]):
                    out.write(part)
            row = pa.RecordBatch.from_pydict({"package": [path.removeprefix(f"{root}/")], "records": [len(held)]})
            held, lines, at = [], [], 0
            return row

        for batch in batches:
            for row in batch.to_pylist():
                raw = record_bytes(row["page_id"], row["url"], row["payload"], row["digest"], row["n_bytes"], row["refers_to"])
                lines.append(f"{_CONTROL.sub('', row['url'] or '-')} 19700101000000 {json.dumps({'offset': at, 'length': len(raw), 'digest': 'sha256:' + row['digest']})}\n")
                held.append(raw)
                at += len(raw)
                if at >= PACKAGE_BYTES:
                    yield package()
        if held:
            yield package()

    return run


def write_packages(spark: SparkSession, pages: DataFrame, folder: str) -> DataFrame:
    """Writes a record for each row of ``pages`` (page_id, url, html) and returns the manifest (package, records)."""
    rows = narrowed(pages, page_id=("page_id", "long"), url=("url", "string"), html=("html", "string"))
    rows = rows.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("n_bytes", F.octet_length("payload").cast("long"))
    first = rows.where(F.col("n_bytes") >= LEAST).groupBy("digest").agg(F.count("*").alias("n"), F.min("page_id").alias("first_id")).where("n > 1 and first_id is not null").select("digest", "first_id")
    # Written before the join, so that both sides are plain exchanges and a hot payload's rows can be split among tasks.
    named = rows.join(table(spark, first, "payloads"), "digest", "left")
    refers = F.when(~F.col("first_id").eqNullSafe(F.col("page_id")), F.col("first_id"))
    named = named.withColumn("refers_to", refers).withColumn("payload", F.when(F.col("refers_to").isNull(), F.col("payload")))
    named = named.select("page_id", "url", "payload", "digest", "n_bytes", "refers_to")
    return table(spark, named.mapInArrow(_writer(folder), "package string, records long"), "manifest")


def _locate(folder: str):
    """Each package's records: absolute offsets and lengths, from its directory and index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _filesystem(folder)
        for batch in batches:
            for package in batch.column(0).to_pylist():
                with files.open_input_file(f"{root}/{package}") as f:
                    found = {m.name: m for m in members(f, f.size())}
                    start = data_offset(f, found[ARCHIVE])
                    f.seek(data_offset(f, found[INDEX]))
                    entries = [json.loads(line.split(" ", 2)[2]) for line in f.read(found[INDEX].size).decode().splitlines()]
                places = sorted((start + e["offset"], e["length"]) for e in entries)
                yield pa.RecordBatch.from_pydict({"package": [package] * len(places), "place": [p for p, _ in places], "length": [n for _, n in places]}, pa.schema([("package", pa.string()), ("place", pa.int64()), ("length", pa.int64())]))

    return run


RECORD = "page_id long, url string, record_type string, refers_to long, payload binary, payload_digest string, payload_bytes long"


def _fetch(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _filesystem(folder)
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64())])

        def parsed(raw: bytes) -> dict:
            headers, payload = parse_record(raw)
            kind = headers["warc-type"]
            return {"page_id": _page(headers["warc-record-id"]), "url": headers["warc-target-uri"], "record_type": kind, "refers_to": _page(headers.get("warc-refers-to")), "payload": payload if kind == "response" else None, "payload_digest": headers["warc-payload-digest"].removeprefix("sha256:"), "payload_bytes": int(headers["x-payload-length"])}

        for batch in batches:
            rows, i = batch.to_pylist(), 0
            while i < len(rows):
                # Records that follow each other are read as one range of bounded length.
                j, place, stop = i + 1, rows[i]["place"], rows[i]["place"] + rows[i]["length"]
                while j < len(rows) and rows[j]["package"] == rows[i]["package"] and rows[j]["place"] == stop and stop - place < RANGE_BYTES:
                    stop += rows[j]["length"]
                    j += 1
                with files.open_input_file(f"{root}/{rows[i]['package']}") as f:
                    raw = f.read_at(stop - place, place)
                out = [parsed(raw[r["place"] - place : r["place"] - place + r["length"]]) for r in rows[i:j]]
                yield pa.RecordBatch.from_pylist(out, schema)
                i = j

    return run


def read_packages(manifest: DataFrame, folder: str, tasks: int) -> DataFrame:
    """All records of the packages of a manifest; digest and length are those that the record's header names."""
    places = manifest.select("package").repartition(tasks).mapInArrow(_locate(folder), "package string, place long, length long")
    return places.mapInArrow(_fetch(folder), RECORD)


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Writes ``pages`` as packages, reads them back and gives page_id, payload_bytes, payload_digest, record_type, refers_to.

    Length and digest of responses are those of the payload as it was read."""
    folder = new_folder(spark, "packages")
    manifest = write_packages(spark, pages, folder)
    tasks = max(1, min(manifest.count(), spark.sparkContext.defaultParallelism * 64))
    records = read_packages(manifest, folder, tasks)
    return records.select(
        "page_id",
        F.coalesce(F.octet_length("payload").cast("long"), F.col("payload_bytes")).alias("payload_bytes"),
        F.coalesce(F.sha2("payload", 256), F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        "refers_to",
    )
