"""Web archives: legacy ARC files, their conversion to WARC, and reading both.

ARC files open with a version block that names the fields of the header lines to come; every record
is one such line, as many bytes as the line declares, and a line end. The converter gives each
record what WARC asks for: an identifier that its place in the ARC file determines, an ISO time, a
type, and SHA-256 digests of block and payload. Records whose payload (of at least 100 bytes) was
captured before become revisits, which carry no payload. Files are gzip members, one per record.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom.llm.common import slices
from creditloom.llm.files import read_files, write_files
from creditloom.operators.sizing import settle

# Fixed values of the formats.
FIELDS = {1: b"URL IP-address Archive-date Content-type Archive-length",
          2: b"URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
REVISIT = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LAST_MEMBER = gzip.compress(b"", mtime=0)
CLOSING = LAST_MEMBER[-8:]

FILE_BYTES = 8 << 20
WINDOW = 16 << 10
GZIP_LEVEL = 4
LEAST_PAYLOAD = 100


def member(data: bytes) -> bytes:
    pack = zlib.compressobj(GZIP_LEVEL, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


def members(data: bytes) -> Iterator[bytes]:
    """The contents of the gzip members of a file, one after the other; empty ones are left out.

    A member is fed window by window, as what a decompressor leaves over is copied.
    """
    at, view = 0, memoryview(data)
    while at < len(data):
        unpack, parts = zlib.decompressobj(31), []
        while not unpack.eof:
            window = view[at: at + WINDOW]
            if not window:
                raise ValueError("a gzip member is cut off")
            parts.append(unpack.decompress(window))
            at += len(window) - len(unpack.unused_data)
        if out := b"".join(parts):
            yield out


# ---- ARC

def arc_url(url: str | None) -> bytes:
    """A URL without white space or control characters, as header lines need it."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "about:blank").encode()


def arc_start(version: int, name: str, date: str) -> bytes:
    block = b"%d 0 pages\n" % version + FIELDS[version] + b"\n\n"
    extra = b"" if version == 1 else b" 200 - - 0 " + name.encode()
    return b"filedesc://%s 0.0.0.0 %s text/plain%s %d\n" % (name.encode(), date.encode(), extra, len(block)) + block


def arc_record(version: int, name: str, url: bytes, date: str, block: bytes) -> bytes:
    extra = b"" if version == 1 else b" 200 - - 0 " + name.encode()
    return b"%s 0.0.0.0 %s text/html%s %d\n" % (url, date.encode(), extra, len(block)) + block + b"\n"


def write_arc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
              date: str = "20000101000000", file_bytes: int = FILE_BYTES) -> None:
    """Pages as HTTP responses in ARC files, even ids in version 1, others in version 2."""

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        held: dict[int, list[bytes]] = {1: [], 2: []}
        size = {1: 0, 2: 0}

        def close(v: int):
            data = b"".join([*held[v], LAST_MEMBER[: -len(CLOSING)]])
            held[v], size[v] = [], 0
            return pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], ["file"])

        for piece in slices(batches):
            for i, url, html in zip(*(piece.column(c).to_pylist() for c in ("_id", "_url", "_text"))):
                v, body = 1 if i is not None and i % 2 == 0 else 2, (html or "").encode()
                name = f"pages-{part}-{number}-v{v}.arc"
                if not held[v]:
                    held[v].append(member(arc_start(v, name, date)))
                head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n" % len(body)
                head += b"" if i is None else b"X-Page-Id: %d\r\n" % i
                held[v].append(member(arc_record(v, name, arc_url(url), date, head + b"\r\n" + body)))
                size[v] += len(held[v][-1])
                if size[v] >= file_bytes:
                    number += 1
                    yield close(v)
        for v in (1, 2):
            if held[v]:
                yield close(v)

    rows = pages.select(F.col(id_col).cast("long").alias("_id"), F.col(url_col).cast("string").alias("_url"), F.col(html_col).cast("string").alias("_text"))
    write_files(rows.mapInArrow(files, "file binary"), "file", folder, CLOSING)


def arc_records(data: bytes) -> Iterator[dict[str, bytes]]:
    """Header fields, by the names of the file's version block, and ``block`` of every record."""
    names = None
    for record in members(data):
        at = 0
        while at < len(record):
            line_end = record.index(b"\n", at)
            values = record[at:line_end].rstrip(b"\r").split(b" ")
            size = int(values[-1])
            block = record[line_end + 1: line_end + 1 + size]
            if len(block) != size:
                raise ValueError("an ARC record is shorter than it declares")
            if values[0].startswith(b"filedesc://"):
                version, fields = block.split(b"\n")[:2]
                if FIELDS.get(int(version.split(b" ")[0])) != fields.rstrip(b"\r"):
                    raise ValueError("unknown ARC version")
                names = fields.rstrip(b"\r").split(b" ")
            if names is None or len(values) != len(names):
                raise ValueError("an ARC header line does not fit its version")
            yield dict(zip((n.decode() for n in names), values)) | {"block": block}
            at = line_end + 1 + size
            while at < len(record) and record[at:at + 1] in (b"\r", b"\n"):
                at += 1


def http_parts(block: bytes) -> tuple[bytes, bytes, dict[str, str]]:
    """HTTP head with its blank line, payload and header fields; no HTTP: all is payload."""
    if not block.startswith(b"HTTP/"):
        return b"", block, {}
    head, blank, payload = block.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("latin-1").split("\r\n")[1:] if ": " in line)
    return head + blank, payload, {k.lower(): v for k, v in fields.items()}


# ---- WARC

def record_id(path: str, index: int) -> str:
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{path.rpartition('/')[2]}#{index}')}"


def warc_record(kind: str, rid: str, date: str, content_type: bytes, block: bytes, uri: bytes | None = None,
                more: tuple[tuple[str, bytes], ...] = ()) -> bytes:
    when = f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z"
    fields = [("WARC-Type", kind.encode()), ("WARC-Record-ID", b"<" + rid.encode() + b">"), ("WARC-Date", when.encode())]
    fields += [("WARC-Target-URI", uri)] * (uri is not None)
    fields += [("WARC-Block-Digest", b"sha256:" + hashlib.sha256(block).hexdigest().encode()), *more,
               ("Content-Type", content_type), ("Content-Length", b"%d" % len(block))]
    return b"WARC/1.1\r\n" + b"".join(k.encode() + b": " + v + b"\r\n" for k, v in fields) + b"\r\n" + block + b"\r\n\r\n"


def convert(path: str, data: bytes, refers: dict[int, str]) -> Iterator[bytes]:
    """The WARC records of one ARC file. ``refers`` holds the identifier of the first capture for
    the positions of records that repeat one."""
    for k, r in enumerate(arc_records(data)):
        date, url, block = r["Archive-date"].decode(), r["URL"], r["block"]
        if url.startswith(b"filedesc://"):
            yield warc_record("warcinfo", record_id(path, k), date, b"application/warc-fields", b"software: arc converter\r\nformat: WARC File Format 1.1\r\n")
            continue
        head, payload, _ = http_parts(block)
        digest = (("WARC-Payload-Digest", b"sha256:" + hashlib.sha256(payload).hexdigest().encode()),)
        if k in refers:
            more = (*digest, ("WARC-Profile", REVISIT), ("WARC-Refers-To", b"<" + refers[k].encode() + b">"))
            yield warc_record("revisit", record_id(path, k), date, b"application/http; msgtype=response", head, url, more)
        elif head:
            yield warc_record("response", record_id(path, k), date, b"application/http; msgtype=response", block, url, digest)
        else:
            yield warc_record("resource", record_id(path, k), date, r["Content-type"], block, url, digest)


def arc_captures(spark: SparkSession, folder: str) -> DataFrame:
    """``path, index, page_id, payload_bytes, payload_digest`` of every capture in ARC files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                rows = []
                for k, r in enumerate(arc_records(content.as_buffer().to_pybytes())):
                    if not r["URL"].startswith(b"filedesc://"):
                        _, payload, fields = http_parts(r["block"])
                        page = fields.get("x-page-id")
                        rows.append((path, k, None if page is None else int(page), len(payload), hashlib.sha256(payload).hexdigest()))
                if rows:
                    types = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)],
                                                     ["path", "index", "page_id", "payload_bytes", "payload_digest"])

    return read_files(spark, folder).mapInArrow(run, "path string, index long, page_id long, payload_bytes long, payload_digest string")


def arc_to_warc(spark: SparkSession, arc_folder: str, warc_folder: str, least: int = LEAST_PAYLOAD) -> None:
    """Convert every ARC file to a WARC file.

    Of captures with equal payloads of at least ``least`` bytes the one with the smallest page id
    (null last; then by place) is kept whole, the others refer to it. Only what the decisions need
    is shuffled: digests and places, then each file with the decisions on its own records.
    """
    captures = settle(arc_captures(spark, arc_folder))
    place = F.struct(F.col("page_id").isNull().alias("n"), F.col("page_id").alias("i"), F.col("path").alias("p"), F.col("index").alias("k"))
    long_enough = captures.where(F.col("payload_bytes") >= least)
    first = long_enough.groupBy("payload_digest").agg(F.min(place).alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    repeats = (long_enough.join(first, "payload_digest").where((F.col("path") != F.col("_first.p")) | (F.col("index") != F.col("_first.k")))
               .groupBy("path").agg(F.collect_list(F.struct("index", "_first.p", "_first.k")).alias("repeats")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content, repeated in zip(batch.column("path").to_pylist(), batch.column("content"), batch.column("repeats").to_pylist()):
                refers = {r["index"]: record_id(r["p"], r["k"]) for r in repeated or ()}
                data = b"".join(member(x) for x in convert(path, content.as_buffer().to_pybytes(), refers)) + LAST_MEMBER[: -len(CLOSING)]
                yield pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], ["file"])

    # The decisions are settled first, so that few of them are sent to the files and not both shuffled.
    files = read_files(spark, arc_folder).join(settle(repeats), "path", "left").select("path", "content", "repeats")
    write_files(files.mapInArrow(run, "file binary"), "file", warc_folder, CLOSING)


def warc_records(data: bytes) -> Iterator[dict[str, bytes]]:
    """Header fields in lower case and ``block`` of every WARC record."""
    for record in members(data):
        head, _, rest = record.partition(b"\r\n\r\n")
        lines = head.split(b"\r\n")
        if not lines[0].startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        fields = {k.decode().lower(): v for k, v in (line.split(b": ", 1) for line in lines[1:])}
        block = rest[: int(fields["content-length"])]
        if b"sha256:" + hashlib.sha256(block).hexdigest().encode() != fields["warc-block-digest"]:
            raise ValueError("a WARC block does not match its digest")
        yield fields | {"block": block}


def warc_captures(spark: SparkSession, folder: str) -> DataFrame:
    """``record_id, page_id, record_type, refers_to_id, payload_bytes, payload_digest`` as the WARC
    files tell; for revisits the last two are null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows = []
                for r in warc_records(content.as_buffer().to_pybytes()):
                    kind = r["warc-type"].decode()
                    if kind == "warcinfo":
                        continue
                    _, payload, fields = http_parts(r["block"])
                    page = fields.get("x-page-id")
                    whole = kind != "revisit"
                    rows.append((r["warc-record-id"].decode(), None if page is None else int(page), kind,
                                 None if whole else r["warc-refers-to"].decode(),
                                 len(payload) if whole else None, hashlib.sha256(payload).hexdigest() if whole else None))
                if rows:
                    types = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)],
                                                     ["record_id", "page_id", "record_type", "refers_to_id", "payload_bytes", "payload_digest"])

    return read_files(spark, folder).select("content").mapInArrow(
        run, "record_id string, page_id long, record_type string, refers_to_id string, payload_bytes long, payload_digest string")


def with_originals(captures: DataFrame) -> DataFrame:
    """Captures with size and digest of revisits taken from the response they refer to, whose page
    id is ``refers_to``."""
    kept = settle(captures)
    whole = kept.where("record_type != 'revisit'").withColumn("refers_to", F.lit(None).cast("long"))
    original = whole.select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"), "payload_bytes", "payload_digest")
    again = kept.where("record_type = 'revisit'").select("page_id", "record_type", "refers_to_id").join(original, "refers_to_id")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return whole.select(*columns).union(again.select(*columns))
