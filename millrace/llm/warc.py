"""WARC archives: a writer, and a reader that salvages what is left of damaged ones.

Archives have a gzip member for each record. The reader checks every member and record; where a check fails it searches for the
next member or version line that passes, whatever the archive begins with, and logs the bytes between as a gap. Of a broken member
it takes the records that are whole.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.shared import new_path, scratch, small, stored

VERSION, MAGIC = b"WARC/1.1\r\n", b"\x1f\x8b\x08"
_VERSION_LINE = re.compile(rb"WARC/[01]\.[0-9]{1,2}\r\n")
_START = re.compile(_VERSION_LINE.pattern + b"|" + re.escape(MAGIC))
#: An archive is closed when it has so many bytes; one is read as a whole.
ARCHIVE_BYTES = 16 << 20
_CHUNK = 1 << 16


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data, usedforsecurity=False).digest()).decode()


def same_digest(said: str, content: bytes) -> bool | None:
    """Whether a digest header, sha1:, sha256: or md5: with base32 or hexadecimal in either case, is that of content; None for other forms."""
    name, _, value = said.partition(":")
    name, value = name.strip().lower(), value.strip().rstrip("=")
    if name not in ("sha1", "sha256", "md5"):
        return None
    own = hashlib.new(name, content, usedforsecurity=False).digest()
    if re.fullmatch("[0-9A-Fa-f]+", value) and len(value) == 2 * len(own):
        return value.lower() == own.hex()
    return value.upper() == base64.b32encode(own).decode().rstrip("=")


def member(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member; the same record gives the same bytes."""
    lines = [*headers, ("WARC-Block-Digest", f"sha1:{sha1_base32(block)}"), ("Content-Length", str(len(block)))]
    data = VERSION + "".join(f"{k}: {v}\r\n" for k, v in lines).encode() + b"\r\n" + block + b"\r\n\r\n"
    press = zlib.compressobj(6, zlib.DEFLATED, 31)
    return press.compress(data) + press.flush()


def page_record(page_id: int | None, url: str | None, payload: bytes | None, length: int, digest: str, refers_to: int | None, date: str) -> bytes:
    """A response record, or a revisit that has the response's HTTP header alone if payload is None."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    headers = [
        ("WARC-Type", "response" if payload is not None else "revisit"),
        ("WARC-Record-ID", f"<urn:x-page:{page_id}>"),
        ("WARC-Date", date),
        ("WARC-Target-URI", quote(url, safe="%/:=&?~#+!$,;'@()*[]") if url else f"urn:x-page:{page_id}"),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("Content-Type", "application/http;msgtype=response"),
    ]
    if payload is None:
        headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:x-page:{refers_to}>")]
    return member(headers, http + (payload or b""))


@dataclass(frozen=True)
class Record:
    start: int
    end: int
    headers: dict[str, str] = field(repr=False)
    block: bytes = field(repr=False)
    #: What is odd about a record that is sound all the same.
    note: str = ""

    @property
    def payload(self) -> bytes:
        return self.block.partition(b"\r\n\r\n")[2] if self.headers.get("content-type", "").startswith("application/http") else self.block


@dataclass(frozen=True)
class Gap:
    """Bytes [start, end) of the archive that belong to no valid record."""

    start: int
    end: int
    reason: str


def _record(data: bytes, at: int) -> tuple[Record | None, int, str]:
    """(record, end, what is wrong) of the record at a place."""
    if not _VERSION_LINE.match(data, at):
        return None, at, "no version line"
    head = data.find(b"\r\n\r\n", at)
    if head < 0:
        return None, at, "header without end"
    headers: dict[str, str] = {}
    name = ""
    for line in data[at:head].split(b"\r\n")[1:]:
        text = line.decode("utf-8", "replace")
        if text[:1] in (" ", "\t") and name:  # a folded line goes on with the value before it
            headers[name] += " " + text.strip()
            continue
        name, colon, value = text.partition(":")
        if not colon:
            return None, at, "broken header line"
        name = name.strip().lower()
        headers[name] = value.strip()
    length = headers.get("content-length", "")
    if not (length.isascii() and length.isdigit()):
        return None, at, "no content length"
    start, end = head + 4, head + 4 + int(length)
    if data[end : end + 4] != b"\r\n\r\n":
        return None, at, "block of another length"
    block = data[start:end]
    if same_digest(headers.get("warc-block-digest", ""), block) is False:
        return None, at, "warc-block-digest differs"
    record = Record(at, end + 4, headers, block)
    # Writers differ in what they call the payload, such as the body before or after its transfer encoding is taken off.
    if headers.get("warc-type") == "response" and same_digest(headers.get("warc-payload-digest", ""), record.payload) is False:
        record = Record(at, end + 4, headers, block, "warc-payload-digest differs")
    return record, end + 4, ""


def salvage_plain(data: bytes) -> Iterator[Record | Gap]:
    """The valid records of a plain archive, and the gaps between them, in order."""
    at, lost, why = 0, -1, ""
    while at < len(data):
        record, end, wrong = _record(data, at)
        if record:
            if lost >= 0:
                yield Gap(lost, at, why)
                lost = -1
            yield record
            at = end
            continue
        if lost < 0:
            lost, why = at, wrong
        found = _VERSION_LINE.search(data, at + 1)
        at = found.start() if found else len(data)
    if lost >= 0:
        yield Gap(lost, len(data), why)


def _member(data: memoryview, at: int) -> tuple[bytes | None, int, str]:
    """(content, end, what is wrong) of the gzip member at a place; its checksum is checked."""
    unpack, parts, place = zlib.decompressobj(31), [], at
    try:
        while not unpack.eof:
            if place >= len(data):
                return None, at, "member without end"
            parts.append(unpack.decompress(data[place : place + _CHUNK]))
            place += _CHUNK
    except zlib.error as e:
        return None, at, f"member: {e}"
    return b"".join(parts), min(place, len(data)) - len(unpack.unused_data), ""


def _before_damage(data: memoryview, at: int, least: int | None = None) -> tuple[bytes, int]:
    """(content, end) of what the gzip member at a place gives before it fails or the data end; with least, of as few of its bytes
    as give so much. A call that fails gives nothing, so it is made again in smaller steps."""
    unpack, parts, size, place, step = zlib.decompressobj(31), [], 0, at, _CHUNK
    while step and place < len(data) and not unpack.eof and (least is None or size < least):
        saved = unpack.copy()
        try:
            part = unpack.decompress(data[place : place + step])
        except zlib.error:
            part = None
        if part is None or (least is not None and size + len(part) >= least and step > 1):
            unpack, step = saved, step // 256
            continue
        parts.append(part)
        size += len(part)
        place += step
    return b"".join(parts), min(place, len(data))


def _inside(data: memoryview, at: int) -> tuple[list[Record | Gap], int, str]:
    """(what is found, end, what is wrong) of the gzip member at a place. Of a broken one, records before a cut, or those that
    have a digest of their block if bytes are wrong, for these may have come out wrong before the member failed; it ends behind them."""
    content, end, wrong = _member(data, at)
    if content is not None:
        return list(salvage_plain(content)), end, ""
    content, end = _before_damage(data, at)
    cut = end == len(data)
    kept = [x for x in salvage_plain(content) if isinstance(x, Record) and (cut or same_digest(x.headers.get("warc-block-digest", ""), x.block))]
    return list(kept), _before_damage(data, at, kept[-1].end)[1] if kept else at, wrong


def salvage(data: bytes) -> Iterator[Record | Gap]:
    """The valid records of an archive, compressed or plain, and its gaps. A record in a member has the place of the member."""
    view, at, lost, why = memoryview(data), 0, -1, ""
    while at < len(data):
        packed = data.startswith(MAGIC, at)
        if packed:
            found, end, wrong = _inside(view, at)
        else:
            record, end, wrong = _record(data, at)
            found = [record] if record else []
        if any(isinstance(x, Record) for x in found):
            if lost >= 0:
                yield Gap(lost, at, why)
                lost = -1
            for x in found:
                if isinstance(x, Gap):
                    yield Gap(at, end, f"inside a member: {x.reason}")
                else:
                    yield Record(at, end, x.headers, x.block, x.note) if packed else x
            at = end
            if not wrong:
                continue
            # What is left of a broken member is lost up to the next start.
            if at < len(data):
                lost, why = at, wrong
            place = _START.search(data, at)
        else:
            if lost < 0:
                lost, why = at, wrong or (found[0].reason if found else "empty member")
            place = _START.search(data, at + 1)
        at = place.start() if place else len(data)
    if lost >= 0:
        yield Gap(lost, len(data), why)


def write_archives(
    pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z"
) -> DataFrame:
    """Writes a record for each row of pages to archives in a folder that all executors share; returns (path, records, bytes).

    Null html is an empty payload. Of records with equal payloads of least_bytes or more the one with the smallest id is a
    response, and others, also rows of that id that are equal, if any, are responses only if they share that id; the rest
    revisit it. A null id is smallest only where there is no other. No rows: no archives. Extra columns are not read.
    """
    spark = pages.sparkSession
    payload = F.coalesce(F.col(html_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), payload.alias("payload"))
    # Equal payloads are found by SHA-256. Digests that occur once are dropped before the join, and pages stay where they are
    # as long as the rest is small enough to be sent to them.
    rows = rows.withColumn("same", F.unhex(F.sha2("payload", 256)))
    first = rows.select("same", "id").groupBy("same").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    first = stored(first, "first")
    revisit = ~F.col("id").eqNullSafe(F.col("first")) & F.col("first").isNotNull() & (F.length("payload") >= least_bytes)
    ready = rows.join(small(first), "same", "left").withColumn("revisit", revisit).withColumn("refers_to", F.when(F.col("revisit"), F.col("first")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        files, folder = pafs.FileSystem.from_uri(path)
        files.create_dir(folder, recursive=True)
        done: list[tuple[str, int, int]] = []
        part: list[bytes] = []

        def close() -> None:
            name = f"part-{task.partitionId():06d}-{len(done):05d}.warc.gz"
            data = b"".join(part)
            with files.open_output_stream(f"{folder}/_{name}.{task.taskAttemptId()}", compression=None) as out:
                out.write(data)
            files.move(f"{folder}/_{name}.{task.taskAttemptId()}", f"{folder}/{name}")
            done.append((f"{path}/{name}", len(part) - 1, len(data)))
            part.clear()

        size = 0
        for batch in batches:
            for i in range(len(batch)):
                page_id, url, content, refers_to, is_revisit = (batch.column(c)[i].as_py() for c in ("id", "url", "payload", "refers_to", "revisit"))
                if not part:
                    part.append(member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:x-archive:{task.partitionId()}:{len(done)}>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], b"software: millrace\r\n"))
                    size = len(part[0])
                part.append(page_record(page_id, url, None if is_revisit else content, len(content), sha1_base32(content), refers_to, date))
                size += len(part[-1])
                if size >= ARCHIVE_BYTES:
                    close()
        if part:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int64())], ["path", "records", "bytes"])

    return stored(ready.select("id", "url", "payload", "refers_to", "revisit").mapInArrow(run, "path string, records bigint, bytes bigint"), "archives")


def read_archives(spark: SparkSession, path: str, wanted: Mapping[str, int] | None = None) -> DataFrame:
    """A row for each record, warcinfo aside, and each gap of the archives in a folder (or under a glob).

    (path, start, end, gap, record_type, record_id, refers_to, uri, payload_bytes, payload_digest, payload, note). For gaps, gap is the
    reason and what follows is null. A revisit has no payload; its bytes and digest are those of the response. note tells of a payload
    digest that isn't that of the payload as it stands; payload_digest is then the payload's own. Each archive is read as one value,
    so it may have 2 GB at most.
    With wanted, records by name of archive, it is an error if the folder has other archives or one has another number of records.
    """
    names = ["path", "start", "end", "gap", "record_type", "record_id", "refers_to", "uri", "payload_bytes", "payload_digest", "payload", "note"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.string()]

    def row(name: str, x: Record | Gap) -> tuple | None:
        if isinstance(x, Gap):
            return (name, x.start, x.end, x.reason, *[None] * 8)
        kind, h = x.headers.get("warc-type"), x.headers
        if kind == "warcinfo":
            return None
        own = (name, x.start, x.end, None, kind, h.get("warc-record-id"), h.get("warc-refers-to"), h.get("warc-target-uri"))
        if kind == "revisit":
            said = re.search(rb"(?i)\r\nContent-Length: *(\d+)", x.block)
            digest = h.get("warc-payload-digest", "").removeprefix("sha1:")
            return *own, int(said[1]) if said else None, digest or None, None, x.note or None
        return *own, len(x.payload), sha1_base32(x.payload), x.payload, x.note or None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                name, part, size, records = batch.column(0)[i].as_py(), [], 0, 0
                for x in salvage(batch.column(1)[i].as_py()):
                    if made := row(name, x):
                        records += isinstance(x, Record)
                        part.append(made)
                        size += len(made[-2] or b"")
                    if size > ARCHIVE_BYTES or len(part) >= 5000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*part, strict=True), kinds, strict=True)], names)
                        part, size = [], 0
                if wanted is not None and records != wanted.get(name.rpartition("/")[2]):
                    raise ValueError(f"{name}: {records} records read, {wanted.get(name.rpartition('/')[2])} written")
                if part:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*part, strict=True), kinds, strict=True)], names)

    schema = "path string, start bigint, end bigint, gap string, record_type string, record_id string, refers_to string, uri string, payload_bytes bigint, payload_digest string, payload binary, note string"
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").load(path)
    if wanted is not None:
        there = sorted(r["path"].rpartition("/")[2] for r in files.select("path").collect())
        if there != sorted(wanted):
            raise ValueError(f"{path}: {len(there)} archives found, {len(wanted)} written, or others")
    return files.select("path", "content").mapInArrow(run, schema)


def page_id_of(record_id: str) -> Column:
    number = F.regexp_extract(record_id, r"<urn:x-page:(-?[0-9]+)>", 1)
    return F.when(number != "", number.cast("long"))


def round_trip(pages: DataFrame, **options: object) -> DataFrame:
    """Writes pages to archives in the shared folder and reads them back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    It fails if an archive has another number of valid records than were written."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    with scratch(spark):
        written = write_archives(pages, path, **options)
        wanted = {r["path"].rpartition("/")[2]: r["records"] for r in written.select("path", "records").collect()}  # one for each archive
    if not wanted:
        return spark.createDataFrame([], "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")
    found = read_archives(spark, path, wanted).filter("gap IS NULL")
    return found.select(page_id_of("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page_id_of("refers_to").alias("refers_to"))
