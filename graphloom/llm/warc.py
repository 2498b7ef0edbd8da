"""WARC archives of pages, and a normaliser for monolithic gzip files.

Archives that were compressed as one stream cannot be read at an offset.  The
normaliser inflates such a stream once, rewrites every record as a gzip member
of its own and notes the members in a sidecar offset index, one JSON line each.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, stored

#: Inflated bytes after which an archive is closed (a longer record stands alone).
ARCHIVE_BYTES = 16 << 20
LEVEL = 1
DATE = "1970-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest32(payload: bytes) -> str:
    """Base32 SHA-1, upper case."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: str, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def make_record(page_id: str | None, url: str | None, payload: bytes, refers_to: str | None, revisit: bool) -> bytes:
    """One WARC record; a revisit keeps the HTTP head and leaves the payload out."""
    digest = digest32(payload)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(str(page_id), digest)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if revisit:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(str(refers_to), digest)}", f"X-Refers-To-Page-ID: {refers_to}"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class Records:
    """Cuts WARC records out of inflated bytes that arrive in pieces."""

    def __init__(self) -> None:
        self.held = bytearray()

    def feed(self, piece: bytes) -> Iterator[bytes]:
        self.held += piece
        at = 0
        while (stop := self.held.find(b"\r\n\r\n", at)) >= 0:
            size = re.search(rb"(?i)^content-length:[ \t]*(\d+)", self.held[at:stop], re.M)
            if not self.held.startswith(b"WARC/", at) or not size:
                raise ValueError("no WARC record where one should begin")
            end = stop + 4 + int(size[1]) + 4
            if end > len(self.held):
                break
            yield bytes(self.held[at:end])
            at = end
        del self.held[:at]

    def close(self) -> None:
        if self.held.strip():
            raise ValueError("archive ends inside a record")


def inflate(data: bytes, piece: int = 1 << 20) -> Iterator[bytes]:
    """The inflated bytes of a gzip file of one or more members, read once."""
    box = zlib.decompressobj(31)
    while data:
        out = box.decompress(data, piece)
        if out:
            yield out
        if box.eof:
            data = box.unused_data.lstrip(b"\0")
            box = zlib.decompressobj(31)
        elif not (rest := box.unconsumed_tail):
            if not out:
                raise ValueError("gzip stream cut short")
            data = b""
            tail = box.flush()
            if tail:
                yield tail
            if not box.eof:
                raise ValueError("gzip stream cut short")
        else:
            data = rest


def gzip_member(data: bytes, level: int = LEVEL) -> bytes:
    box = zlib.compressobj(level, zlib.DEFLATED, 31)
    return box.compress(data) + box.flush()


def normalise(monolith: bytes, level: int = LEVEL) -> tuple[bytes, str]:
    """The same records as one gzip member each, and the sidecar index: a JSON
    line per record with offset, length and the record's WARC id."""
    out, lines, records = bytearray(), [], Records()
    for piece in inflate(monolith):
        for record in records.feed(piece):
            member = gzip_member(record, level)
            name = re.search(rb"(?im)^warc-record-id:[ \t]*(\S+)", record)
            lines.append(json.dumps({"offset": len(out), "length": len(member), "id": name[1].decode() if name else None}))
            out += member
    records.close()
    return bytes(out), "\n".join(lines)


def read_member(archive: bytes, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and block of the record at an index entry."""
    record = zlib.decompress(archive[offset : offset + length], 31)
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}
    return fields, rest[: int(fields["content-length"])]


def monoliths(records: Iterable[bytes], limit: int = ARCHIVE_BYTES, level: int = LEVEL) -> Iterator[bytes]:
    """Records compressed as one stream per archive of about ``limit`` bytes."""
    box, size, out = None, 0, bytearray()
    for r in records:
        if box is not None and size + len(r) > limit:
            yield bytes(out + box.flush())
            box = None
        if box is None:
            box, size, out = zlib.compressobj(level, zlib.DEFLATED, 31), 0, bytearray()
        out += box.compress(r)
        size += len(r)
    if box is not None:
        yield bytes(out + box.flush())


def write_archives(pages: DataFrame, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Archives of one record per page, ``(data binary, sidecar string)``.

    Among equal payloads of ``least_bytes`` or more, rows with the smallest id
    are responses and the others revisit it; shorter payloads, and groups in
    which no row has an id, are all responses.  Null payloads are empty ones.
    Monolithic streams are written first and normalised at once."""
    rows = pages.select(pages[id_col].alias("id"), pages[url_col].cast("string").alias("url"), F.coalesce(pages[payload_col].cast("string"), F.lit("")).alias("payload")).withColumn("hash", F.sha1("payload"))
    firsts = rows.where(F.octet_length("payload") >= least_bytes).groupBy("hash").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    typed = rows.join(firsts.select(F.col("hash").alias("h"), "first"), (F.col("hash") == F.col("h")) & (F.octet_length("payload") >= least_bytes), "left")
    typed = typed.select(F.col("id").cast("string").alias("id"), "url", "payload", F.col("first").cast("string").alias("first"), (F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))).alias("revisit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[bytes]:
            for batch in batches:
                cols = [column(batch, c) for c in ("id", "url", "payload", "first", "revisit")]
                for row in zip(*cols):
                    i, url, payload, first, revisit = (x.as_py() for x in row)
                    yield make_record(i, url, payload.encode(), first, revisit)

        for monolith in monoliths(records()):
            data, sidecar = normalise(monolith)
            yield pa.RecordBatch.from_arrays([pa.array([data], pa.binary()), pa.array([sidecar])], ["data", "sidecar"])

    return typed.mapInArrow(run, "data binary, sidecar string")


def read_archives(archives: DataFrame, with_payload: bool = False) -> DataFrame:
    """Every record, read through the sidecar at its offset: page_id (string),
    url, payload_bytes, payload_digest, record_type, refers_to and, with
    ``with_payload``, payload (null for revisits).  A payload that does not
    match its digest is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, sidecar in zip(column(batch, "data"), column(batch, "sidecar")):
                archive, rows = data.as_py(), []
                for line in sidecar.as_py().split("\n"):
                    entry = json.loads(line)
                    fields, block = read_member(archive, entry["offset"], entry["length"])
                    http, _, payload = block.partition(b"\r\n\r\n")
                    size = int(re.search(rb"(?i)content-length: *(\d+)", http)[1])
                    digest, revisit = fields["warc-payload-digest"].removeprefix("sha1:"), fields["warc-type"] == "revisit"
                    if not revisit and (digest32(payload) != digest or len(payload) != size):
                        raise ValueError(f"payload of {fields['warc-record-id']} is damaged")
                    row = (fields.get("x-page-id"), fields.get("warc-target-uri"), size, digest, fields["warc-type"], fields.get("x-refers-to-page-id"))
                    rows.append((*row, None if revisit else payload.decode()) if with_payload else row)
                cols = list(zip(*rows)) or [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if n == "payload_bytes" else pa.string()) for c, n in zip(cols, names)], names)

    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * with_payload
    return archives.mapInArrow(run, ", ".join(f"{n} {'bigint' if n == 'payload_bytes' else 'string'}" for n in names))


def export_files(archives: DataFrame, folder: str) -> None:
    """Write each archive as ``<md5>.warc.gz`` with ``<md5>.idx`` beside it, to
    any folder that pyarrow can open from the executors."""

    def run(rows: Iterator) -> None:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        for r in rows:
            name = hashlib.md5(r.data).hexdigest()
            for end, data in ((".warc.gz", bytes(r.data)), (".idx", r.sidecar.encode())):
                with store.open_output_stream(f"{base}/{name}{end}", compression=None) as f:
                    f.write(data)

    archives.foreachPartition(run)


def round_trip(pages: DataFrame, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write the archives to the shared folder and read them back: id,
    payload_bytes, payload_digest, record_type, refers_to per page.  Repeated
    rows give repeated rows; rows that share the smallest id of a payload are
    all responses; other columns are ignored."""
    kept = stored(write_archives(pages, least_bytes, id_col, url_col, payload_col), "warc")
    kind = pages.schema[id_col].dataType
    back = read_archives(kept)
    return back.select(F.col("page_id").cast(kind).alias(id_col), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))
