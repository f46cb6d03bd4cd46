"""WARC archives: segmented records written and put together again.

Writing: a page is a response record whose HTTP block is framed in chunked transfer coding; of pages with equal payloads the
one with the largest page_id is the response and the others are revisit records that refer to it. A block longer than
``segment_bytes`` is cut: the response keeps the first segment, continuation records carry the rest, with the origin's
identifier and the segment number, and the last one the total length. Records are single gzip members. The manifest, a table
that Spark commits, names the files of the attempts that count.

Reading: files are streamed record by record; segments are grouped by origin, ordered by number, checked against the total
length, and the chunked framing is decoded. A record's identifier is made of page_id and payload digest; where rows are
repeated in both, each record has a serial number besides, so that it is an origin of its own, and a revisit refers to them by
what they have in common.

Defined results: null html is an empty payload, a null url an empty one; a null page_id is written and read as such, and only
stands as the response of a payload that no other page has; rows repeated in page_id and html are records of their own, all
responses if that page is the response; an empty table gives no files and an empty result; further columns play no part.
Segments that are missing, out of range or of another length than announced raise an error that names the record.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm.shared import filesystem, materialize, scratch, slices

MANIFEST = "path string, n_records long, n_bytes long"
CHUNK = 8192
#: The date of all records, so that files depend on the pages only.
DATE = "2024-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    """Chunked transfer coding of a payload."""
    parts = []
    for i in range(0, len(payload), size):
        part = payload[i : i + size]
        parts += [b"%x\r\n" % len(part), part, b"\r\n"]
    return b"".join(parts) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    """The payload of a body in chunked transfer coding; chunk extensions and trailers are passed over."""
    parts, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if not size:
            return b"".join(parts)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk is not of the length announced")
        parts.append(body[at : at + size])
        at += size + 2


def record(kind: str, identity: str, block: bytes, fields: dict[str, str]) -> bytes:
    """One record, as a gzip member."""
    head = {"WARC-Type": kind, "WARC-Record-ID": f"<{identity}>", "WARC-Date": DATE, **fields, "Content-Length": str(len(block))}
    lines = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n"
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(lines.encode() + block + b"\r\n\r\n") + packer.flush()


def page_records(page_id: int | None, url: str, payload: bytes, keep_id: int | None, serial: str, segment_bytes: int) -> Iterator[bytes]:
    """The records of a page, which is a revisit of ``keep_id`` if that is another page.

    ``serial`` tells the records of repeated rows apart; it is empty of any other row.
    """
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    own = f"urn:page:{'' if page_id is None else page_id}:{digest}" + (f":{serial}" if serial else "")
    # a URL's line ends would end the header
    fields = {"WARC-Target-URI": url.replace("\r", "%0D").replace("\n", "%0A"), "WARC-Payload-Digest": f"sha1:{digest}"}
    if page_id != keep_id:
        block = HTTP + b"Content-Length: %d\r\n\r\n" % len(payload)
        profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        yield record("revisit", own, block, fields | {"Content-Type": "application/http; msgtype=response", "WARC-Profile": profile, "WARC-Refers-To": f"<urn:page:{'' if keep_id is None else keep_id}:{digest}>"})
        return
    block = HTTP + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    fields["Content-Type"] = "application/http; msgtype=response"
    parts = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    if len(parts) == 1:
        yield record("response", own, block, fields)
        return
    yield record("response", own, parts[0], fields | {"WARC-Segment-Number": "1"})
    for i, part in enumerate(parts[1:], 2):
        more = {"WARC-Segment-Origin-ID": f"<{own}>", "WARC-Segment-Number": str(i)}
        if i == len(parts):
            more["WARC-Segment-Total-Length"] = str(len(block))
        yield record("continuation", f"{own}:{i}", part, more)


def write_pages(pages: DataFrame, folder: str | None = None, segment_bytes: int = 16 << 10, file_bytes: int = 64 << 20) -> DataFrame:
    """Write pages (page_id, url, html) and return the manifest. A task begins another file at ``file_bytes``."""
    folder = folder or scratch(pages.sparkSession, "warc")
    clean = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    clean = clean.withColumn("digest", F.unhex(F.sha1("html")))
    # of payloads that several rows have, only identifiers and digests are grouped and joined; html goes by page_id
    prints = materialize(clean.groupBy("page_id", "digest").agg(F.count(F.lit(1)).alias("rows")), "warc-prints")
    shared = prints.groupBy("digest").agg(F.max("page_id").alias("keep_id"), F.sum("rows").alias("all")).where(F.col("all") > 1)
    shared = materialize(shared.select("digest", "keep_id"), "warc-shared")
    more = prints.join(shared, "digest").select(F.col("page_id").alias("_page"), F.col("digest").alias("_digest"), "keep_id", (F.col("rows") > 1).alias("again"))
    more = materialize(more, "warc-repeats")
    keyed = clean.join(more, F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("digest") == F.col("_digest")), "left")
    keep = F.when(F.col("_digest").isNull(), F.col("page_id")).otherwise(F.col("keep_id"))
    keyed = keyed.select("page_id", "url", "html", keep.alias("keep_id"), F.coalesce("again", F.lit(False)).alias("again"))

    def write(batches):
        filesys, root = filesystem(folder)
        filesys.create_dir(root, recursive=True)
        task, out, rows, seen = TaskContext.get().partitionId(), None, [], 0
        for batch in slices(batches, "html"):
            for page_id, url, html, keep_id, again in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "keep_id", "again"))):
                seen += again
                for data in page_records(page_id, url, html.encode(), keep_id, f"{task}-{seen}" if again else "", segment_bytes):
                    if out is not None and size >= file_bytes:
                        out.close()
                        rows.append((f"{folder}/{name}", n, size))
                        out = None
                    if out is None:
                        name, n, size = f"{task:06d}-{uuid.uuid4().hex}.warc.gz", 0, 0
                        out = filesys.open_output_stream(f"{root}/{name}", compression=None)
                    out.write(data)
                    n, size = n + 1, size + len(data)
        if out is not None:
            out.close()
            rows.append((f"{folder}/{name}", n, size))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["path", "n_records", "n_bytes"])

    return materialize(keyed.mapInArrow(write, MANIFEST), "warc-manifest")


def members(stream, size: int = 1 << 20) -> Iterator[bytes]:
    """The gzip members of a stream, one record each."""
    data, unpack, parts = stream.read(size), zlib.decompressobj(31), []
    while data:
        parts.append(unpack.decompress(data))
        if unpack.eof:
            yield b"".join(parts)
            data, unpack, parts = unpack.unused_data, zlib.decompressobj(31), []
        else:
            data = b""
        if not data:
            data = stream.read(size)
    if parts and any(parts):
        raise ValueError("the archive ends within a record")


def split_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields, by lower-case name, and block of a record."""
    end = data.index(b"\r\n\r\n")
    lines = data[:end].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    size = int(fields["content-length"])
    block = data[end + 4 : end + 4 + size]
    if len(block) != size:
        raise ValueError(f"{fields['warc-record-id']} is cut short")
    return fields, block


def _page_of(identity: str) -> int | None:
    found = identity.strip("<>").split(":")[2]
    return int(found) if found else None


RAW = "origin string, number int, kind string, total long, refers_to long, block binary"
READ = "page_id long, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_records(manifest: DataFrame) -> DataFrame:
    """Every record or segment: its origin's identifier, segment number (1 if whole), type, total length, and block."""

    def read(batches):
        names = ["origin", "number", "kind", "total", "refers_to", "block"]
        types = [pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
        for batch in batches:
            for path in batch.column("path").to_pylist():
                filesys, inner = filesystem(path)
                rows, size = [], 0
                with filesys.open_input_stream(inner, compression=None) as stream:
                    for data in members(stream):
                        fields, block = split_record(data)
                        kind, number = fields["warc-type"], int(fields.get("warc-segment-number", 1))
                        origin = fields.get("warc-segment-origin-id", fields["warc-record-id"])
                        total = fields.get("warc-segment-total-length")
                        whole = kind == "response" and "warc-segment-number" not in fields
                        refers = _page_of(fields["warc-refers-to"]) if kind == "revisit" else None
                        rows.append((origin, number, kind, len(block) if whole or kind == "revisit" else int(total) if total else None, refers, block))
                        size += len(block)
                        if size >= 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    tasks = max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return manifest.select("path").repartition(tasks).mapInArrow(read, RAW)


def assemble(origin: str, parts: list[tuple[int, str, int | None, int | None, bytes]]) -> tuple:
    """The record of one identifier, from its segments in order."""
    numbers = [p[0] for p in parts]
    if numbers != list(range(1, len(parts) + 1)):
        raise ValueError(f"{origin}: segments {numbers} are not complete")
    block, total = b"".join(p[4] for p in parts), parts[-1][2]
    if total != len(block):
        raise ValueError(f"{origin}: {len(block)} bytes, {total} announced")
    kind, refers = parts[0][1], parts[0][3]
    end = block.index(b"\r\n\r\n")
    head, body = block[:end].lower(), block[end + 4 :]
    if kind == "revisit":
        size = int(head.split(b"content-length:")[1].split(b"\r\n")[0])
        return _page_of(origin), None, size, origin.strip("<>").split(":")[3], kind, refers
    payload = dechunked(body) if b"transfer-encoding: chunked" in head else body
    return _page_of(origin), payload, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), kind, None


def read_pages(manifest: DataFrame, payload: bool = True) -> DataFrame:
    """A row per record put together: page_id, payload (null of revisits), its size and digest, type, refers_to.

    Segments of an origin come next to each other and in order by a sort that Spark spills; a task holds one record's.
    """
    types = [pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    names = ["page_id", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]

    def join(batches):
        origin, held, rows, size = None, [], [], 0

        def out(rows):
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
            return pa.RecordBatch.from_arrays([c for c, n in zip(columns, names) if payload or n != "payload"], names=[n for n in names if payload or n != "payload"])

        for batch in slices(batches, "block"):
            for row in zip(*(batch.column(c).to_pylist() for c in ("origin", "number", "kind", "total", "refers_to", "block"))):
                if row[0] != origin:
                    if held:
                        rows.append(assemble(origin, held))
                    origin, held = row[0], []
                held.append(row[1:])
                size += len(row[5])
            if size >= 4 << 20 and rows:
                yield out(rows)
                rows, size = [], 0
        if held:
            rows.append(assemble(origin, held))
        if rows:
            yield out(rows)

    schema = READ if payload else READ.replace("payload binary, ", "")
    ordered = read_records(manifest).repartition("origin").sortWithinPartitions("origin", "number")
    return ordered.mapInArrow(join, schema)
