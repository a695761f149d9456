"""Web archives: one compressed member per record, written and read in parallel."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumisift.llm.common import Scratch
from lumisift.session import fresh_dir
from lumisift.sources.files import open_fs

MAGIC = b"\x1f\x8b\x08"
SPLIT_BYTES = 4 << 20
LEAST_PAYLOAD = 100  # shorter payloads are never replaced by a reference
_READ = 1 << 18
_HEAD_MOST = 1 << 24  # a header beyond this is taken for chance bytes
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
# Names of record fields.
_ID, _REFERS, _LENGTH = "X-Page-ID", "X-Refers-To-Page-ID", "X-Payload-Length"


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                 least: int = LEAST_PAYLOAD) -> DataFrame:
    """records(id, url, payload, digest, record_type, refers_to) of pages.

    Of pages with equal payloads of at least `least` bytes, that with the lowest id is a
    response and the others revisit it. Rows that repeat its id are responses as well,
    and so are pages with equal payloads none of which has an id.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.coalesce(html_col, F.lit("")).alias("payload"))
    digest = F.sha2(F.encode("payload", "UTF-8"), 256)
    # Only digests are counted; a payload moves once, to meet the id of its first page.
    first = (rows.filter(F.octet_length("payload") >= least).select(digest.alias("digest"), "id")
             .groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"))
    revisit = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    return (rows.withColumn("digest", digest).join(first, "digest", "left")
            .select("id", "url", "payload", "digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"),
                    F.when(revisit, F.col("first")).alias("refers_to")))


def _name(page: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}')}>"


def record(page: int | None, url: str | None, payload: bytes, digest: str, kind: str, refers_to: int | None, when: str) -> bytes:
    """One record, not yet compressed. A revisit holds the reply's header but no payload."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if kind == "revisit" else head + payload
    fields = [("WARC-Type", kind), ("WARC-Record-ID", _name(page)), ("WARC-Date", when),
              # Anything that could end a line or is beyond ASCII is escaped.
              ("WARC-Target-URI", None if url is None else quote(url, safe="!#$%&'()*+,/:;=?@[]~")),
              ("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http;msgtype=response"),
              (_ID, page), (_LENGTH, len(payload))]
    if kind == "revisit":
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _name(refers_to)), (_REFERS, refers_to)]
    fields.append(("Content-Length", len(block)))
    lines = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def write_warc(records: DataFrame, folder: str, level: int = 3, file_bytes: int = 1 << 30) -> DataFrame:
    """Write records below `folder`; returns files(path, size) as a table that can be read again.

    Each task writes files of its own under names no other attempt uses. Only the files
    of attempts that succeeded are in the returned table, which is what readers go by.
    """
    when = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = open_fs(folder)
        sink, path, size = None, "", 0
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("id", "url", "payload", "digest", "record_type", "refers_to")]
            for page, url, payload, digest, kind, refers_to in zip(*cols, strict=True):
                if sink is None:
                    system.create_dir(root, recursive=True)
                    path, size = f"part-{uuid.uuid4().hex}.warc.gz", 0
                    sink = system.open_output_stream(f"{root}/{path}", compression=None)
                packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                member = packer.compress(record(page, url, payload.encode(), digest, kind, refers_to, when)) + packer.flush()
                sink.write(member)
                size += len(member)
                if size >= file_bytes:
                    sink.close()
                    yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{path}"]), pa.array([size])], ["path", "size"])
                    sink = None
        if sink is not None:
            sink.close()
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{path}"]), pa.array([size])], ["path", "size"])

    return Scratch(records.sparkSession).cut(records.mapInArrow(write, "path string, size bigint"), "warc-files")


class _Source:
    """A file read forward in blocks from any place."""

    def __init__(self, file: pa.NativeFile, size: int):
        self.file, self.size = file, size

    def blocks(self, at: int) -> Iterator[bytes]:
        while at < self.size:
            data = self.file.read_at(min(_READ, self.size - at), at)
            if not data:
                return
            at += len(data)
            yield data


def _parse(head: bytes) -> dict[str, str] | None:
    """Fields of a record header, or None if it is none."""
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/") or any(":" not in x for x in lines[1:] if x):
        return None
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}
    return fields if fields.get("content-length", "").isdigit() and "warc-type" in fields else None


def _member(source: _Source, at: int) -> tuple[dict[str, str], bytes, int] | None:
    """(fields, block, place after the member) of the record whose member begins at `at`, or None.

    A candidate is valid if it decodes to a record header and then, to its end, to a
    block of the length that the header states.
    """
    unpack, out, fields, end = zlib.decompressobj(31), bytearray(), None, at
    need = None
    try:
        for data in source.blocks(at):
            out += unpack.decompress(data)
            end += len(data) - len(unpack.unused_data)
            if fields is None:
                if not out.startswith(b"WARC/"[:len(out)]):
                    return None
                stop = out.find(b"\r\n\r\n")
                if stop >= 0:
                    fields = _parse(bytes(out[:stop]))
                    if fields is None:
                        return None
                    need = stop + 4
                elif len(out) > _HEAD_MOST:
                    return None
            if unpack.eof:
                break
    except zlib.error:
        return None
    if fields is None or not unpack.eof or len(out) < need + int(fields["content-length"]):
        return None
    return fields, bytes(out[need:need + int(fields["content-length"])]), end


def records_from(source: _Source, start: int, stop: int) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(place, fields, block) of the records whose members begin in [start, stop).

    The magic bytes of a member may also occur inside one, so each place found is tried
    and passed over unless it decodes. After a valid record the next is expected where
    it ends; if none is there, the search goes on from that place.
    """
    at = start
    while at < stop:
        found = _member(source, at) if source.file.read_at(min(3, source.size - at), at) == MAGIC else None
        if found:
            yield at, found[0], found[1]
            at = found[2]
            continue
        # The next candidate after `at`; magic bytes may lie across two blocks.
        at += 1
        tail, base = b"", at
        for data in source.blocks(at):
            hit = (tail + data).find(MAGIC)
            if hit >= 0:
                at = base - len(tail) + hit
                break
            base += len(data)
            tail = (tail + data)[-2:]
            if base - 2 >= stop:
                return
        else:
            return


def read_warc(spark: SparkSession, files: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(path, place, page_id, url, record_type, refers_to, payload_bytes, digest, payload) of all records.

    Files are cut into byte ranges, each a row of its own, and spread over tasks. A task
    finds the first member that begins in its range by itself and reads the records that
    begin there, the last one beyond the end of the range if need be, so a record is
    read once wherever the cuts fall. `payload` is null for a revisit; bytes that decode
    to no record are passed over. An empty table of files gives no rows.
    """
    ranges = files.select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(split_bytes).cast("long"))).alias("start"))
    count = ranges.count()
    placed = ranges.repartition(max(1, min(count, 100_000)), "path", "start")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["path", "place", "page_id", "url", "record_type", "refers_to", "payload_bytes", "digest", "payload"]
        types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]

        def made(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        for batch in batches:
            for path, size, start in zip(*(batch.column(c).to_pylist() for c in ("path", "size", "start")), strict=True):
                system, inner = open_fs(path)
                rows, held = [], 0
                with system.open_input_file(inner) as file:
                    for place, fields, block in records_from(_Source(file, size), start, min(size, start + split_bytes)):
                        kind, page, refers = fields["warc-type"], fields.get(_ID.lower()), fields.get(_REFERS.lower())
                        payload = None if kind == "revisit" else block.partition(b"\r\n\r\n")[2]
                        rows.append((path, place, page and int(page), fields.get("warc-target-uri"), kind, refers and int(refers),
                                     int(fields.get(_LENGTH.lower(), len(payload or b""))), fields.get("warc-payload-digest", "").removeprefix("sha256:"), payload))
                        held += len(payload or b"")
                        if held > 4 << 20:
                            yield made(rows)
                            rows, held = [], 0
                if rows:
                    yield made(rows)

    return placed.mapInArrow(read, "path string, place bigint, page_id bigint, url string, record_type string, refers_to bigint, "
                                   "payload_bytes bigint, digest string, payload binary")


def round_trip(pages: DataFrame, id_col: str = "page_id", split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(id_col, payload_bytes, payload_digest, record_type, refers_to) of pages written to archives and read back.

    Length and digest of a response are those of the payload as read; a revisit states
    those of the payload it stands for. Null and empty pages have empty payloads.
    """
    spark = pages.sparkSession
    folder = fresh_dir(spark, "warc")
    back = read_warc(spark, write_warc(plan_records(pages, id_col), folder), split_bytes)
    stored = F.col("payload").isNotNull()
    return back.select(F.col("page_id").alias(id_col), F.when(stored, F.octet_length("payload").cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
                       F.when(stored, F.sha2("payload", 256)).otherwise(F.col("digest")).alias("payload_digest"), "record_type", "refers_to")
