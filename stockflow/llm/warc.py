"""WARC archives: one gzip member per record, written by the tasks and read back sequentially."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import common

#: A task starts another archive once one has so many bytes, so that no reader gets a file of unbounded length.
ARCHIVE_BYTES = 256 << 20
CHUNK = 1 << 18
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("refers_to", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("error", T.StringType()),
    ]
)
RECORD_WITH_PAYLOAD = T.StructType([*RECORD.fields, T.StructField("payload", T.BinaryType())])
MANIFEST = T.StructType([T.StructField("path", T.StringType()), T.StructField("records", T.LongType()), T.StructField("bytes", T.LongType())])


def revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, digest, refers_to) of each page that has the payload of a page with a larger page_id.

    Works on ids and digests alone. A digest that a third of all pages share meets in a partial
    aggregate first, and in a join whose large partitions Spark splits.
    """
    ids = pages.select("page_id", F.sha1(payload := F.coalesce(F.encode("html", "UTF-8"), F.lit(b""))).alias("digest"), F.octet_length(payload).alias("n"))
    ids = ids.where(F.col("n") >= min_bytes).select("page_id", "digest")
    last = ids.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    return ids.join(last, "digest").where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).distinct()


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, level: int = 3) -> DataFrame:
    """Writes a record per row of pages (page_id, url, html); returns the manifest of archives.

    Each attempt of a task writes files of its own and names them in the manifest only as it ends:
    a repeated or a lost task leaves no record twice. Call it once and keep what it returns.
    Null html is an empty payload. Rows that share both page_id and payload are all of one type.
    """
    pages = pages.select("page_id", "url", "html", F.sha1(F.coalesce(F.encode("html", "UTF-8"), F.lit(b""))).alias("digest"))
    refs = revisits(pages, min_bytes).select(F.col("page_id").alias("page"), F.col("digest").alias("same"), "refers_to")
    rows = pages.join(refs, F.col("page_id").eqNullSafe(F.col("page")) & (F.col("digest") == F.col("same")), "left").select("page_id", "url", "html", "refers_to")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        done, out, path, n = [], None, "", 0
        for batch in batches:
            for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    path, n = f"{root}/{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(path, compression=None)
                out.write(gzip_member(record(page_id, url, (html or "").encode(), refers_to), level))
                n += 1
                if out.tell() >= ARCHIVE_BYTES:
                    done.append((path, n, out.tell()))
                    out.close()
                    out = None
        if out is not None:
            done.append((path, n, out.tell()))
            out.close()
        yield common.to_batch(done, to_arrow_schema(MANIFEST))

    return common.written(rows.mapInArrow(write, MANIFEST), "warc-manifest")


def gzip_member(data: bytes, level: int) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response, or a revisit that keeps the response's HTTP header and leaves its payload out."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block += payload if refers_to is None else b""
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}"),
        ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if url is not None:
        fields.append(("WARC-Target-URI", re.sub(r"[\r\n]", lambda m: f"%{ord(m[0]):02X}", url)))
    if refers_to is not None:
        fields += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", PROFILE)]
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return f"WARC/1.1\r\n{head}\r\n".encode() + block + b"\r\n\r\n"


class Member:
    """The bytes of one gzip member, inflated as they are asked for."""

    def __init__(self, file, rest: bytes):
        self.file, self.rest, self.z, self.ready = file, rest, zlib.decompressobj(31), b""

    def more(self) -> bool:
        """Inflates up to CHUNK bytes; False at the end of the member."""
        while not self.z.eof:
            data = self.z.unconsumed_tail or self.rest or self.file.read(CHUNK)
            if not data:
                raise EOFError("the member is cut off")
            if data is self.rest:
                self.rest = b""
            got = self.z.decompress(data, CHUNK)
            if self.z.eof:
                self.rest = self.z.unused_data + (self.rest if data is not self.rest else b"")
            if got:
                self.ready += got
                return True
        return False

    def until(self, mark: bytes) -> bytes:
        while (at := self.ready.find(mark)) < 0:
            if not self.more():
                raise EOFError("the header has no end")
        got, self.ready = self.ready[:at], self.ready[at + len(mark) :]
        return got

    def pieces(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.ready and not self.more():
                raise EOFError("the block is shorter than its Content-Length")
            piece, self.ready = self.ready[:n], self.ready[n:]
            n -= len(piece)
            yield piece


def header(raw: bytes) -> dict[str, str]:
    lines = raw.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def read_records(file, keep_payload: bool = False) -> Iterator[tuple]:
    """RECORD's fields of each member of an archive, then its payload if wanted.

    Only a chunk of the block is held unless the payload is kept. A record whose framing or
    digests don't hold has the reason in `error`; a broken member ends the archive.
    """
    rest = file.read(CHUNK)
    while rest:
        member = Member(file, rest)
        try:
            found = read_record(member, keep_payload)
            while member.more():  # to the end of the member
                pass
            if member.ready != b"\r\n\r\n" and not found[6]:
                found = (*found[:6], "the record doesn't end after its block", *found[7:])
        except (EOFError, zlib.error, KeyError, ValueError) as e:
            yield (None, None, None, None, None, None, f"{type(e).__name__}: {e}", *[None] * keep_payload)
            return
        yield found
        rest = member.rest or file.read(CHUNK)


def read_record(member: Member, keep_payload: bool) -> tuple:
    fields = header(member.until(b"\r\n\r\n"))
    left = int(fields["content-length"])
    whole, body, head, n, kept = hashlib.sha1(), hashlib.sha1(), b"", -1, []
    for piece in member.pieces(left):
        whole.update(piece)
        if n < 0:
            head += piece
            if (at := head.find(b"\r\n\r\n")) < 0:
                continue
            head, piece, n = head[:at], head[at + 4 :], 0
        body.update(piece)
        n += len(piece)
        if keep_payload:
            kept.append(piece)
    digest, http = fields["warc-payload-digest"].removeprefix("sha1:"), header(head)
    as_digest = lambda h: base64.b32encode(h.digest()).decode()
    error, revisit = None, fields["warc-type"] == "revisit"
    if as_digest(whole) != fields["warc-block-digest"].removeprefix("sha1:"):
        error = "block digest differs"
    elif not revisit and as_digest(body) != digest:
        error = "payload digest differs"
    elif not revisit and n != int(http["content-length"]):
        error = "payload length differs"
    id_of = lambda k: int(m[1]) if (m := re.search(r"urn:page:(-?\d+)>", fields.get(k, ""))) else None
    found = (id_of("warc-record-id"), int(http["content-length"]), digest, fields["warc-type"], id_of("warc-refers-to"), fields.get("warc-target-uri"), error)
    return (*found, b"".join(kept)) if keep_payload else found


def read_archives(manifest: DataFrame, keep_payload: bool = False) -> DataFrame:
    """The records of the archives in manifest (path), an archive at a time in each task."""
    schema = RECORD_WITH_PAYLOAD if keep_payload else RECORD
    root = common.shared_dir(manifest.sparkSession)

    def rows(batch: pa.RecordBatch) -> Iterator[tuple]:
        store, _ = fs.FileSystem.from_uri(root)
        for path in batch.column(0).to_pylist():
            with store.open_input_stream(path, compression=None) as file:
                yield from read_records(file, keep_payload)

    weigh = (lambda r: 200 + len(r[-1] or b"")) if keep_payload else (lambda r: 200)
    return common.map_rows(manifest.select("path"), schema, rows, weigh)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record per page, written to archives in the shared folder and read back."""
    manifest = write_archives(common.table(spark, sf_dir, "pages"), common.new_path(spark, "warc"))
    n = max(1, manifest.count())
    return read_archives(manifest.repartition(n)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", F.col("error").isNull().alias("verified"))


#: The base32 digits are cut from five hex digits (20 bits) at a time.
OP1_SQL = """
WITH p AS (
  SELECT page_id, url, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hex FROM pages
), d AS (
  SELECT *, list_transform(range(8), lambda i: ('0x' || substr(hex, i * 5 + 1, 5))::INTEGER) AS n20, max(page_id) OVER (PARTITION BY body) AS last_id FROM p
)
SELECT page_id, octet_length(encode(body))::BIGINT AS payload_bytes,
  list_aggregate(list_transform(n20, lambda n: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((n >> 15) & 31) + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((n >> 10) & 31) + 1, 1)
    || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((n >> 5) & 31) + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (n & 31) + 1, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = last_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> last_id THEN last_id END AS refers_to, url, TRUE AS verified
FROM d
"""
