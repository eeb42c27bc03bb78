"""WARC archives: one gzip member per record, written by the tasks and read back in sequence.

The reader inflates piece by piece, frames each record by its content length and checks its digests, so it holds a
piece of a record at a time however long the record is.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchloom.llm.common import pieces, read_table, scratch, written

#: Bytes of an archive that are read and inflated at a time.
PIECE = 1 << 16
#: Payloads below this length are always stored.
LEAST_REVISIT = 1000
DATE = "2024-01-01T00:00:00Z"


def sha1_label(payload: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _name(page_id: int | None) -> str:
    return "<urn:page:none>" if page_id is None else f"<urn:page:{page_id}>"


def _number(name: str) -> int | None:
    tail = name.strip("<>").rpartition(":")[2]
    return None if tail == "none" else int(tail)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One record as a gzip member; a revisit has the HTTP headers of its response but not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_name(page_id)}", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {' '.join((url or '').split())}", f"WARC-Payload-Digest: {sha1_label(payload)}", f"WARC-Block-Digest: {sha1_label(block)}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_name(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + block + b"\r\n\r\n") + pack.flush()


@dataclass
class Record:
    """Headers of a record, the HTTP content length, and what the digests of the bytes read say."""

    headers: dict[str, str]
    payload_bytes: int = 0
    verified: bool = False
    payload: bytearray | None = field(default=None, repr=False)


class _Member:
    """One gzip member as it inflates: header lines first, then a block of the length they name."""

    def __init__(self, keep: bool):
        self.head, self.keep = bytearray(), keep
        self.found: Record | None = None
        self.left, self.http, self.tail = 0, bytearray(), bytearray()
        self.block, self.body, self.in_body, self.body_bytes = hashlib.sha1(), hashlib.sha1(), False, 0

    def feed(self, data: bytes) -> None:
        if self.found is None:
            self.head += data
            end = self.head.find(b"\r\n\r\n")
            if end < 0:
                return
            first, *lines = bytes(self.head[:end]).decode().split("\r\n")
            if not first.startswith("WARC/"):
                raise ValueError(f"not a WARC record: {first[:40]!r}")
            self.found = Record({k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}, payload=bytearray() if self.keep else None)
            self.left = int(self.found.headers["content-length"])
            data, self.head = bytes(self.head[end + 4 :]), bytearray()
        data, rest = data[: self.left], data[self.left :]
        self.left -= len(data)
        self.block.update(data)
        self.tail += rest
        if not self.in_body:
            self.http += data
            end = self.http.find(b"\r\n\r\n")
            if end < 0:
                return
            fields = dict(x.split(b": ", 1) for x in bytes(self.http[:end]).split(b"\r\n")[1:])
            self.found.payload_bytes = int(fields[b"Content-Length"])
            self.in_body, data = True, bytes(self.http[end + 4 :])
        self.body.update(data)
        self.body_bytes += len(data)
        if self.keep:
            self.found.payload += data

    def close(self) -> Record:
        if self.found is None or self.left or self.tail != b"\r\n\r\n":
            raise ValueError("a record ends before its content length or goes on after it")
        headers, label = self.found.headers, lambda h: "sha1:" + base64.b32encode(h.digest()).decode()
        good = headers["warc-block-digest"] == label(self.block)
        if headers["warc-type"] == "response":
            good = good and headers["warc-payload-digest"] == label(self.body) and self.body_bytes == self.found.payload_bytes
        self.found.verified = good
        return self.found


def read_archive(stream, keep_payload: bool = False) -> Iterator[Record]:
    """The records of an archive, in order; the archive and every record are read in pieces."""
    inflate, member, data = zlib.decompressobj(31), None, b""
    while True:
        data = data or stream.read(PIECE)
        if not data:
            break
        member = member or _Member(keep_payload)
        member.feed(inflate.decompress(data, PIECE))
        if inflate.eof:
            yield member.close()
            data, member, inflate = inflate.unused_data, None, zlib.decompressobj(31)
        else:
            data = inflate.unconsumed_tail
    if member is not None:
        raise ValueError("the archive ends inside a record")


def revisits(pages: DataFrame, least_bytes: int = LEAST_REVISIT, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """page_id and payload hash of the rows that repeat another row's payload, with the largest such id as refers_to.

    Payloads are compared by SHA-256 and length; a group, however large, is one row per task when it is shuffled.
    """
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("page_id"), F.sha2(html, 256).alias("hash"), F.octet_length(html).alias("bytes")).where(F.col("bytes") >= least_bytes)
    groups = rows.groupBy("hash", "bytes").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return rows.join(groups, ["hash", "bytes"]).where("not page_id <=> refers_to").select("page_id", "hash", "refers_to").distinct()


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write every row as a record into archives in a shared folder; returns the manifest (path, records, bytes).

    Every task attempt writes an archive of its own name, and only those in the manifest count. Null html is an empty
    payload and a null url an empty one. Of rows with equal payloads of at least 1000 bytes that with the largest id
    is the response; rows that repeat its id are responses too, and rows without an id count as revisits where a row
    with one exists. Other columns are ignored; a table without rows gives an empty manifest.
    """
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), html.alias("html"), F.sha2(html, 256).alias("hash"))
    again = revisits(pages, id_col=id_col, html_col=html_col).select(F.col("page_id").cast("long").alias("again"), F.col("hash").alias("_hash"), "refers_to")
    marked = rows.join(again, F.col("page_id").eqNullSafe(F.col("again")) & (F.col("hash") == F.col("_hash")), "left")
    marked = marked.select("page_id", "url", "html", F.col("refers_to").cast("long").alias("refers_to"), F.col("_hash").isNotNull().alias("revisit"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, n = None, 0
        for batch in batches:
            for part in pieces(batch, "html"):
                if out is None:
                    system, base = fs.FileSystem.from_uri(folder)
                    system.create_dir(base, recursive=True)
                    path = f"{base}/{uuid.uuid4().hex}.warc.gz"
                    out = system.open_output_stream(path, compression=None)
                for row in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    page_id, url, text, refers_to, revisit = row
                    out.write(record(page_id, url, text.encode(), refers_to, revisit))
                    n += 1
        if out is not None:
            size = out.tell()
            out.close()
            yield pa.RecordBatch.from_pylist([{"path": path, "records": n, "bytes": size}])

    return written(marked.mapInArrow(write, "path string, records long, bytes long"), "warc-manifest")


def read_archives(manifest: DataFrame, folder: str, keep_payload: bool = False) -> DataFrame:
    """One row per record: page_id, target_uri, record_type, refers_to, payload_bytes, payload_digest, verified[, payload].

    ``payload_digest`` is the SHA-1 of the full payload in lower-case hex. A record whose bytes don't match its
    digests has verified = false; broken framing is an error. Each archive is one task's sequential read.
    """
    schema = "page_id long, target_uri string, record_type string, refers_to long, payload_bytes long, payload_digest string, verified boolean" + ", payload binary" * keep_payload

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, held = [], 0
                with system.open_input_stream(path, compression=None) as stream:
                    for r in read_archive(stream, keep_payload):
                        h = r.headers
                        rows.append({
                            "page_id": _number(h["warc-record-id"]), "target_uri": h["warc-target-uri"], "record_type": h["warc-type"],
                            "refers_to": _number(h["warc-refers-to"]) if "warc-refers-to" in h else None, "payload_bytes": r.payload_bytes,
                            "payload_digest": base64.b32decode(h["warc-payload-digest"][5:]).hex(), "verified": r.verified,
                        } | ({"payload": bytes(r.payload)} if keep_payload else {}))
                        held += r.payload_bytes * keep_payload
                        if len(rows) >= 5000 or held > 1 << 22:
                            yield pa.RecordBatch.from_pylist(rows, shape)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, shape)

    kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}
    shape = pa.schema([(n, kinds[k]) for n, k in (c.split() for c in schema.split(", "))])
    return manifest.select("path").repartition(max(1, manifest.count())).mapInArrow(read, schema)


def op2_warc(spark, sf_dir: str) -> DataFrame:
    """All pages through the archives and back; a record that fails its digests would stop the query."""
    folder = scratch(spark, "warc")
    manifest = write_archives(read_table(spark, sf_dir, "pages"), folder)
    sound = F.when(F.col("verified"), F.col("payload_digest")).otherwise(F.raise_error(F.concat(F.lit("damaged record of page "), F.col("page_id").cast("string"))))
    return read_archives(manifest, folder).select("page_id", "payload_bytes", sound.alias("payload_digest"), "record_type", "refers_to")


OP2_SQL = """
with p as (select page_id, coalesce(html, '') as html from pages),
q as (select *, octet_length(encode(html)) as n, max(page_id) over (partition by html) as last from p)
select page_id, n as payload_bytes, sha1(html) as payload_digest,
       case when n >= 1000 and page_id is distinct from last then 'revisit' else 'response' end as record_type,
       case when n >= 1000 and page_id is distinct from last then last end as refers_to
from q
"""
