"""WARC archives: a record per page, one gzip member per record, read back sequentially.

Writing: pages are grouped by payload digest; of equal payloads of at least `min_revisit` bytes the one with
the largest page_id is the response and the others become revisit records without a body. Reading: one pass
over each file, inflating member by member, framing by Content-Length, checking every stored digest.

Cases: a null html is an empty payload. Null or repeated page_ids are written like any other; rows that repeat
the responding page_id with the same payload are responses too. A group whose page_ids are all null has no
response to point to, so its records are all responses. No pages: no files, no rows.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import storage
from tidemark.session import shared_dir, ship_package, written

VERSION = b"WARC/1.1"
#: A file is closed after this many bytes of records.
ROLL_BYTES = 128 << 20
READ_SCHEMA = (
    "page_id long, url string, payload_bytes long, payload_digest string, record_type string, "
    "refers_to long, payload binary, file string, member_offset long"
)


class WarcError(ValueError):
    """The bytes are not a well-formed archive, or a digest differs."""


def _urn(page_id: int | None) -> str:
    return "<urn:page:null>" if page_id is None else f"<urn:page:{page_id}>"


def _page_id(urn: str) -> int | None:
    value = urn.removeprefix("<urn:page:").removesuffix(">")
    return None if value == "null" else int(value)


def make_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """Header block, blank line, body and the two line ends that close a record."""
    body = b"" if revisit else payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", _urn(page_id)),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()),
        ("X-Payload-Length", str(len(payload))),
        ("Content-Type", "text/html; charset=utf-8"),
        ("Content-Length", str(len(body))),
    ]
    if url is not None:
        fields.append(("WARC-Target-URI", "".join(c if c >= " " else f"%{ord(c):02X}" for c in url)))
    if revisit:
        fields += [("WARC-Refers-To", _urn(refers_to)), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    head = VERSION + b"\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in fields)
    return head + b"\r\n" + body + b"\r\n\r\n"


def gzip_member(record: bytes, level: int = 6) -> bytes:
    """The record as one complete gzip member."""
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(record) + packer.flush()


def members(stream, chunk: int = 1 << 18) -> Iterator[tuple[int, bytes]]:
    """(offset, inflated bytes) of each gzip member of a stream, read chunk by chunk."""
    at, start, left = 0, 0, b""
    inflater, parts = None, []
    while True:
        data = left or stream.read(chunk)
        left = b""
        if not data:
            break
        if inflater is None:
            inflater, parts, start = zlib.decompressobj(31), [], at
        parts.append(inflater.decompress(data))
        left = inflater.unused_data
        at += len(data) - len(left)
        if inflater.eof:
            yield start, b"".join(parts)
            inflater = None
    if inflater is not None:
        raise WarcError(f"the member at byte {start} is cut off")


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and body; the frame must be exactly what Content-Length says."""
    head, gap, rest = record.partition(b"\r\n\r\n")
    first, _, lines = head.partition(b"\r\n")
    if not gap or first != VERSION:
        raise WarcError("no WARC header")
    fields = dict(line.split(": ", 1) for line in lines.decode().split("\r\n"))
    length = int(fields["Content-Length"])
    if rest[length:] != b"\r\n\r\n":
        raise WarcError(f"{fields.get('WARC-Record-ID')}: the record does not end after Content-Length")
    return fields, rest[:length]


def read_record(record: bytes) -> dict:
    """One row of READ_SCHEMA, without the file and its offset; checks the digest of every body."""
    fields, body = parse_record(record)
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and (hashlib.sha1(body).hexdigest() != digest or len(body) != int(fields["X-Payload-Length"])):
        raise WarcError(f"{fields['WARC-Record-ID']}: the payload does not have its digest")
    return {
        "page_id": _page_id(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"),
        "payload_bytes": int(fields["X-Payload-Length"]), "payload_digest": digest,
        "record_type": fields["WARC-Type"], "refers_to": _page_id(fields["WARC-Refers-To"]) if revisit else None,
        "payload": None if revisit else body,
    }


def with_revisits(pages: DataFrame, min_revisit: int = 1000) -> DataFrame:
    """page_id, url, payload, digest, refers_to and revisit of every page.

    The largest page_id of each digest comes from a partially aggregated group; digests that occur once are left
    out of the join, and the join's hot digests are left to AQE's skew handling.
    """
    rows = pages.select("page_id", "url", F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    long = F.octet_length("payload") >= min_revisit
    most = (
        rows.where(long).groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("copies"))
        .where("copies > 1 AND refers_to IS NOT NULL").select(F.col("digest").alias("of"), "refers_to")
    )
    revisit = F.col("refers_to").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("refers_to"))
    return (
        rows.join(most, (rows.digest == most.of) & long, "left").withColumn("revisit", revisit)
        .withColumn("refers_to", F.when(F.col("revisit"), F.col("refers_to"))).drop("of")
    )


def write_archives(pages: DataFrame, folder: str, min_revisit: int = 1000, level: int = 6) -> DataFrame:
    """Writes <folder>/*.warc.gz, a file or more for each partition; returns the manifest (file, n_records)."""
    ship_package(pages.sparkSession)

    def write(batches):
        stem = f"{TaskContext.get().partitionId():06d}"
        batches = (b for b in batches if b.num_rows)
        batch = next(batches, None)
        while batch is not None:
            done = size = 0
            with storage.new_file(folder, stem, ".warc.gz") as (out, uri):
                while batch is not None and size < ROLL_BYTES:
                    columns = [batch.column(i) for i in range(batch.num_columns)]
                    for i in range(batch.num_rows):
                        page_id, url, payload, digest, refers_to, revisit = (c[i].as_py() for c in columns)
                        record = make_record(page_id, url, payload, digest, refers_to, revisit)
                        size += out.write(gzip_member(record, level)) or len(record)
                    done += batch.num_rows
                    batch = next(batches, None)
            yield pa.RecordBatch.from_pydict({"file": [uri], "n_records": [done]})

    rows = with_revisits(pages, min_revisit).select("page_id", "url", "payload", "digest", "refers_to", "revisit")
    return written(rows, write, "file string, n_records long", "warc-manifest")


def read_archives(manifest: DataFrame) -> DataFrame:
    """Every record of the files in the manifest, a row each (READ_SCHEMA)."""
    ship_package(manifest.sparkSession)
    n = max(1, manifest.count())
    schema = pa.schema([
        ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
        ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("file", pa.string()), ("member_offset", pa.int64()),
    ])

    def read(batches):
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                rows, size = [], 0
                with storage.read_stream(uri) as stream:
                    for offset, record in members(stream):
                        rows.append(read_record(record) | {"file": uri, "member_offset": offset})
                        size += len(record)
                        if size > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return manifest.select("file").repartition(min(n, 4096)).mapInArrow(read, READ_SCHEMA)


def archive(pages: DataFrame, min_revisit: int = 1000) -> DataFrame:
    """Write the pages to archives in the shared folder and read those back."""
    return read_archives(write_archives(pages, shared_dir(pages.sparkSession, "warc"), min_revisit))
