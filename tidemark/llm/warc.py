"""WARC archives: a gzip member per record, written by tasks and read in sequence."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import files
from tidemark.llm.common import column, staged
from tidemark.plans.session import shared_dir

# Fixed values of the format.
VERSION = b"WARC/1.1"
CRLF = b"\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"

ARCHIVE_BYTES = 64 * 1024 * 1024  # an archive is closed beyond this size
READ_BYTES = 64 * 1024  # compressed bytes read at once
GZIP = 16 + zlib.MAX_WBITS


def digest(payload: bytes) -> str:
    """Upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, fields: list[tuple[str, str]], payload: bytes) -> bytes:
    """A record as one gzip member: version, header fields, blank line, content and two line ends."""
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", DATE)]
    lines = [VERSION, *(f"{k}: {v}".encode() for k, v in [*head, *fields, ("Content-Length", str(len(payload)))])]
    packer = zlib.compressobj(6, zlib.DEFLATED, GZIP)
    raw = CRLF.join(lines) + CRLF + CRLF + payload + CRLF + CRLF
    return packer.compress(raw) + packer.flush()


def safe(value: str | None) -> str:
    """A header value on one line."""
    return " ".join((value or "").split())


class Members:
    """Bytes of a stream of gzip members, decompressed bit by bit; ends are told apart."""

    def __init__(self, stream):
        self.stream, self.rest, self.over = stream, b"", False

    def chunks(self) -> Iterator[bytes]:
        """The chunks of the next member; none at the end of the file."""
        unpack = zlib.decompressobj(GZIP)
        begun = False
        while not unpack.eof:
            if not self.rest:
                self.rest = self.stream.read(READ_BYTES)
            if not self.rest:
                if begun:
                    raise ValueError("the archive ends within a record")
                self.over = True
                return
            begun = True
            yield unpack.decompress(self.rest, READ_BYTES)
            self.rest = unpack.unconsumed_tail or unpack.unused_data
        self.rest = unpack.unused_data


def read_records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields in lower case, content) of each record of an archive, in order.

    Content is framed by its length; a record that is longer or shorter, or whose payload does not
    have the digest that its header names, is an error.
    """
    members = Members(stream)
    while True:
        buffer = bytearray()
        for chunk in members.chunks():
            buffer += chunk
        if members.over:
            return
        head, found, _ = bytes(buffer[: buffer.find(CRLF + CRLF) + 4]).partition(CRLF + CRLF)
        lines = head.split(CRLF)
        if not found or not lines[0].startswith(b"WARC/"):
            raise ValueError("no WARC record")
        fields = {}
        for line in lines[1:]:
            name, _, value = line.decode().partition(":")
            fields[name.strip().lower()] = value.strip()
        size, begin = int(fields["content-length"]), len(head) + 4
        if len(buffer) != begin + size + 4 or buffer[begin + size :] != CRLF + CRLF:
            raise ValueError("a record is not as long as its header says")
        content = bytes(buffer[begin : begin + size])
        named = fields.get("warc-payload-digest", "").rpartition(":")[2]
        if fields["warc-type"] == "response" and named and digest(content) != named:
            raise ValueError("a payload does not have the digest of its header")
        yield fields, content


def write_warc(
    pages: DataFrame,
    folder: str,
    key: str = "page_id",
    url: str = "url",
    payload: str = "html",
    least_bytes: int = 0,
) -> DataFrame:
    """Write a record per row; the list of archives (address, records, bytes).

    Of rows with equal payloads of at least ``least_bytes`` bytes, the one with the largest key is a
    response, the others are revisits that name it; rows that share that largest key with an equal
    payload are all responses. Payload NULL is empty. A row with NULL key refers to the response like any
    other; if all keys are NULL, they are all responses. An empty table gives no archives.

    The largest key per digest is aggregated before the shuffle. The payloads are shuffled once, by
    digest; a digest that very many rows have is a skewed join key, which adaptive execution splits.
    """
    raw = F.coalesce(column(payload).cast("binary"), F.lit(b""))
    rows = pages.select(column(key).cast("long").alias("key"), column(url).cast("string").alias("url"), raw.alias("payload")).withColumn(
        "digest", F.unhex(F.sha1("payload"))
    )
    largest = (
        rows.filter(F.octet_length("payload") >= least_bytes).filter("key IS NOT NULL")
        .groupBy("digest").agg(F.max("key").alias("largest"))
    )
    marked = rows.join(largest, "digest", "left").select(
        "key", "url", "payload",
        F.when(F.col("key").eqNullSafe(F.col("largest")), F.lit(None)).otherwise(F.col("largest")).alias("refers_to"),
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        done, stream, address, n, size = [], None, "", 0, 0
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("key", "url", "payload", "refers_to"))
            for name, target, body, refers in zip(*columns, strict=True):
                if stream is None:
                    (address, stream), n, size = files.create(folder, f"pages-{task:06d}"), 0, 0
                fields = [
                    ("WARC-Target-URI", safe(target)), ("WARC-Payload-Digest", f"sha1:{digest(body)}"),
                    ("X-Page-Id", "" if name is None else str(name)), ("X-Payload-Bytes", str(len(body))),
                ]
                if refers is None:
                    member = record("response", fields, body)
                else:
                    fields += [("WARC-Profile", REVISIT_PROFILE), ("X-Refers-To-Page-Id", str(refers))]
                    member = record("revisit", fields, b"")
                stream.write(member)
                n, size = n + 1, size + len(member)
                if size > ARCHIVE_BYTES:
                    stream.close()
                    done.append((address, n, size))
                    stream = None
        if stream is not None:
            stream.close()
            done.append((address, n, size))
        columns = zip(*done, strict=True) if done else ((), (), ())
        kinds = (pa.string(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["address", "records", "bytes"]
        )

    return staged(marked.mapInArrow(write, "address string, records long, bytes long"), "archives")


def read_warc(spark: SparkSession, archives: DataFrame) -> DataFrame:
    """Rows (page_id, url, record_type, payload_digest, payload_bytes, refers_to, payload) of the archives.

    ``payload`` of a revisit is NULL: the bytes are those of the response it refers to.
    """
    kind = (
        "page_id long, url string, record_type string, payload_digest string, payload_bytes long,"
        " refers_to long, payload binary"
    )
    types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
    names = [part.split()[0] for part in kind.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def result(rows: list) -> pa.RecordBatch:
            columns = zip(*rows, strict=True) if rows else [()] * len(types)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

        for batch in batches:
            for address in batch.column("address").to_pylist():
                rows, size = [], 0
                with files.open_stream(address) as stream:
                    for fields, content in read_records(stream):
                        own = fields["warc-type"] == "response"
                        rows.append((
                            int(fields["x-page-id"]) if fields["x-page-id"] else None, fields["warc-target-uri"],
                            fields["warc-type"], fields["warc-payload-digest"].rpartition(":")[2],
                            len(content) if own else int(fields["x-payload-bytes"]),
                            None if own else int(fields["x-refers-to-page-id"]), content if own else None,
                        ))
                        size += len(content)
                        if size > 16 << 20:
                            yield result(rows)
                            rows, size = [], 0
                yield result(rows)

    return archives.select("address").repartition(max(1, archives.count())).mapInArrow(run, kind)


def round_trip(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", least_bytes: int = 0) -> DataFrame:
    """Write the archives of ``pages`` to a new shared folder and read them back."""
    spark = pages.sparkSession
    archives = write_warc(pages, shared_dir(spark, "warc"), key, url, payload, least_bytes)
    return read_warc(spark, archives)
