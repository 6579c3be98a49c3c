"""WARC 1.1 archives compressed record by record with Zstandard and a dictionary of their own.

Each archive starts with a skippable frame that holds a dictionary trained on a sample of its records, then has a
frame for each record. Archives are cells of a Parquet table in the shared folder.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyspark.sql.functions as F
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame

from fieldspark.llm.common import shared_dir

#: Magic number of the skippable frame with the dictionary (fixed value of the format).
DICTIONARY_FRAME = 0x184D2A5D
#: Payloads below this many bytes are never revisits.
LEAST = 100
#: Bytes of records in an archive, about; most pieces that a dictionary is trained on, bytes of a piece; its size.
ARCHIVE_BYTES, SAMPLE_PIECES, PIECE_BYTES, DICTIONARY_BYTES = 16_000_000, 256, 16_384, 65_536
ARCHIVES = "archive string, n_records long, payload binary"
ROWS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def decided(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """``pages`` (page_id, url, html) with digest and ``refers_to``, null for responses.

    Of rows with equal html of ``least`` bytes or more, those with the smallest page_id are responses. A null id
    refers to the smallest one too, unless all are null. Null html is empty. Only digests that occur again are joined,
    counted before the shuffle.
    """
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long"), "url", html.alias("html"), F.sha2(html.cast("binary"), 256).alias("digest"), (F.octet_length(html) >= least).alias("large"))
    first = rows.where("large").groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    again = F.col("large") & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return rows.join(first, "digest", "left").select("page_id", "url", "html", "digest", F.when(again, F.col("first")).alias("refers_to"))


def _urn(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}:{digest}')}>"


def record(page_id: int | None, url: str | None, html: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """A response record, or a revisit record, whose HTTP head still tells the payload's length."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(html)
    block = http if refers_to is not None else http + html
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_urn(page_id, digest)}", f"WARC-Date: {date}",
        f"WARC-Target-URI: {''.join((url or '').split())}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", f"WARC-Payload-Digest: sha256:{digest}",
    ]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_urn(refers_to, digest)}", f"X-Refers-To-Page: {refers_to}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def archive(records: list[bytes]) -> bytes:
    """Dictionary frame and record frames. Too few or too short records for a dictionary: no dictionary frame.

    The dictionary is trained on a bounded sample of the archive: its records are cut into pieces, and pieces at equal
    distances from the first to the last are taken, so that no part of a long record is passed over.
    """
    where = [(k, at) for k, r in enumerate(records) for at in range(0, len(r), PIECE_BYTES)]
    step = max(1, -(-len(where) // SAMPLE_PIECES))
    try:
        trained = zstandard.train_dictionary(DICTIONARY_BYTES, [records[k][at : at + PIECE_BYTES] for k, at in where[::step]])
        raw = trained.as_bytes()
    except zstandard.ZstdError:
        trained, raw = None, b""
    coder = zstandard.ZstdCompressor(level=3, dict_data=trained)
    start = [struct.pack("<II", DICTIONARY_FRAME, len(raw)), raw] if raw else []
    return b"".join([*start, *map(coder.compress, records)])


def frame_size(data: memoryview) -> int:
    """Bytes of the Zstandard frame at the start of ``data``, from its block headers."""
    at = zstandard.frame_header_size(data)
    while True:
        head = int.from_bytes(data[at : at + 3], "little")
        at += 3 + (1 if head >> 1 & 3 == 1 else head >> 3)
        if head & 1:
            return at + 4 * zstandard.get_frame_parameters(data).has_checksum


def records(payload: bytes) -> Iterator[bytes]:
    """Records of an archive, in order."""
    view = memoryview(payload)
    trained, at = None, 0
    if len(view) >= 8 and struct.unpack_from("<I", view)[0] == DICTIONARY_FRAME:
        size = struct.unpack_from("<I", view, 4)[0]
        trained, at = zstandard.ZstdCompressionDict(bytes(view[8 : 8 + size])), 8 + size
    coder = zstandard.ZstdDecompressor(dict_data=trained)
    while at < len(view):
        size = frame_size(view[at:])
        yield coder.decompress(view[at : at + size])
        at += size


def parsed(raw: bytes) -> tuple[int | None, int, str, str, int | None]:
    """page_id, payload bytes, digest, type and refers_to of a record; a response's payload must match its digest."""
    head, _, block = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    http, _, body = block[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    size = int(http.rsplit(b"Content-Length: ", 1)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if fields["WARC-Type"] == "response" and (len(body) != size or hashlib.sha256(body).hexdigest() != digest):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    page, refers = fields.get("X-Page-Id"), fields.get("X-Refers-To-Page")
    return page and int(page), size, digest, fields["WARC-Type"], refers and int(refers)


def write_archives(pages: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z") -> None:
    """Writes ``decided`` pages to a table of archives at ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k, held, size = TaskContext.get().partitionId(), 0, [], 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"archive": [f"{part:06d}-{k:06d}.warc.zst"], "n_records": [len(held)], "payload": pa.array([archive(held)], pa.binary())})

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to"))):
                held.append(record(*row, date))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield flush()
                    k, held, size = k + 1, [], 0
        if held:
            yield flush()

    decided(pages).withColumn("html", F.col("html").cast("binary")).mapInArrow(run, ARCHIVES).write.option("compression", "uncompressed").parquet(path)


def read_archives(archives: DataFrame) -> DataFrame:
    """One row for each record: page_id, payload_bytes, payload_digest, record_type, refers_to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
        for batch in batches:
            for payload in batch.column("payload"):
                cols = list(zip(*map(parsed, records(payload.as_py())))) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[c.split()[0] for c in ROWS.split(", ")])

    return archives.select("payload").mapInArrow(run, ROWS)


def archive_pages(pages: DataFrame) -> DataFrame:
    """Digest of ``pages``, from their archives read back. An empty table has no rows."""
    spark = pages.sparkSession
    path = shared_dir(spark, "warc")
    write_archives(pages, path)
    return read_archives(spark.read.schema(ARCHIVES).parquet(path))
