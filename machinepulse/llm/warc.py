"""WARC archives: one gzip member per record, written and read back.

The writer makes one or more archives per task in the shared folder. A file's
name is new for each attempt of a task, and only the files that a finished
attempt lists in the manifest are read, so a lost executor leaves nothing half
written behind that counts. The reader goes through an archive once, inflating
bit by bit, framing blocks by their content length and checking both digests.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from machinepulse.llm.common import bounded_batches, scratch, stored

_CHUNK = 1 << 20
_BATCH_BYTES = 16 << 20
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
# Records are written for a crawl of this date; a clock would make a repeated
# attempt differ from the first.
_DATE = "2024-01-01T00:00:00Z"

RECORDS = (
    "record_id string, record_type string, target_uri string, payload binary, "
    "payload_bytes long, payload_digest string, refers_to string"
)


class DigestError(ValueError):
    """A record does not hold what its header says."""


@dataclass
class Record:
    """payload is None for a revisit; payload_bytes and digest are of the full payload."""

    record_id: str
    record_type: str
    target_uri: str | None
    payload: bytes | None
    payload_bytes: int
    payload_digest: str
    refers_to: str | None = None
    headers: dict[str, str] = field(default_factory=dict)


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def serialize(record: Record) -> bytes:
    """The record as one gzip member."""
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {record.payload_bytes}\r\n\r\n"
    ).encode()
    block = http + (record.payload or b"")
    head = [
        ("WARC-Type", record.record_type),
        ("WARC-Record-ID", f"<{record.record_id}>"),
        ("WARC-Date", _DATE),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Block-Digest", f"sha1:{sha1_base32(block)}"),
        ("WARC-Payload-Digest", f"sha1:{record.payload_digest}"),
    ]
    if record.target_uri is not None:
        # A line break would end the field.
        head.append(("WARC-Target-URI", re.sub(r"[\r\n]+", "%0A", record.target_uri)))
    if record.record_type == "revisit":
        head.append(("WARC-Profile", _PROFILE))
        if record.refers_to is not None:
            head.append(("WARC-Refers-To", f"<{record.refers_to}>"))
    head.append(("Content-Length", str(len(block))))
    lines = "".join(f"{name}: {value}\r\n" for name, value in head)
    data = f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress(data) + squeeze.flush()


def records(source: io.RawIOBase, chunk: int = _CHUNK) -> Iterator[Record]:
    """Read an archive from its start to its end.

    Holds one chunk and the record at hand. Raises DigestError or ValueError
    for records that are cut short, framed wrongly or changed.
    """
    pending, ended = b"", False
    while True:
        member, inflate = [], zlib.decompressobj(31)
        while not inflate.eof:
            if not pending and not ended:
                pending = source.read(chunk)
                ended = not pending
            if not pending:
                if member or inflate.unconsumed_tail:
                    raise ValueError("the last record is cut short")
                return
            part = inflate.decompress(pending, chunk)
            pending = inflate.unused_data if inflate.eof else inflate.unconsumed_tail
            member.append(part)
        yield _parse(b"".join(member))


def _fields(raw: bytes) -> tuple[str, dict[str, str]]:
    first, *lines = raw.decode("utf-8").split("\r\n")
    return first, {n.strip().lower(): v.strip() for n, _, v in (x.partition(":") for x in lines)}


def _parse(data: bytes) -> Record:
    head, found, rest = data.partition(b"\r\n\r\n")
    version, headers = _fields(head)
    if not found or not version.startswith("WARC/"):
        raise ValueError("a member does not begin with a WARC header")
    length = int(headers["content-length"])
    if rest[length:] != b"\r\n\r\n":
        raise ValueError("the content length does not frame the block")
    block = rest[:length]
    _verify(headers["warc-block-digest"], block)
    http, _, payload = block.partition(b"\r\n\r\n")
    kind = headers["warc-type"]
    digest = headers["warc-payload-digest"]
    size = int(_fields(http)[1]["content-length"])
    if kind == "response":
        _verify(digest, payload)
        if size != len(payload):
            raise ValueError("the payload is not as long as it should be")
    refers_to = headers.get("warc-refers-to")
    return Record(
        headers["warc-record-id"].strip("<>"),
        kind,
        headers.get("warc-target-uri"),
        payload if kind == "response" else None,
        size,
        digest.removeprefix("sha1:"),
        refers_to.strip("<>") if refers_to else None,
        headers,
    )


def _verify(digest: str, data: bytes) -> None:
    if digest != f"sha1:{sha1_base32(data)}":
        raise DigestError(f"a digest does not match: {digest}")


def write_archives(
    pages: DataFrame, folder: str | None = None, least_bytes: int = 0, archive_bytes: int = 1 << 30
) -> DataFrame:
    """Write a record per row of pages; returns the manifest (path, n_records, n_bytes).

    Of rows with equal payloads of at least least_bytes, the one with the
    smallest page_id (nulls last) is a response and the others revisit it; of
    rows that repeat page_id and payload one counts as the first. Shorter
    payloads are all responses. The payload is the html in UTF-8, null counting
    as empty. A task begins a new archive after archive_bytes. Other columns
    are not looked at; an empty table gives no archive.
    """
    spark = bounded_batches(pages.sparkSession)
    folder = folder or scratch(spark, "warc")
    rows = pages.select(
        "page_id", "url", F.coalesce("html", F.lit("")).alias("html")
    ).withColumn("sha1", F.sha1("html"))
    # A key without nulls, so that the join and the window below share one shuffle.
    rows = rows.withColumn("page_key", F.coalesce(F.col("page_id").cast("string"), F.lit("")))
    light = rows.where(F.octet_length("html") >= least_bytes).select("page_id", "page_key", "sha1")
    first = light.groupBy("sha1").agg(F.min("page_id").alias("first"))
    # Decided on rows without payload, then joined by page, so that a payload
    # that a third of all pages share is never gathered.
    decided = light.distinct().join(first, "sha1").select(
        "page_key", "sha1", "first", F.lit(True).alias("is_long")
    )
    same = Window.partitionBy("page_key", "sha1").orderBy("url")
    records_ = (
        rows.join(decided, ["page_key", "sha1"], "left")
        .withColumn("copy", F.row_number().over(same))
        .select(
            "page_id",
            "url",
            "html",
            "copy",
            "first",
            (
                F.col("is_long").isNull()
                | (F.col("page_id").eqNullSafe(F.col("first")) & (F.col("copy") == 1))
            ).alias("is_response"),
        )
    )
    return stored(
        records_.mapInArrow(
            _writer(folder, archive_bytes), "path string, n_records long, n_bytes long"
        ),
        "manifest",
    )


def _record_id(page_id: int | None, copy: int) -> str:
    return f"urn:page:{'' if page_id is None else page_id}" + (f":{copy}" if copy > 1 else "")


def _writer(folder: str, most: int) -> Callable:
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = arrow_fs.FileSystem.from_uri(folder)
        out, path, count, size = None, None, 0, 0

        def finished() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pylist(
                [{"path": path, "n_records": count, "n_bytes": size}],
                pa.schema([("path", pa.string()), ("n_records", pa.int64()), ("n_bytes", pa.int64())]),
            )

        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    store.create_dir(root, recursive=True)
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    path, count, size = f"{folder}/{name}", 0, 0
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                payload = row["html"].encode("utf-8")
                data = serialize(
                    Record(
                        _record_id(row["page_id"], row["copy"]),
                        "response" if row["is_response"] else "revisit",
                        row["url"],
                        payload if row["is_response"] else None,
                        len(payload),
                        sha1_base32(payload),
                        None if row["is_response"] else _record_id(row["first"], 1),
                    )
                )
                out.write(data)
                count, size = count + 1, size + len(data)
                if size >= most:
                    yield finished()
                    out = None
        if out is not None:
            yield finished()

    return write


def read_archives(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """Every record of the archives in the manifest's path column, one task per archive at most.

    An archive that holds another number of records than the manifest says
    fails the job.
    """
    files = manifest.select("path", "n_records")
    return files.repartition(max(1, files.count())).mapInArrow(_read, RECORDS)


_SCHEMA = pa.schema(
    [
        ("record_id", pa.string()),
        ("record_type", pa.string()),
        ("target_uri", pa.string()),
        ("payload", pa.binary()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("refers_to", pa.string()),
    ]
)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            store, path = arrow_fs.FileSystem.from_uri(row["path"])
            rows, held, count = [], 0, 0
            with store.open_input_stream(path, compression=None) as source:
                for record in records(source):
                    count += 1
                    rows.append({name: getattr(record, name) for name in _SCHEMA.names})
                    held += len(record.payload or b"") + 200
                    if held >= _BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, _SCHEMA)
                        rows, held = [], 0
            if count != row["n_records"]:
                raise ValueError(f"{path} has {count} records, not {row['n_records']}")
            if rows:
                yield pa.RecordBatch.from_pylist(rows, _SCHEMA)
