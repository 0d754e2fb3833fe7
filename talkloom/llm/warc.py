"""WARC archives: a deterministic sharded writer, and a reader.

Records are range-sorted by page id. A task writes the records of its range into gzip
files, one member per record, and starts the next file when the compressed size passes
``file_bytes``. Record ids and dates come from the rows and a parameter, and digests are computed anew, so
that a second run, or a second attempt of a task, leaves the same bytes. A file is
written under a temporary name and renamed when it is complete; the manifest, a Parquet
table written by Spark from what the tasks report, names the files that count.

Of records with equal payloads of at least ``LEAST_REVISIT`` bytes, the one with the
largest page id is a response and the others are revisits that carry no payload. Which
is which comes from ids and digests alone; those marks are sorted together with the
records, so that the payloads are shuffled once.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkloom.llm.native import text_of
from talkloom.llm.stores import committed, filesystem
from talkloom.sources.scratch import written

LEAST_REVISIT = 1000
FILE_BYTES = 64 << 20
#: Compressed bytes that one task reads back, as long as there are files to share out.
TASK_BYTES = 128 << 20
DATE = "2024-01-01T00:00:00Z"
_BLOCK = 1 << 16
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _safe(url: str | None) -> str:
    """A header value has no line ends."""
    return "".join(c if c > " " else f"%{ord(c):02X}" for c in url or "")


def record_id(page_id: int | None, url: str | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {digest} {url}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One record: WARC headers, HTTP headers and, for a response, the payload."""
    payload_digest = _sha1(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id, url, payload_digest)}",
        f"WARC-Target-URI: {_safe(url)}",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: {payload_digest}",
        f"WARC-Block-Digest: {_sha1(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    if revisit:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"X-Refers-To-Page-Id: {refers_to}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def _writer(folder: str, date: str, file_bytes: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, size, count = TaskContext.get().partitionId(), -1, file_bytes, 0
        context = stream = name = None
        marked: tuple | None = None
        done: list[tuple] = []

        def close() -> None:
            nonlocal context
            if context:
                context.__exit__(None, None, None)
                done.append((name, count, size))
                context = None

        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("page_id", "digest", "kind", "refers_to", "url", "html"))
            for page, digest, kind, refers, url, html in zip(*columns, strict=True):
                if kind == 0:
                    marked = (page, digest, refers)
                    continue
                if size >= file_bytes:
                    close()
                    number, size, count = number + 1, 0, 0
                    name = f"pages-{part:06d}-{number:05d}.warc.gz"
                    context = committed(f"{folder}/{name}")
                    stream = context.__enter__()
                revisit = marked is not None and marked[:2] == (page, digest)
                payload = (html or "").encode()
                member = gzip.compress(record(page, url, payload, marked[2] if revisit else None, revisit, date), 6, mtime=0)
                stream.write(member)
                size, count = size + len(member), count + 1
        close()
        files, counts, sizes = list(zip(*done, strict=True)) or [()] * 3
        yield pa.record_batch(
            [pa.array(files, pa.string()), pa.array(counts, pa.int64()), pa.array(sizes, pa.int64())], ["file", "records", "bytes"]
        )

    return write


def _blocks(source) -> Iterator[bytes]:
    """The unpacked members of a gzip file, read in steps."""
    rest = source.read(_BLOCK)
    while rest:
        unpack, parts = zlib.decompressobj(31), []
        while not unpack.eof:
            if not rest:
                raise ValueError("the archive ends inside a record")
            parts.append(unpack.decompress(rest))
            rest = unpack.unused_data if unpack.eof else source.read(_BLOCK)
        yield b"".join(parts)
        rest = rest or source.read(_BLOCK)


def parsed(member: bytes) -> tuple[dict[str, str], bytes]:
    """The headers (lower-case names) of one record, and its block; checks length and block digest."""
    head, _, tail = member.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/1."):
        raise ValueError(f"not a record: {version[:20]!r}")
    headers = {name.lower(): value.strip() for name, _, value in (line.partition(":") for line in lines)}
    block = tail[: int(headers["content-length"])]
    if len(tail) != len(block) + 4 or _sha1(block) != headers["warc-block-digest"]:
        raise ValueError("a record is damaged")
    return headers, block


RECORDS = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def _reader(folder: str, with_payload: bool):
    def rows(file: str) -> Iterator[tuple]:
        system, path = filesystem(f"{folder}/{file}")
        with system.open_input_stream(path, compression=None) as source:
            for member in _blocks(source):
                headers, block = parsed(member)
                payload = block.partition(b"\r\n\r\n")[2]
                kind, digest, size = headers["warc-type"], headers["warc-payload-digest"], int(headers["x-payload-length"])
                if kind == "response" and (_sha1(payload) != digest or len(payload) != size):
                    raise ValueError("a payload is damaged")
                page, refers = headers.get("x-page-id"), headers.get("x-refers-to-page-id")
                yield (
                    None if page is None else int(page),
                    headers["warc-target-uri"],
                    kind,
                    size,
                    base64.b32decode(digest.partition(":")[2]).hex(),
                    None if refers is None else int(refers),
                    payload if with_payload and kind == "response" else None,
                )

    names = [field.split()[0] for field in RECORDS.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]

    def batch_of(rows_: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows_, strict=True)) or [()] * len(names)
        return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for file in batch.column("file").to_pylist():
                for row in rows(file):
                    held.append(row)
                    if len(held) >= 500:
                        yield batch_of(held)
                        held = []
        yield batch_of(held)

    return read


@dataclass
class Archive:
    """A written folder and its manifest (file, records, bytes)."""

    spark: SparkSession
    folder: str
    manifest: DataFrame

    def records(self, with_payload: bool = True) -> DataFrame:
        """The rows of ``RECORDS``, read from the files that the manifest names.

        Files are shared out over the cores, and over more tasks if these would read more
        than ``TASK_BYTES`` each; a file is read by one task. Revisits have no payload. A
        damaged or cut record is an error.
        """
        count, size = self.manifest.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
        tasks = max(1, min(count, max(self.spark.sparkContext.defaultParallelism, -(-size // TASK_BYTES))))
        # Ranges of names are even in number, and a stated number of tasks is kept.
        files = self.manifest.select("file").repartitionByRange(tasks, "file")
        return files.mapInArrow(_reader(self.folder, with_payload), RECORDS)


def write_warc(
    pages: DataFrame,
    folder: str,
    page_id: str = "page_id",
    url: str = "url",
    html: str = "html",
    date: str = DATE,
    file_bytes: int = FILE_BYTES,
) -> Archive:
    """Write a record for every row of ``pages``.

    A null html is an empty payload, a null url an empty target. Null page ids come
    first and have no id header; among rows of one payload a null id is never the
    response unless all are null, which then are all responses. Rows that repeat both
    the largest id and the payload are all responses. Rows of one page id, or without
    one, are written by one task. Other columns are not read. An empty table leaves an
    empty manifest.
    """
    payload = F.encode(text_of(html), "UTF-8")
    rows = pages.select(
        F.col(page_id).cast("long").alias("page_id"), F.sha1(payload).alias("digest"), F.octet_length(payload).alias("size"),
        F.col(url).cast("string").alias("url"), text_of(html).alias("html"),
    )
    slim = written(rows.where(F.col("size") >= LEAST_REVISIT).select("page_id", "digest"), "warc-digests")
    lasts = slim.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    marks = written(
        slim.join(lasts, "digest").where("page_id is null or page_id < refers_to").where("refers_to is not null").distinct(), "warc-marks"
    )
    none = F.lit(None).cast("string")
    both = rows.select("page_id", "digest", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("refers_to"), "url", "html").unionByName(
        marks.select("page_id", "digest", F.lit(0).alias("kind"), "refers_to", none.alias("url"), none.alias("html"))
    )
    ordered = both.repartitionByRange("page_id").sortWithinPartitions("page_id", "digest", "kind", "url")
    files = ordered.mapInArrow(_writer(folder, date, file_bytes), "file string, records long, bytes long")
    files.write.mode("overwrite").parquet(f"{folder}/manifest")
    manifest = pages.sparkSession.read.schema("file string, records long, bytes long").parquet(f"{folder}/manifest")
    return Archive(pages.sparkSession, folder, manifest)
