"""WARC archives of a table of pages, written and read as a table of chunks.

A record's payload moves as rows (record, chunk number, bytes) of bounded size, in order, and
its digest is carried from chunk to chunk; neither writing nor reading holds a whole payload
besides the table cell it comes from. Chunks are deflated before they are shuffled. Of records with equal payloads (SHA-1 and length), the one
with the largest page id is the response; the others are revisits that name it.

Archives are gzip files of one member a record. A task writes its archives under names of its
own and reports them; see ``files``. Defined results: a null payload is an empty one; null page
ids are the lowest; of rows equal in page id and payload, one is the response and the others
revisit it; an empty table gives no archives and no rows; a null address is left out; other
columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from countcast.llm.files import fresh_folder, fresh_name, opened
from countcast.llm.rows import with_row_ids
from countcast.workspace import stored

#: Payload bytes in one row of the chunk table.
CHUNK_BYTES = 1 << 16
#: Compressed bytes after which a task begins its next archive.
ARCHIVE_BYTES = 1 << 26
#: The date of every record: the table has none, and archives of equal tables shall be equal.
DATE = "2000-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

READ_COLUMNS = "record string, page_id bigint, url string, kind string, refers_to string, named_digest string, chunk int, data binary, last boolean, bytes_so_far bigint, digest string"


def base32_digest(hexadecimal: str) -> str:
    return base64.b32encode(bytes.fromhex(hexadecimal)).decode("ascii")


def record_chunks(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The chunk table of a table of pages: (record, page_id, url, kind, refers_to, digest, size,
    chunk, data), one chunk at least for each record, its data deflated; ``refers_to`` is a record.

    Digests and roles are decided on narrow rows (the largest page id of a payload is a partial
    aggregate); the payloads are shuffled once, by row, so copies do not meet in one task.
    """
    rows = with_row_ids(pages.select(F.col(key).cast("bigint").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("body")), "record")
    thin = stored(rows.select("record", "page_id", F.sha1("body").alias("digest"), F.octet_length("body").cast("bigint").alias("size")), "digests")
    first = F.struct(F.col("page_id").isNotNull().alias("known"), "page_id", "record")
    best = thin.groupBy("digest", "size").agg(F.max(first).alias("best"))
    roles = thin.join(best, ["digest", "size"]).select(
        "record", "digest", "size", F.when(F.col("best.record") != F.col("record"), F.col("best.record")).alias("refers_to")
    )
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at: list[int] = []
            numbers: list[int] = []
            data: list[bytes] = []

            def rows_so_far() -> pa.RecordBatch:
                own = batch.select(["record", "page_id", "url"]).take(pa.array(at, pa.int32()))
                out = pa.RecordBatch.from_arrays([*own.columns, pa.array(numbers, pa.int32()), pa.array(data, pa.binary())], names=["record", "page_id", "url", "chunk", "data"])
                at.clear(), numbers.clear(), data.clear()
                return out

            for i in range(batch.num_rows):
                body = batch.column("body")[i].as_buffer()
                for chunk in range(max(1, -(-body.size // chunk_bytes))):
                    start = chunk * chunk_bytes
                    at.append(i)
                    numbers.append(chunk)
                    data.append(zlib.compress(body.slice(start, min(chunk_bytes, body.size - start)), 6))
                    if len(data) >= 1024:
                        yield rows_so_far()
            yield rows_so_far()

    chunks = rows.mapInArrow(cut, "record bigint, page_id bigint, url string, chunk int, data binary")
    joined = chunks.join(roles, "record").where("refers_to is null or chunk = 0")
    kind = F.when(F.col("refers_to").isNotNull(), "revisit").otherwise("response").alias("kind")
    return joined.select("record", "page_id", "url", kind, "refers_to", "digest", "size", "chunk", "data").sortWithinPartitions("record", "chunk")


def _record_id(record: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, str(record))}>"


def _heads(row: dict) -> bytes:
    """The record's headers and those of the response within; the payload follows."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['size']}\r\n\r\n".encode()
    revisit = row["kind"] == "revisit"
    lines = [
        "WARC/1.1",
        f"WARC-Type: {row['kind']}",
        f"WARC-Record-ID: {_record_id(row['record'])}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{base32_digest(row['digest'])}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(http) + (0 if revisit else row['size'])}",
    ]
    if row["url"] is not None:
        lines.append("WARC-Target-URI: " + " ".join(row["url"].split()))
    if row["page_id"] is not None:
        lines.append(f"Page-ID: {row['page_id']}")
    if revisit:
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_record_id(row['refers_to'])}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + http


def write_archives(chunks: DataFrame, folder: str) -> DataFrame:
    """Write a chunk table whose records' chunks are together and in order; the archives' table."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: list[str] = []
        sizes: list[int] = []
        raw = packed = None

        def end_member() -> None:
            nonlocal packed
            if packed is not None:
                packed.write(b"\r\n\r\n")
                packed.close()
                packed = None

        def end_archive() -> None:
            nonlocal raw
            end_member()
            if raw is not None:
                sizes.append(raw.tell())
                raw.close()
                raw = None

        for batch in batches:
            for row in batch.to_pylist():
                if row["chunk"] == 0:
                    end_member()
                    if raw is not None and raw.tell() >= ARCHIVE_BYTES:
                        end_archive()
                    if raw is None:
                        names.append(fresh_name(folder, ".warc.gz"))
                        where, path = opened(names[-1])
                        raw = where.open_output_stream(path)
                    packed = gzip.GzipFile(fileobj=raw, mode="wb", compresslevel=6, mtime=0)
                    packed.write(_heads(row))
                if row["kind"] == "response":
                    packed.write(zlib.decompress(row["data"]))
        end_archive()
        if names:
            yield pa.RecordBatch.from_pydict({"path": names, "bytes": pa.array(sizes, pa.int64())})

    return stored(chunks.mapInArrow(write, "path string, bytes bigint"), "archives")


def _named(stream: gzip.GzipFile) -> dict[str, str]:
    """Header lines up to the empty one, by lower-case name."""
    out = {}
    while line := stream.readline().strip():
        name, _, value = line.decode("utf-8").partition(":")
        out[name.strip().lower()] = value.strip()
    return out


def archive_chunks(stream, chunk_bytes: int = CHUNK_BYTES) -> Iterator[dict]:
    """The records of one archive as chunk rows; the last one of a record has its full digest."""
    with gzip.GzipFile(fileobj=stream) as plain:
        while line := plain.readline():
            if not line.strip():
                continue
            if not line.startswith(b"WARC/"):
                raise ValueError(f"no WARC record begins with {line[:40]!r}")
            head = _named(plain)
            left = int(head["content-length"])
            before = plain.tell()
            if head.get("content-type", "").startswith("application/http"):
                plain.readline()
                _named(plain)
            left -= plain.tell() - before
            page = head.get("page-id")
            row = {
                "record": head.get("warc-record-id"), "page_id": None if page is None else int(page), "url": head.get("warc-target-uri"),
                "kind": head.get("warc-type"), "refers_to": head.get("warc-refers-to"),
                "named_digest": head.get("warc-payload-digest", "").removeprefix("sha1:") or None,
            }
            sha1, so_far, chunk = hashlib.sha1(), 0, 0
            while True:
                data = plain.read(min(left, chunk_bytes))
                if left and not data:
                    raise EOFError(f"{row['record']} ends early")
                left -= len(data)
                so_far += len(data)
                sha1.update(data)
                digest = None if left else base64.b32encode(sha1.digest()).decode("ascii")
                yield row | {"chunk": chunk, "data": data, "last": not left, "bytes_so_far": so_far, "digest": digest}
                chunk += 1
                if not left:
                    break


def read_archives(archives: DataFrame, with_data: bool = True, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The chunk rows of archives (a table with ``path``), each archive streamed by one task.

    Without data, a record gives its last row alone, with its size and digest.
    """
    schema = pa.schema([
        ("record", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("kind", pa.string()), ("refers_to", pa.string()), ("named_digest", pa.string()),
        ("chunk", pa.int32()), ("data", pa.binary()), ("last", pa.bool_()), ("bytes_so_far", pa.int64()), ("digest", pa.string()),
    ])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        for batch in batches:
            for uri in batch.column("path").to_pylist():
                where, path = opened(uri)
                with where.open_input_stream(path) as stream:
                    for row in archive_chunks(stream, chunk_bytes):
                        if not with_data:
                            if not row["last"]:
                                continue
                            row["data"] = b""
                        rows.append(row)
                        if len(rows) * (chunk_bytes if with_data else 256) >= 1 << 22:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    tasks = int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a given number: small rows, much work
    return archives.select("path").repartition(tasks, "path").mapInArrow(read, READ_COLUMNS)


def archive_index(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write a table of pages as archives, read them back, and list the records.

    Size and digest of a response are those of the payload as read; a revisit has those of the
    record it refers to, and the digest its own header names must agree.
    """
    archives = write_archives(record_chunks(pages), fresh_folder(spark, "warc"))
    records = read_archives(archives, with_data=False)
    records = stored(records.select("record", "page_id", "kind", "refers_to", "named_digest", "bytes_so_far", "digest"), "records")
    responses = records.where("kind = 'response'").select(F.col("record").alias("refers_to"), F.col("page_id").alias("refers_page"), F.col("bytes_so_far").alias("full_bytes"), F.col("digest").alias("full_digest"))
    revisits = records.where("kind = 'revisit'").join(responses, "refers_to", "left")
    digest = F.when(F.col("named_digest") == F.col("full_digest"), F.col("full_digest"))
    return records.where("kind = 'response'").select(
        "page_id", F.col("bytes_so_far").alias("payload_bytes"), F.when(F.col("digest") == F.col("named_digest"), F.col("digest")).alias("payload_digest"),
        F.col("kind").alias("record_type"), F.lit(None).cast("bigint").alias("refers_to"),
    ).unionByName(
        revisits.select("page_id", F.col("full_bytes").alias("payload_bytes"), digest.alias("payload_digest"), F.col("kind").alias("record_type"), F.col("refers_page").alias("refers_to"))
    )
