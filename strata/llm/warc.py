"""WARC archives as a chunked record table (operator 2).

A payload is a sequence of rows (record, ``chunk_no``, ``data``) of at most `chunk_bytes` bytes.
Writing streams the chunks of a record, in order, into a compressed archive; reading streams an
archive into chunk rows. Every chunk read carries ``running_digest``, the SHA-1 of the payload up
to its end, and ``end_byte``, so a reader can check any prefix and the last chunk (``last``)
closes the record. Neither side holds more than a chunk of a record and one batch of chunks.

Records with equal payloads of at least `min_revisit` bytes share one response, that of the
smallest page id; the others are revisits that refer to it.

Archives are files in a folder all executors reach. A task writes under a name of its own and
reports the file as a row; only reported files are read, so files of lost attempts do no harm.

Cases: a null payload is empty; a page with null id is written with an empty page id and is never
chosen over a page with one; rows that repeat page id and payload are all responses (or all
revisits); an empty table gives no archives; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.tables import bound_batches, column, written
from strata.sizing import shuffle_width
from strata.storage import fresh_dir

CHUNK_BYTES = 1 << 18
BATCH_BYTES = 1 << 23
MIN_REVISIT = 0
RESPONSE, REVISIT = "response", "revisit"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

CHUNK_SCHEMA = (
    "file string, record_at long, page_id string, url string, record_type string, refers_to string, "
    "declared_bytes long, declared_digest string, chunk_no int, data binary, end_byte long, running_digest string, last boolean"
)
MANIFEST_SCHEMA = "file string, records long, bytes long"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


# --- writing -----------------------------------------------------------------


def plan_records(pages: DataFrame, id_col: str, url_col: str, payload: Column, min_revisit: int) -> DataFrame:
    """Per page: id and url as text, payload, its length and SHA-1, and the response it refers to."""
    rows = pages.select(
        column(pages, id_col).alias("id"), column(pages, url_col).cast("string").alias("url"), payload.alias("payload")
    ).withColumns({"sha1": F.unhex(F.sha1("payload")), "bytes": F.octet_length("payload").cast("long")})
    known = written(rows.select("id", "sha1", "bytes"), "warc-digests")
    first = (
        known.filter(F.col("bytes") >= min_revisit)
        .groupBy("sha1")
        .agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1 and first is not null")
        .drop("n")
    )
    first = written(first, "warc-first")
    revisits = known.join(first, "sha1").filter(F.col("id").isNull() | (F.col("id") != F.col("first")))
    revisits = revisits.select("sha1", F.col("id").alias("_id"), F.col("first").alias("refers_to")).distinct()
    revisits = written(revisits, "warc-revisits")
    return rows.join(revisits, (rows["sha1"] == revisits["sha1"]) & rows["id"].eqNullSafe(revisits["_id"]), "left").select(
        rows["id"].cast("string").alias("page_id"),
        "url",
        rows["sha1"],
        "bytes",
        revisits["refers_to"].cast("string").alias("refers_to"),
        "payload",
    )


def chunk_rows(records: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Record rows to chunk rows (a revisit or an empty payload has one empty chunk)."""
    stored = F.when(F.col("refers_to").isNull(), F.col("bytes")).otherwise(F.lit(0))
    n = F.greatest(F.ceil(stored / chunk_bytes), F.lit(1)).cast("int")
    numbered = records.withColumn("chunk_no", F.explode(F.sequence(F.lit(0), n - 1)))
    data = F.substring(F.col("payload"), F.col("chunk_no") * chunk_bytes + 1, F.lit(chunk_bytes))
    return numbered.select(
        "page_id", "url", "sha1", "bytes", "refers_to", "chunk_no", F.when(F.col("refers_to").isNull(), data).alias("data"), (F.col("chunk_no") == n - 1).alias("last")
    )


def _folder(uri: str):
    system, path = arrow_fs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:/", "file:///", 1))
    return system, path


def _head(row: dict) -> bytes:
    """Headers of a record up to its payload."""
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" f"Content-Length: {row['bytes']}\r\n\r\n"
    ).encode()
    stored = row["bytes"] if row["refers_to"] is None else 0
    page = "" if row["page_id"] is None else row["page_id"]
    lines = [
        "WARC/1.1",
        f"WARC-Type: {RESPONSE if row['refers_to'] is None else REVISIT}",
        f"WARC-Record-ID: <urn:page:{page}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{base32(row['sha1'])}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(http) + stored}",
    ]
    if row["url"] is not None:
        lines.append("WARC-Target-URI: " + row["url"].replace("\r", "%0D").replace("\n", "%0A"))
    if row["refers_to"] is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{row['refers_to']}>"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + http


def write_archives(chunks: DataFrame, folder: str) -> DataFrame:
    """Stream chunk rows, ordered within each partition, into one archive per partition.

    Gives the manifest: a row per archive written.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = _folder(folder)
        name = f"{path}/{uuid.uuid4().hex}.warc.gz"
        out, packer, digest, records, size = None, None, None, 0, 0
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    system.create_dir(path, recursive=True)
                    out = system.open_output_stream(name, compression=None)
                if row["chunk_no"] == 0:
                    packer, digest = zlib.compressobj(1, zlib.DEFLATED, 31), hashlib.sha1()
                    size += out.write(packer.compress(_head(row)))
                    records += 1
                data = row["data"] or b""
                digest.update(data)
                size += out.write(packer.compress(data))
                if row["last"]:
                    if row["refers_to"] is None and digest.digest() != row["sha1"]:
                        raise ValueError(f"payload of page {row['page_id']} does not match its digest")
                    size += out.write(packer.compress(b"\r\n\r\n") + packer.flush())
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict(
                {"file": [f"{folder.rstrip('/')}/{name.rpartition('/')[2]}"], "records": [records], "bytes": [size]}
            )

    return written(chunks.mapInArrow(write, MANIFEST_SCHEMA), "warc-manifest")


# --- reading -----------------------------------------------------------------


class _Members:
    """Bytes of a gzip file of many members, a bounded piece at a time; `at` is the offset of
    the member that is being read."""

    def __init__(self, stream, piece: int):
        self.stream, self.piece, self.at, self.read_to, self.held = stream, piece, 0, 0, b""
        self.unpacker = zlib.decompressobj(31)

    def take(self) -> bytes:
        """Some bytes of this member, or none at its end."""
        while True:
            if self.unpacker.eof:
                return b""
            if not self.held:
                self.held = self.stream.read(self.piece)
                self.read_to += len(self.held)
                if not self.held:
                    raise EOFError("the archive ends within a record")
            out = self.unpacker.decompress(self.held, self.piece)
            self.held = self.unpacker.unused_data if self.unpacker.eof else self.unpacker.unconsumed_tail
            if out:
                return out

    def next(self) -> bool:
        """Go on to the next member."""
        if self.unpacker.eof:
            self.unpacker = zlib.decompressobj(31)
        if not self.held:
            self.held = self.stream.read(self.piece)
            self.read_to += len(self.held)
        self.at = self.read_to - len(self.held)
        return bool(self.held)


def _fields(head: bytes) -> dict[str, str]:
    pairs = (line.partition(":") for line in head.decode("utf-8").split("\r\n")[1:])
    return {name.strip().lower(): value.strip() for name, _, value in pairs}


def _page(value: str | None) -> str | None:
    return value[len("<urn:page:") : -1] or None if value else None


def _records(stream, chunk_bytes: int) -> Iterator[dict]:
    """Chunk rows of an archive."""
    members = _Members(stream, chunk_bytes)
    while members.next():
        held = b""
        while held.count(b"\r\n\r\n") < 2:  # the record's and the response's headers
            more = members.take()
            if not more:
                raise ValueError("a record without headers")
            held += more
        head, http, held = held.split(b"\r\n\r\n", 2)
        fields, inner = _fields(head), _fields(http)
        left = int(fields["content-length"]) - len(http) - 4
        base = {
            "record_at": members.at,
            "page_id": _page(fields["warc-record-id"]),
            "url": fields.get("warc-target-uri"),
            "record_type": fields["warc-type"],
            "refers_to": _page(fields.get("warc-refers-to")),
            "declared_bytes": int(inner["content-length"]),
            "declared_digest": fields["warc-payload-digest"].partition(":")[2],
        }
        digest, done, number = hashlib.sha1(), 0, 0
        while True:
            while len(held) < min(left, chunk_bytes):
                more = members.take()
                if not more:
                    raise EOFError("the archive ends within a payload")
                held += more
            data, held = held[: min(left, chunk_bytes)], held[min(left, chunk_bytes) :]
            left, done = left - len(data), done + len(data)
            digest.update(data)
            yield base | {
                "chunk_no": number,
                "data": data,
                "end_byte": done,
                "running_digest": base32(digest.copy().digest()),
                "last": left == 0,
            }
            number += 1
            if left == 0:
                break
        while True:
            more = members.take()
            if not more:
                break


def read_archives(
    manifest: DataFrame, with_data: bool = True, chunk_bytes: int = CHUNK_BYTES, batch_bytes: int = BATCH_BYTES
) -> DataFrame:
    """The chunk table of the archives in a manifest; `with_data=False` checks the payloads
    all the same, but leaves the bytes out of the rows."""
    spark = manifest.sparkSession
    names = [part.split(" ")[0] for part in CHUNK_SCHEMA.split(", ")]
    types = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}
    schema = pa.schema([(p.split(" ")[0], types[p.split(" ")[1]]) for p in CHUNK_SCHEMA.split(", ")])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column("file").to_pylist():
                system, path = _folder(file)
                rows, held = [], 0
                with system.open_input_stream(path, compression=None) as stream:
                    for row in _records(stream, chunk_bytes):
                        if row["last"] and row["record_type"] == RESPONSE and row["running_digest"] != row["declared_digest"]:
                            raise ValueError(f"damaged payload in {file} at {row['record_at']}")
                        held += len(row["data"]) + 400
                        rows.append(row | {"file": file, "data": row["data"] if with_data else None})
                        if held >= batch_bytes:
                            yield pa.RecordBatch.from_pydict({n: [r[n] for r in rows] for n in names}, schema=schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pydict({n: [r[n] for r in rows] for n in names}, schema=schema)

    return manifest.select("file").repartition(shuffle_width(spark)).mapInArrow(read, CHUNK_SCHEMA)


def archive_pages(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    min_revisit: int = MIN_REVISIT,
    chunk_bytes: int = CHUNK_BYTES,
    folder: str | None = None,
) -> DataFrame:
    """Write a record per page and give the manifest of the archives."""
    spark = pages.sparkSession
    payload = F.coalesce(column(pages, html_col).cast("binary"), F.lit(b""))
    records = plan_records(pages, id_col, url_col, payload, min_revisit)
    bound_batches(spark)
    return write_archives(chunk_rows(records, chunk_bytes), folder or fresh_dir(spark, "warc"))


def record_table(chunks: DataFrame) -> DataFrame:
    """A row per record, from its last chunk: length and digest of the full payload."""
    return chunks.filter("last").select(
        "file", "record_at", "page_id", "url", "record_type", "refers_to",
        F.col("declared_bytes").alias("payload_bytes"),
        F.when(F.col("record_type") == RESPONSE, F.col("running_digest")).otherwise(F.col("declared_digest")).alias("payload_digest"),
    )
