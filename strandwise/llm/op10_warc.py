"""WARC archives by a chunked record table.

A payload is a run of rows (record, chunk number, chunk), so neither writing
nor reading ever holds a whole oversized record in a worker: the writer takes
header values from the rows and streams chunks into a gzip member, and the
reader emits chunk rows that carry the length and the digest so far.
Payloads equal to an earlier page's become revisit records without payload.
"""

from __future__ import annotations

import hashlib
import os
import re
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwise.llm.storage import atomic_output, new_folder, open_stream, write_table
from strandwise.llm.tokenize import bounded_batches

#: Fixed value of the contract.
LEAST_REVISIT = 100
CHUNK_BYTES = 1 << 20
READ_BYTES = 1 << 18
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_chunks(spark: SparkSession, pages: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``page_id, url, n_bytes, digest, refers_to, chunk_no, chunk`` of ``pages(page_id, url, html)``.

    A payload of LEAST_REVISIT bytes or more that another page has too is kept
    by the smallest ``page_id``; the others refer to it and have one empty
    chunk.  Rows tied for the smallest all keep it, as do rows whose equals
    have only null ids.  A null payload is empty.
    """
    html = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    own = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("body"))
    own = own.withColumn("n_bytes", F.length("body").cast("bigint")).withColumn("digest", F.sha2("body", 256))
    again = own.where(F.col("n_bytes") >= LEAST_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    again = write_table(spark, again.select("digest", "first"), "repeated-payloads")
    refers = F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    marked = own.join(again, "digest", "left").withColumn("refers_to", refers)
    last = F.when(F.col("refers_to").isNull(), F.floor((F.col("n_bytes") - 1) / chunk_bytes)).otherwise(F.lit(0))
    body = F.when(F.col("refers_to").isNull(), F.col("body")).otherwise(F.lit(b""))
    numbers = F.sequence(F.lit(0), F.greatest(last, F.lit(0)).cast("int"))
    numbered = marked.withColumn("body", body).withColumn("chunk_no", F.explode(numbers))
    return numbered.select("page_id", "url", "n_bytes", "digest", "refers_to", "chunk_no", F.substring("body", F.col("chunk_no") * chunk_bytes + 1, F.lit(chunk_bytes)).alias("chunk"))


def _record_id(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def _head(page_id: int | None, url: str | None, n_bytes: int, digest: str, refers_to: int | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_record_id(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    lines += ["Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha256:{digest}"]
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_record_id(refers_to)}"]
    lines.append(f"Content-Length: {len(http) + (n_bytes if refers_to is None else 0)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + http


def write_archives(spark: SparkSession, chunks: DataFrame, folder: str, level: int = 3) -> list[str]:
    """Write the chunk rows, one gzip member a record and one file a partition; the paths.

    The chunks of a record follow each other, as :func:`record_chunks` makes them.
    """

    def run(batches):
        url = f"{folder}/part-{TaskContext.get().partitionId():06d}.warc.gz"
        with atomic_output(url) as out:
            pack = None

            def end() -> None:
                if pack is not None:
                    out.write(pack.compress(b"\r\n\r\n") + pack.flush())

            for batch in batches:
                for page_id, target, n, digest, refers_to, no, chunk in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if no == 0:
                        end()
                        pack = zlib.compressobj(level, zlib.DEFLATED, 31)
                        out.write(pack.compress(_head(page_id, target, n, digest, refers_to)))
                    out.write(pack.compress(chunk))
            end()
        yield pa.RecordBatch.from_pydict({"path": [url]})

    bounded_batches(spark)
    return sorted(r.path for r in chunks.mapInArrow(run, "path string").collect())


class _Members:
    """The text of concatenated gzip members as a stream with a small buffer."""

    def __init__(self, raw):
        self._raw, self._unpack, self._left, self._buffer = raw, None, b"", bytearray()

    def _fill(self) -> bool:
        while True:
            data = self._left or self._raw.read(READ_BYTES)
            self._left = b""
            if not data:
                if self._unpack is not None and not self._unpack.eof:
                    raise ValueError("an archive ends within a record")
                return False
            if self._unpack is None or self._unpack.eof:
                self._unpack = zlib.decompressobj(31)
            text = self._unpack.decompress(data, READ_BYTES)
            self._left = self._unpack.unconsumed_tail or self._unpack.unused_data
            self._buffer += text
            if text:
                return True

    def line(self) -> bytes | None:
        """The next line without its end; None at the end of the archive."""
        while (at := self._buffer.find(b"\r\n")) < 0:
            if not self._fill():
                return None
        out = bytes(self._buffer[:at])
        del self._buffer[: at + 2]
        return out

    def take(self, most: int) -> bytes:
        if not self._buffer:
            self._fill()
        out = bytes(self._buffer[:most])
        del self._buffer[: len(out)]
        return out


def _headers(stream: _Members) -> tuple[dict[str, str], int]:
    """Header fields up to the blank line, and the bytes they took."""
    fields, size = {}, 0
    while line := stream.line():
        size += len(line) + 2
        name, _, value = line.decode().partition(":")
        fields[name.strip().lower()] = value.strip()
    return fields, size + 2


def read_records(raw, chunk_bytes: int = CHUNK_BYTES) -> Iterator[tuple]:
    """Rows of :data:`READ_SCHEMA` of one archive."""
    stream = _Members(raw)
    while (first := stream.line()) is not None:
        if not first:  # the two empty lines after a record
            continue
        if not first.startswith(b"WARC/"):
            raise ValueError("no record starts here")
        warc, _ = _headers(stream)
        page = warc["warc-record-id"].rpartition(":")[2].rstrip(">")
        refers = warc.get("warc-refers-to", "").rpartition(":")[2].rstrip(">")
        status = stream.line()
        http, size = _headers(stream)
        left = int(warc["content-length"]) - size - len(status) - 2
        key = (None if page == "null" else int(page), warc["warc-type"], int(refers) if refers else None)
        stated, told = warc["warc-payload-digest"].removeprefix("sha256:"), int(http["content-length"])
        if key[1] == "revisit":
            yield *key, 0, b"", told, stated, True
            continue
        digest, done, no, held = hashlib.sha256(), 0, 0, bytearray()
        while True:
            while left and len(held) < chunk_bytes:
                piece = stream.take(min(left, chunk_bytes - len(held)))
                if not piece:
                    raise ValueError("an archive ends within a payload")
                held += piece
                left -= len(piece)
            digest.update(held)
            done += len(held)
            if not left and digest.hexdigest() != stated:
                raise ValueError(f"page {page}: the payload does not match its digest")
            yield *key, no, bytes(held), done, digest.hexdigest(), not left
            if not left:
                break
            no, held = no + 1, bytearray()


READ_SCHEMA = "page_id bigint, record_type string, refers_to bigint, chunk_no int, chunk binary, bytes_so_far bigint, digest_so_far string, last boolean"


def read_archives(spark: SparkSession, paths: list[str], payload: bool = True) -> DataFrame:
    """The chunked record table of archives: READ_SCHEMA, a task a file; without ``payload`` chunks are empty.

    ``bytes_so_far`` and ``digest_so_far`` are of the payload up to and with
    the chunk, so the row with ``last`` has those of the whole payload; a
    revisit has one row with the length and digest that its headers state.
    """
    names = [f.split()[0] for f in READ_SCHEMA.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.string(), pa.bool_()]

    def run(batches):
        def table(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, held = [], 0
                with open_stream(path) as raw:
                    for row in read_records(raw):
                        rows.append(row if payload else (*row[:4], b"", *row[5:]))
                        held += len(rows[-1][4])
                        if held >= CHUNK_BYTES or len(rows) >= 5000:
                            yield table(rows)
                            rows, held = [], 0
                if rows:
                    yield table(rows)

    table = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)))
    return table.mapInArrow(run, READ_SCHEMA)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(os.path.join(sf_dir, "pages.parquet"))
    paths = write_archives(spark, record_chunks(spark, pages), new_folder(spark, "warc"))
    whole = read_archives(spark, paths, payload=False).where("last")
    return whole.select("page_id", F.col("bytes_so_far").alias("payload_bytes"), F.col("digest_so_far").alias("payload_digest"), "record_type", "refers_to")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op10_warc": op10_warc}
ORACLES: dict[str, str] = {
    "op10_warc": f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, ''))::BIGINT AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT page_id, n, d, CASE WHEN n >= {LEAST_REVISIT} THEN min(page_id) OVER (PARTITION BY d) ELSE page_id END AS f FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
       CASE WHEN f = page_id OR f IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN f = page_id THEN NULL ELSE f END AS refers_to
FROM f
"""
}
