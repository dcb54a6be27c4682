"""Token-id files: bit-plane shuffled blocks, compressed plane by plane, with a chunk index.

File layout (integers little-endian)::

    "SWBP0001"
    plane payloads, block after block, plane after plane (each one zstandard frame)
    index: u64 ids in the file | u32 ids a block | u8 planes a block | u8 id bytes
           u64 offset of every plane payload and of their end
           one zstandard frame: doc ids (i64), validity (u8), ids of each document (u64)
    u64 offset of the index | u64 documents | "SWBPEND1"

Any block is decoded alone from the index; blocks hold a fixed number of ids
whatever the documents, so a reader needs one block of memory at a time.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from strandwise.llm.storage import atomic_output, new_folder, open_input
from strandwise.llm.tokenize import in_id_order, token_rows, tokenizer_path

MAGIC, TAIL = b"SWBP0001", b"SWBPEND1"
BLOCK_IDS = 1 << 16
LEVEL = 3


def to_planes(ids: np.ndarray, planes: str) -> list[bytes]:
    """The planes of one block of unsigned ids, most significant first; the block is padded with zeros to whole bytes."""
    width = ids.dtype.itemsize
    octets = ids.astype(ids.dtype.newbyteorder(">")).view(np.uint8).reshape(-1, width)
    if planes == "byte":
        return [np.ascontiguousarray(octets[:, k]).tobytes() for k in range(width)]
    return [np.packbits((octets[:, k] >> (7 - b)) & 1).tobytes() for k in range(width) for b in range(8)]


def from_planes(planes: list[bytes], n: int, width: int) -> np.ndarray:
    """The inverse of :func:`to_planes`, as ``n`` unsigned ids."""
    octets = np.zeros((n, width), np.uint8)
    if len(planes) == width:
        for k, p in enumerate(planes):
            octets[:, k] = np.frombuffer(p, np.uint8)
    else:
        for k, p in enumerate(planes):
            octets[:, k // 8] |= np.unpackbits(np.frombuffer(p, np.uint8), count=n) << (7 - k % 8)
    return octets.view(f">u{width}").reshape(-1).astype(f"<u{width}")


class PlaneWriter:
    """Appends documents to one file; holds less than a block and a document."""

    def __init__(self, out, width: int, planes: str = "bit", block_ids: int = BLOCK_IDS, level: int = LEVEL):
        self._out, self._dtype, self._planes, self._block = out, np.dtype(f"<u{width}"), planes, block_ids
        self._zstd = zstandard.ZstdCompressor(level=level)
        self._held: list[bytes] = []
        self._held_ids = self.n_ids = 0
        self._at = len(MAGIC)
        self._offsets, self._docs, self._valid, self._lengths = [self._at], [], [], []
        out.write(MAGIC)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self._docs.append(doc_id or 0)
        self._valid.append(doc_id is not None)
        n = len(ids) // self._dtype.itemsize
        self._lengths.append(n)
        self.n_ids += n
        self._held.append(ids)
        self._held_ids += n
        if self._held_ids >= self._block:
            self._flush(whole=True)

    def _flush(self, whole: bool) -> None:
        flat = np.frombuffer(b"".join(self._held), self._dtype)
        end = len(flat) // self._block * self._block if whole else len(flat)
        for i in range(0, end, self._block):
            for plane in to_planes(flat[i : i + self._block][: end - i], self._planes):
                frame = self._zstd.compress(plane)
                self._out.write(frame)
                self._at += len(frame)
                self._offsets.append(self._at)
        rest = flat[end:]
        self._held, self._held_ids = [rest.tobytes()], len(rest)

    def close(self) -> None:
        self._flush(whole=False)
        width = self._dtype.itemsize
        docs = np.array(self._docs, "<i8").tobytes() + np.array(self._valid, "u1").tobytes() + np.array(self._lengths, "<u8").tobytes()
        self._out.write(struct.pack("<QIBB", self.n_ids, self._block, width * (1 if self._planes == "byte" else 8), width))
        self._out.write(np.array(self._offsets, "<u8").tobytes())
        self._out.write(self._zstd.compress(docs))
        self._out.write(struct.pack("<QQ", self._at, len(self._docs)) + TAIL)


class PlaneReader:
    """Random access to one file: the index first, then blocks one at a time."""

    def __init__(self, file):
        self._file = file
        size = file.size()
        file.seek(size - 24)
        index_at, n_docs, tail = *struct.unpack("<QQ", file.read(16)), file.read(8)
        if tail != TAIL:
            raise ValueError("not a complete token file")
        file.seek(index_at)
        index = file.read(size - 24 - index_at)
        self.n_ids, self.block, self._per_block, self.width = struct.unpack_from("<QIBB", index)
        self.n_blocks = -(-self.n_ids // self.block)
        n_off = self.n_blocks * self._per_block + 1
        self._offsets = np.frombuffer(index, "<u8", n_off, 14)
        self._zstd = zstandard.ZstdDecompressor()
        docs = self._zstd.decompress(index[14 + 8 * n_off :], max_output_size=17 * n_docs or 1)
        ids, valid = np.frombuffer(docs, "<i8", n_docs), np.frombuffer(docs, "u1", n_docs, 8 * n_docs)
        self.doc_ids = [int(i) if v else None for i, v in zip(ids, valid, strict=True)]
        self.lengths = np.frombuffer(docs, "<u8", n_docs, 9 * n_docs)

    def read_block(self, k: int) -> np.ndarray:
        n = min(self.block, self.n_ids - k * self.block)
        at = self._offsets[k * self._per_block : (k + 1) * self._per_block + 1].astype(np.int64)
        self._file.seek(int(at[0]))
        data = self._file.read(int(at[-1] - at[0]))
        most = n * self.width if self._per_block == self.width else n
        planes = [self._zstd.decompress(data[a - at[0] : b - at[0]], max_output_size=most) for a, b in zip(at[:-1], at[1:], strict=True)]
        return from_planes(planes, n, self.width)

    def documents(self) -> Iterator[tuple[int | None, int, int]]:
        """``(doc_id, n_tokens, crc32 of the ids as u32)``, one block in memory at a time."""
        block, at, k = np.zeros(0, "<u4"), 0, 0
        for doc_id, n in zip(self.doc_ids, self.lengths.tolist(), strict=True):
            left, crc = n, 0
            while left:
                if at == len(block):
                    block, at, k = self.read_block(k).astype("<u4"), 0, k + 1
                take = min(left, len(block) - at)
                crc = zlib.crc32(block[at : at + take], crc)
                at, left = at + take, left - take
            yield doc_id, n, crc


def write_token_files(spark: SparkSession, docs: DataFrame, folder: str, tokenizer: str, end_id: int = 2, planes: str = "bit", literal_specials: bool = False) -> list[tuple[int, str, int, int]]:
    """Encode ``docs(doc_id, text)`` to files in ascending ``doc_id`` order.

    Returns one ``(part, path, documents, ids)`` for every file, a row for each
    partition and never for each document.  ``planes`` is ``bit`` or ``byte``.
    A null text is empty, a null ``doc_id`` comes first, repeated rows are all
    kept, an empty table gives files without documents, and other columns are
    ignored.  Whole documents stay in one file; blocks cut across them.
    """
    from tokenizers import Tokenizer

    width = 2 if max(Tokenizer.from_file(tokenizer).get_vocab_size(), end_id + 1) <= 1 << 16 else 4

    def run(batches):
        part = TaskContext.get().partitionId()
        url = f"{folder}/part-{part:06d}.swbp"
        n = 0
        with atomic_output(url) as out:
            writer = PlaneWriter(out, width, planes)
            for batch in batches:
                for doc_id, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    writer.add(doc_id, ids)
                    n += 1
            writer.close()
        yield pa.RecordBatch.from_pydict({"part": [part], "path": [url], "docs": [n], "ids": [writer.n_ids]})

    rows = in_id_order(spark, token_rows(spark, docs, tokenizer, end_id, width, literal_specials), docs)
    return sorted(tuple(r) for r in rows.mapInArrow(run, "part bigint, path string, docs bigint, ids bigint").collect())


def read_token_files(spark: SparkSession, files: list[tuple[int, str, int, int]]) -> DataFrame:
    """Documents back from the files: ``doc_id, start, n_tokens, ids_crc32``, a task for each file."""
    starts, total = [], 0
    for _, path, _, ids in files:
        starts.append((path, total))
        total += ids

    def run(batches):
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with open_input(path) as file:
                    out: list[tuple] = []
                    for doc_id, n, crc in PlaneReader(file).documents():
                        out.append((doc_id, start, n, crc))
                        start += n
                        if len(out) == 20_000:
                            yield _rows(out)
                            out = []
                    yield _rows(out)

    table = spark.createDataFrame(starts, "path string, start bigint")
    return table.repartition(max(1, len(starts))).mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def _rows(out: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*out, strict=True)) or [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "start", "n_tokens", "ids_crc32"])


def round_trip(spark: SparkSession, docs: DataFrame, planes: str = "bit") -> DataFrame:
    """Write the files of ``docs`` below the shared folder and read them back."""
    folder = new_folder(spark, "token-files")
    return read_token_files(spark, write_token_files(spark, docs, folder, tokenizer_path(), planes=planes))


def op2_bitplane(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(spark, spark.read.parquet(os.path.join(sf_dir, "documents.parquet")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op2_bitplane": op2_bitplane}
ORACLES: dict[str, str] = {}
