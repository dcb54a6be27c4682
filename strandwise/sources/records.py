"""Python data sources for sequence files: splittable FASTQ, FASTA/FASTQ streams and BAM."""

from __future__ import annotations

import gzip
import io
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "name string, comment string, seq string, qual string"
SPLIT_BYTES = 64 << 20
#: Splits in a row that one task reads, and what a task holds of a file and hands on at a time.
TASK_BYTES, BLOCK_BYTES = 16 << 20, 1 << 20
BASES16 = "=ACMGRSVTWYHKDBN"
COMPLEMENT = str.maketrans("ACGTacgt", "TGCAtgca")


def _system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or not path.startswith("file:") else path.replace("file:", "file://", 1)) if ":" in path else (fs.LocalFileSystem(), path)


def _files(path: str) -> tuple[fs.FileSystem, list[fs.FileInfo]]:
    system, root = _system(path)
    info = system.get_file_info(root)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True))
    return system, sorted((f for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))), key=lambda f: f.path)


def _batches(records: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Records as Arrow batches of some ``BLOCK_BYTES`` of text, so a task holds one of them whatever a record's size."""
    schema = pa.schema([(c.split()[0], pa.string()) for c in SCHEMA.split(", ")])
    held, size = [], 0
    for record in records:
        held.append(record)
        size += 2 * len(record[2]) + 64
        if size >= BLOCK_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*held, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*held, strict=True)], schema=schema)


class Part(InputPartition):
    """Splits of ``step`` bytes, one after another, from ``start`` to ``end``."""

    def __init__(self, url: str, path: str, start: int, end: int, step: int):
        self.url, self.path, self.start, self.end, self.step = url, path, start, end, step


class _Reader(DataSourceReader):
    split = False

    def __init__(self, options: dict):
        self.url = options["path"]
        self.bytes = int(options.get("split_bytes", SPLIT_BYTES))

    def partitions(self) -> list[Part]:
        _, files = _files(self.url)
        out = []
        for f in files:
            step = self.bytes if self.split else max(f.size, 1)
            run = step * max(1, TASK_BYTES // step)
            out += [Part(self.url, f.path, a, min(a + run, f.size), step) for a in range(0, f.size, run)]
        return out or [Part(self.url, "", 0, 0, 1)]


def four_line_records(lines: Iterator[bytes]) -> Iterator[tuple]:
    """Strict records; a malformed one raises."""
    for head in lines:
        body = [next(lines, b"").rstrip(b"\r\n") for _ in range(3)]
        head = head.rstrip(b"\r\n").decode()
        seq, plus, qual = (x.decode() for x in body)
        if not plus.startswith("+") or len(seq) != len(qual):
            raise ValueError(f"malformed record: {head[:80]}")
        name, _, comment = head.removeprefix("@").replace("\t", " ").partition(" ")
        yield name, comment or None, seq, qual


def first_record(data: bytes) -> int | None:
    """Where the first whole record of a block begins: a header, bases, a plus line, and as many qualities as bases."""
    at = data.find(b"\n") + 1
    while at > 0:
        lines = data[at : at + (1 << 20)].split(b"\n", 4)
        if len(lines) < 4 or (len(lines) == 4 and not lines[3]):
            return None
        if lines[0][:1] == b"@" and lines[2][:1] == b"+" and len(lines[1].rstrip(b"\r")) == len(lines[3].rstrip(b"\r")):
            return at
        at = data.find(b"\n", at) + 1
    return None


class FastqReader(_Reader):
    """A split reads the records that begin in it: the first boundary found inside up to the one after its end."""

    split = True

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        system, _ = _system(part.url)
        with system.open_input_file(part.path) as file:
            yield from _batches(x for start in range(part.start, part.end, part.step) for x in self._records(file, start, min(start + part.step, part.end)))

    @classmethod
    def _records(cls, file, start: int, end: int) -> Iterator[tuple]:
        """The records that begin in one split."""
        size = file.size()

        def boundary(at: int) -> int:
            if at in (0, size):
                return at
            width = 1 << 16
            while True:
                file.seek(at - 1)
                block = file.read(width)
                if (found := first_record(block)) is not None:
                    return at - 1 + found
                if at - 1 + width >= size:
                    return size
                width *= 4

        first, last = boundary(start), boundary(end)
        file.seek(first)
        yield from four_line_records(cls._lines(file, last))

    @staticmethod
    def _lines(file, end: int) -> Iterator[bytes]:
        held = b""
        while file.tell() < end:
            *lines, held = (held + file.read(min(BLOCK_BYTES, end - file.tell()))).split(b"\n")
            yield from lines
        if held:
            yield held


def mixed_records(lines: Iterator[str]) -> Iterator[tuple]:
    """FASTA and FASTQ mixed, sequences over several lines; qualities go on until they are as long as the bases."""
    line = next(lines, None)
    while line is not None:
        if not line or line[0] not in ">@":
            line = next(lines, None)
            continue
        name, _, comment = line[1:].replace("\t", " ").partition(" ")
        seq: list[str] = []
        line = next(lines, None)
        while line is not None and line[:1] not in (">", "@", "+"):
            seq.append(line)
            line = next(lines, None)
        bases, qual = "".join(seq), None
        if line is not None and line[:1] == "+":
            got, size = [], 0
            while size < len(bases):
                line = next(lines, None)
                if line is None:
                    raise ValueError(f"truncated qualities of {name}")
                got.append(line)
                size += len(line)
            qual = "".join(got)
            if len(qual) != len(bases):
                raise ValueError(f"qualities of {name} are longer than its bases")
            line = next(lines, None)
        yield name, comment or None, bases, qual


class FastxReader(_Reader):
    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        system, _ = _system(part.url)
        with system.open_input_stream(part.path) as raw:
            yield from _batches(mixed_records(x.rstrip("\r\n") for x in io.TextIOWrapper(raw, newline="\n")))


#: The code of each letter, and the two letters of each byte of packed bases.
_CODE16 = np.full(256, 15, np.uint8)
_CODE16[np.frombuffer(BASES16.encode(), np.uint8)] = _CODE16[np.frombuffer(BASES16.lower().encode(), np.uint8)] = np.arange(16)
_LETTERS = np.frombuffer("".join(a + b for a in BASES16 for b in BASES16).encode(), np.uint8).reshape(256, 2)


def bam_record(name: str, flag: int, seq: str, qual: str | None) -> bytes:
    """One unmapped record in the binary layout."""
    codes = np.zeros(len(seq) + len(seq) % 2, np.uint8)
    codes[: len(seq)] = _CODE16[np.frombuffer(seq.encode("ascii", "replace"), np.uint8)]
    packed = ((codes[::2] << 4) | codes[1::2]).tobytes()
    body = struct.pack("<iiBBHHHiiii", -1, -1, len(name) + 1, 0, 4680, 0, flag, len(seq), -1, -1, 0) + name.encode() + b"\0" + packed
    body += (np.frombuffer(qual.encode("ascii"), np.uint8) - np.uint8(33)).tobytes() if qual else b"\xff" * len(seq)
    return struct.pack("<i", len(body)) + body


def bam_header(text: str = "") -> bytes:
    return b"BAM\1" + struct.pack("<i", len(text)) + text.encode() + struct.pack("<i", 0)


def bam_reads(stream, which: int = 7) -> Iterator[tuple]:
    """Reads of the kinds in ``which`` (1 first ends, 2 second ends, 4 single), in sequencing direction."""
    if stream.read(4) != b"BAM\1":
        raise ValueError("not a BAM file")
    stream.read(struct.unpack("<i", stream.read(4))[0])
    for _ in range(struct.unpack("<i", stream.read(4))[0]):
        stream.read(struct.unpack("<i", stream.read(4))[0] + 4)
    while head := stream.read(4):
        body = stream.read(struct.unpack("<i", head)[0])
        _, _, l_name, _, _, n_cigar, flag, l_seq = struct.unpack_from("<iiBBHHHi", body)
        kind = 1 if flag & 0x40 else 2 if flag & 0x80 else 4
        if not which & kind or flag & 0x900:
            continue
        at = 32 + l_name + 4 * n_cigar
        packed, q = body[at : at + (l_seq + 1) // 2], body[at + (l_seq + 1) // 2 :][:l_seq]
        seq = _LETTERS[np.frombuffer(packed, np.uint8)].tobytes()[:l_seq].decode()
        qual = None if q[:1] == b"\xff" else (np.minimum(np.frombuffer(q, np.uint8), 93) + np.uint8(33)).tobytes().decode()
        if flag & 0x10:
            seq, qual = seq[::-1].translate(COMPLEMENT), qual and qual[::-1]
        yield body[32 : 31 + l_name].decode(), str(kind), seq, qual


class BamReader(_Reader):
    def __init__(self, options: dict):
        super().__init__(options)
        self.which = int(options.get("which", 7))

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        system, _ = _system(part.url)
        with system.open_input_stream(part.path, compression=None) as raw, gzip.GzipFile(fileobj=raw) as stream:  # block gzip is concatenated members
            yield from _batches(bam_reads(stream, self.which))


def _source(label: str, reader_class: type) -> type[DataSource]:
    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return label

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema):
            return reader_class(dict(self.options))

    return Source


def register(spark: SparkSession) -> None:
    """Make ``spark.read.format(..)`` know ``fastq4``, ``fastx`` and ``bam``."""
    for label, reader in (("fastq4", FastqReader), ("fastx", FastxReader), ("bam", BamReader)):
        spark.dataSource.register(_source(label, reader))
