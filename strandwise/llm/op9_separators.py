"""Token counts by scanning flat token files for end-of-document identifiers.

The files have no index and documents cross block ends freely.  Each split of
a file is searched as one vector a block at a time; it reports how many
separators it has, the tokens before its first and after its last.  A prefix
scan over these few numbers a split gives the first document number of each
split and the tokens carried into it, and a second pass writes the lengths.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwise.llm.ranked import before
from strandwise.llm.storage import atomic_output, new_folder, open_input, write_table
from strandwise.llm.tokenize import token_rows, tokenizer_path

#: The vocabulary's own end of text, which no text gives when special strings are ordinary text.
END_ID = 49407
SPLIT_BYTES = 32 << 20
BLOCK_BYTES = 4 << 20


def write_flat_files(spark: SparkSession, docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID, width: int = 2) -> tuple[list[str], DataFrame]:
    """Flat little-endian ids of ``docs``, a file a partition in the order of its rows; the paths, and ``(part, nth, doc_id)``.

    A file has ids and separators and nothing else.  A null text gives its
    separator alone; rows may repeat and ids be null.  Nothing is shuffled:
    ids are as large as the files, and a scan takes documents in any order.
    """

    def run(batches):
        part, nth = TaskContext.get().partitionId(), 0
        ids: list = []
        with atomic_output(f"{folder}/part-{part:06d}.ids") as out:
            for batch in batches:
                for value in batch.column(1):
                    out.write(value.as_buffer())
                ids.append(batch.column(0))
        for column in ids:
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(column), part, np.int32)), pa.array(np.arange(nth, nth + len(column))), column], ["part", "nth", "doc_id"])
            nth += len(column)

    rows = token_rows(spark, docs, tokenizer, end_id, width, literal_specials=True)
    placed = write_table(spark, rows.mapInArrow(run, "part int, nth bigint, doc_id bigint"), "flat-places")
    parts = sorted(r.part for r in placed.select("part").distinct().collect())
    return [f"{folder}/part-{p:06d}.ids" for p in parts], placed


def _blocks(path: str, start: int, end: int, width: int) -> Iterator[np.ndarray]:
    with open_input(path) as file:
        file.seek(start)
        while start < end:
            data = file.read(min(BLOCK_BYTES, end - start))
            start += len(data)
            yield np.frombuffer(data, f"<u{width}")


def splits_of(paths: list[str], width: int, split_bytes: int) -> list[tuple[int, str, int, int]]:
    """``(number, path, start, end)`` over all files in order; every split is a whole number of ids."""
    size = max(width, split_bytes // width * width)
    out: list[tuple[int, str, int, int]] = []
    for path in paths:
        with open_input(path) as file:
            n = file.size()
        if n % width:
            raise ValueError(f"{path}: {n} bytes are no whole number of ids")
        out += [(len(out) + i, path, a, min(n, a + size)) for i, a in enumerate(range(0, n, size))]
    return out


def token_counts(spark: SparkSession, paths: list[str], end_id: int = END_ID, width: int = 2, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """``(doc_no, n_tokens, ended)`` of all documents in the files, read as one stream in the order given.

    ``n_tokens`` includes the separator.  Tokens after the last separator are a
    document with ``ended`` false.  Empty files and an empty list are fine.
    """
    splits = splits_of(paths, width, split_bytes)
    table = spark.createDataFrame(splits, "k bigint, path string, a bigint, b bigint").repartition(max(1, len(splits)))

    def summarise(batches):
        for batch in batches:
            for k, path, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                seps, lead, tail = 0, 0, 0
                for block in _blocks(path, a, b, width):
                    at = np.flatnonzero(block == end_id)
                    if len(at) and not seps:
                        lead += int(at[0]) + 1
                    elif not seps:
                        lead += len(block)
                    seps += len(at)
                    tail = len(block) - int(at[-1]) - 1 if len(at) else tail + len(block)
                yield pa.RecordBatch.from_pydict({"k": [k], "seps": [seps], "lead": [lead], "tail": [tail]})

    # the prefix scan: three numbers for each split of SPLIT_BYTES
    found = sorted(tuple(r) for r in table.mapInArrow(summarise, "k bigint, seps bigint, lead bigint, tail bigint").collect())
    first, carry = {}, {}
    n, held = 0, 0
    for k, seps, lead, tail in found:
        first[k], carry[k] = n, held
        n += seps
        held = tail if seps else held + lead

    def lengths(batches):
        for batch in batches:
            for k, path, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                no, open_ = first[k], carry[k]
                for block in _blocks(path, a, b, width):
                    at = np.flatnonzero(block == end_id)
                    if not len(at):
                        open_ += len(block)
                        continue
                    sizes = np.diff(at, prepend=-1)
                    sizes[0] += open_
                    open_ = len(block) - int(at[-1]) - 1
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(no, no + len(at))), pa.array(sizes), pa.array(np.ones(len(at), bool))], ["doc_no", "n_tokens", "ended"])
                    no += len(at)

    counts = table.mapInArrow(lengths, "doc_no bigint, n_tokens bigint, ended boolean")
    return counts.unionByName(spark.createDataFrame([(n, held, False)], "doc_no bigint, n_tokens bigint, ended boolean")) if held else counts


def op9_separators(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(os.path.join(sf_dir, "documents.parquet"))
    paths, placed = write_flat_files(spark, docs, new_folder(spark, "flat-ids"), tokenizer_path())
    counts = token_counts(spark, paths)
    offset = before({r.part: r["count"] for r in placed.groupBy("part").count().collect()})
    starts = spark.createDataFrame([(p, o) for p, o in offset.items()], "part int, first bigint")
    ids = placed.join(F.broadcast(starts), "part").select((F.col("first") + F.col("nth")).alias("doc_no"), "doc_id")  # a row for each file
    # both sides grow with the documents; the plan must not take the short list of files for the size of the counts
    return counts.hint("merge").join(ids, "doc_no").select("doc_id", "doc_no", "n_tokens")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op9_separators": op9_separators}
ORACLES: dict[str, str] = {}
