"""Rows in a total order over all partitions, with running totals, in linear passes."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from strandwise.llm.storage import drop_table, write_table


def in_order(spark: SparkSession, narrow: DataFrame, keys: list, label: str, annotate: Callable[[pa.Table], dict[str, pa.Array]] | None = None, extra: str = "") -> DataFrame:
    """``narrow`` range-partitioned and sorted by ``keys``, written once, with ``part`` and ``nth``.

    ``part`` is the partition (ascending with the keys) and ``nth`` the row's
    place in it, so a row's global place is the sum of the sizes of earlier
    partitions plus ``nth``.  ``annotate`` adds the columns of the DDL
    ``extra`` to each batch; it sees a partition's batches in order and is
    called anew for every partition.  Ranges split a hot
    key by the keys after it; rows equal in all keys stay in one partition, narrow and streamed.
    """
    first = write_table(spark, narrow, f"{label}-rows")  # the range sample then reads narrow rows, not texts
    schema = T.StructType([*first.schema.fields, *T._parse_datatype_string(f"part int, nth bigint{', ' + extra if extra else ''}").fields])

    def run(batches):
        part, nth = TaskContext.get().partitionId(), 0
        more = annotate() if annotate else None
        for batch in batches:
            n = batch.num_rows
            cols = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            cols |= {"part": pa.array(np.full(n, part, np.int32)), "nth": pa.array(np.arange(nth, nth + n))}
            if more:
                cols |= more(batch)
            nth += n
            yield pa.RecordBatch.from_pydict(cols)

    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = write_table(spark, first.repartitionByRange(n, *keys).sortWithinPartitions(*keys).mapInArrow(run, schema), label)
    drop_table(spark, first)
    return ordered


def before(totals: dict[int, int]) -> dict[int, int]:
    """The sum of the totals of all earlier partitions, by partition."""
    out, at = {}, 0
    for part in sorted(totals):
        out[part] = at
        at += totals[part]
    return out
