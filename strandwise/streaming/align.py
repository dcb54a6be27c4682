"""Micro-batch alignment: a file stream of reads, a batch at a time, with carried insert sizes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def run_batches(stream: DataFrame, work: Callable[[DataFrame, int], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Apply ``work(batch, number)`` to each micro-batch and write it below ``out`` under its number.

    A batch that is run again after a failure overwrites its own folder, so
    every batch is there once.
    """

    def each(batch: DataFrame, number: int) -> None:
        work(batch, number).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


STATE = "orient int, low int, high int, avg double, std double"


class CarriedStats:
    """Insert-size statistics per batch; an orientation that fails in one keeps what it had.

    The state after each batch is a table of its own below ``folder``, which
    belongs with the stream's checkpoint: a stream that is started again goes
    on from it, and a batch that is run again reads what it read before.
    """

    def __init__(self, folder: str) -> None:
        self._folder = folder

    def update(self, stats: DataFrame, number: int) -> list[tuple]:
        """Statistics to use for the batch of this number: four orientations at most reach the driver."""
        spark = stats.sparkSession
        before = spark.read.schema(STATE).parquet(f"{self._folder}/batch={number - 1}").collect() if number else []
        latest = {r.orient: tuple(r) for r in before}
        for r in stats.where(~F.col("failed")).collect():
            latest[r.orient] = (r.orient, r.low, r.high, r.avg, r.std)
        rows = [latest[o] for o in sorted(latest)]
        spark.createDataFrame(rows, STATE).coalesce(1).write.mode("overwrite").parquet(f"{self._folder}/batch={number}")
        return rows
