"""Named index tables kept by the session: stage, attach, list and drop."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


class IndexStore:
    """Persisted DataFrames by name; a lost executor's blocks are computed again."""

    def __init__(self, spark: SparkSession):
        self._spark = spark
        self._tables: dict[str, tuple[DataFrame, int]] = {}

    def stage(self, name: str, table: DataFrame) -> DataFrame:
        if name in self._tables:
            raise ValueError(f"{name} is staged already")
        kept = table.persist(StorageLevel.MEMORY_AND_DISK)
        self._tables[name] = (kept, kept.count())
        return kept

    def attach(self, name: str) -> DataFrame:
        return self._tables[name][0]

    def staged(self, name: str) -> bool:
        return name in self._tables

    def listing(self) -> DataFrame:
        return self._spark.createDataFrame([(n, rows) for n, (_, rows) in sorted(self._tables.items())], "name string, rows bigint")

    def drop(self, name: str | None = None) -> None:
        for n in [name] if name else list(self._tables):
            self._tables.pop(n)[0].unpersist()
