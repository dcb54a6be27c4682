"""Where queries, their SQL and the tables behind them meet."""

from __future__ import annotations

import os
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strandwise.plans.scratch import scratch_folder

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "benchmark", "pages", "conversations")


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query and, where SQL can say the same, its oracle (over fixtures as ``{name}``)."""

    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = duck(oracle)
        return fn

    return register


#: Derived inputs, written once in the SQL that both engines share; ``<g>`` is where DuckDB wants its global flag.
FIXTURES: dict[str, str] = {}


def duck(sql: str) -> str:
    """``{name}`` becomes a table of the driver or a fixture in parentheses, in DuckDB's dialect."""

    def put(m: re.Match) -> str:
        name = m[1]
        return name if name in TABLES else f"({duck(FIXTURES[name])})"

    return re.sub(r"\{(\w+)\}", put, sql).replace("<g>", ", 'g'")


def table_state(spark: SparkSession, path: str) -> tuple[int, int]:
    """When a table was last written and its bytes, which tell whether what was derived from it still holds."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return system.getFileStatus(at).getModificationTime(), system.getContentSummary(at).getLength()


#: Fixtures that most queries read: the texts turned to sequences, and the reads cut from them.
KEPT = ("dna", "reads", "reads_pe", "reads_long")
_KEPT: dict[tuple[str, str, str], tuple[tuple[int, int], str]] = {}


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The fixture as a DataFrame over the Parquet tables below ``sf_dir``.

    Those of ``KEPT`` are written once a session, as a user's sequence files
    are, and again if the documents were written since.
    """
    if name not in KEPT:
        return _derived(spark, sf_dir, name)
    state = table_state(spark, os.path.join(sf_dir, "documents.parquet"))
    key = spark.sparkContext.applicationId, sf_dir, name
    if key not in _KEPT or _KEPT[key][0] != state:
        folder = scratch_folder(spark, name)
        _derived(spark, sf_dir, name).write.parquet(folder)
        _KEPT[key] = state, folder
    return spark.read.parquet(_KEPT[key][1])


def _derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    found: dict[str, DataFrame] = {}

    def put(m: re.Match) -> str:
        if m[1] in TABLES:
            found.setdefault(m[1], spark.read.parquet(os.path.join(sf_dir, f"{m[1]}.parquet")))
            return "{" + m[1] + "}"
        if m[1] in KEPT:
            found.setdefault(m[1], fixture(spark, sf_dir, m[1]))
            return "{" + m[1] + "}"
        return f"({re.sub(r'\{(\w+)\}', put, FIXTURES[m[1]])})"

    sql = re.sub(r"\{(\w+)\}", put, FIXTURES[name]).replace("<g>", "")
    return spark.sql(sql, **found)
