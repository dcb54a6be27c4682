"""Queries and SQL of the subpackage, gathered for the entry module."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MODULES = (
    "op1_pii",
    "op2_bitplane",
    "op3_sharding",
    "op4_secrets",
    "op5_simhash",
    "op6_mixing",
    "op7_quality",
    "op8_decontaminate",
    "op9_separators",
    "op10_warc",
)


def _gather(name: str) -> dict:
    out: dict = {}
    for module in MODULES:
        out |= getattr(importlib.import_module(f"strandwise.llm.{module}"), name)
    return out


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _gather("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _gather("ORACLES")
