"""All queries of the engine and their SQL."""

from __future__ import annotations

import strandwise.plans.align_queries
import strandwise.plans.longread_queries
import strandwise.plans.pairing_queries
import strandwise.plans.region_queries
import strandwise.plans.scalar_queries
import strandwise.plans.search_queries
import strandwise.plans.source_queries  # noqa: F401
from strandwise.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
