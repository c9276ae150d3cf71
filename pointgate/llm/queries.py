"""All queries of this package."""

from __future__ import annotations

from pointgate.llm import plan_linkage, plan_overlap, plan_sampling, plan_splits, plan_text  # noqa: F401
from pointgate.llm.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
