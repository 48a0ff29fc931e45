"""Imports every module that registers queries."""

from __future__ import annotations

from eventscope.plans import corpus_queries, more_queries, panel_queries  # noqa: F401
from eventscope.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
