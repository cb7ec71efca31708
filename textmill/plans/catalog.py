"""All registered queries of the core."""

from __future__ import annotations

from textmill.plans import queries, queries_files, queries_runs, queries_spaces, queries_state  # noqa: F401  they register themselves
from textmill.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
