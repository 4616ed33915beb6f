"""Named queries and the SQL that gives the same rows."""

from __future__ import annotations

from threadloom.plans import rendered  # noqa: F401  (registers its queries)
from threadloom.plans.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
