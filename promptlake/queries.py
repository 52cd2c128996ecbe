"""All registered queries of the library's own operators, with their SQL."""

from __future__ import annotations

from .plans import analytics, chunks, clusters, documents, edits, language, learning, texts  # noqa: F401
from .plans.registry import QUERIES, SQL

FLAGSHIP = "b01_cost_summary"

__all__ = ["FLAGSHIP", "QUERIES", "SQL"]
