"""Every query of the core library by name, with its DuckDB twin where SQL can express it."""

from __future__ import annotations

from stratakit.plans import corpus, events, graphs, health, knowledge, language, library, relational, retrieval, structure, upkeep  # noqa: F401 - each registers its queries
from stratakit.plans.base import ORACLE_SQL, QUERIES

FLAGSHIP = "search_hybrid"

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
