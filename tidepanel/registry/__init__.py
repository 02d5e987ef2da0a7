"""Registered queries: every operator on the given tables, beside the SQL that must give the same rows."""

from tidepanel.registry.base import ORACLES, QUERIES
from tidepanel.registry import (  # noqa: F401  (importing registers the queries)
    entities,
    facts,
    hierarchy,
    loading,
    scalars,
    summaries,
    texts,
)

__all__ = ["ORACLES", "QUERIES"]
