"""Queries over the given tables, one per operator."""

from curvine.queries import vectors, joins, clusters, coresets, actives, oods, metrics, texts, sources  # noqa: F401
from curvine.queries.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
