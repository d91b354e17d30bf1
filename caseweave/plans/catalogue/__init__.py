"""Every operator as a named query over the given tables, with its SQL counterpart."""
from . import aggregates, extraction, filters_joins, functions, graph, networks, patterns, streams  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
