"""Registry of the network-analytics queries."""

from __future__ import annotations

from heatgraph.queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
