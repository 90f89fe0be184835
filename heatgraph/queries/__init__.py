"""The operators as queries over the driver's star schema, each beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function ``(spark, sf_dir) -> DataFrame`` by its name, with its SQL."""

    def take(function: Callable) -> Callable:
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLE_SQL[function.__name__] = sql
        return function

    return take


from heatgraph.queries import consensus, heat, network, scans, views  # noqa: E402,F401
