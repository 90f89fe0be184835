"""Joins that broadcast a side only after its size has been checked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_checked(left: DataFrame, right: DataFrame, on, how: str = "left", max_rows: int = 50_000) -> DataFrame:
    """Join; ``right`` (cheap to count: a cut or stored table) is broadcast up to ``max_rows`` rows.

    Beyond that both sides are shuffled, where adaptive execution may split skewed keys.
    """
    small = right.limit(max_rows + 1).count() <= max_rows
    return left.join(F.broadcast(right) if small else right, on, how)
