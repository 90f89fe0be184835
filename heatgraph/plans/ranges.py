"""Deterministic ranges of an integer key, so that a global order can be dealt over many tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def range_bounds(df: DataFrame, col: str, ranges: int) -> list[int]:
    """At most ``ranges - 1`` ascending cut points of a numeric column, about equal in rows.

    A few hundred numbers from one scan of the column alone; nulls are not counted.
    """
    if ranges < 2:
        return []
    cuts = df.select(F.col(col).cast("double").alias("k")).approxQuantile(
        "k", [i / ranges for i in range(1, ranges)], 1 / (4 * ranges)
    )
    return sorted({int(c) for c in cuts})


def range_index(key: Column, bounds: list[int]) -> Column:
    """How many of ``bounds`` are at or below ``key``: equal keys always share a range.

    Two levels, so that a row costs about twice the square root of the number of bounds.
    """
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    blocks = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    tops = F.array(*[F.lit(b[0]).cast("bigint") for b in blocks])
    nested = F.array(*[F.array(*[F.lit(x).cast("bigint") for x in b]) for b in blocks])
    block = F.size(F.filter(tops, lambda b: b <= key))
    inside = F.size(F.filter(F.element_at(nested, F.greatest(block, F.lit(1))), lambda b: b <= key))
    return F.when(block == 0, F.lit(0)).otherwise((block - 1) * step + inside)
