"""Joins with a side whose size is checked before it is broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_BROADCAST_ROWS = 200_000


def join_dimension(fact: DataFrame, dim: DataFrame, on: list[str], how: str = "inner",
                   max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Join a dimension of narrow rows, broadcast only after its row count was checked.

    A larger dimension takes the ordinary shuffled join, where AQE splits skewed keys.
    """
    small = dim.limit(max_rows + 1).count() <= max_rows
    return fact.join(F.broadcast(dim) if small else dim, on, how)
