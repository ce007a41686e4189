"""One place for window specs, so that operators on the same series share one sort."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


def along(keys: list[str], order: str | list[str]) -> WindowSpec:
    """Rows of one series in time order."""
    order = [order] if isinstance(order, str) else order
    return Window.partitionBy(*keys).orderBy(*order)


def span(keys: list[str], order: str | list[str], before: int, after: int) -> WindowSpec:
    """Row frame from ``before`` rows back to ``after`` rows on."""
    return along(keys, order).rowsBetween(-before, after)


def past(keys: list[str], order: str | list[str]) -> WindowSpec:
    return along(keys, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def ahead(keys: list[str], order: str) -> WindowSpec:
    """The current and all later rows, nearest first.

    Read backwards, so that each row adds to a running state; a frame that ends at the last row
    would be evaluated anew for every row.
    """
    return past(keys, [F.desc(order)])


def whole(keys: list[str], order: str | None = None) -> WindowSpec:
    """The whole series; give ``order`` to share the sort of the ordered frames."""
    if order is None:
        return Window.partitionBy(*keys)
    return along(keys, order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def earlier(keys: list[str], order: str | list[str]) -> WindowSpec:
    """All rows strictly before the current one."""
    return along(keys, order).rowsBetween(Window.unboundedPreceding, -1)
