"""Daily and monthly series: collapse, scaffold, fill, interpolate.

Every series operator works on one row per key and calendar step. ``collapse`` makes that shape with
a map-side combined aggregate, so the length of a series is bounded by the calendar however many raw
rows one key holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .windows import ahead, along, past, whole


def collapse(df: DataFrame, keys: list[str], date: str, aggs: dict[str, Column],
             step: str = "day") -> DataFrame:
    """One row per key and calendar step."""
    when = F.to_date(F.col(date)) if step == "day" else F.trunc(F.col(date), step)
    return (df.groupBy(*keys, when.alias("date"))
            .agg(*[c.alias(name) for name, c in aggs.items()]))


#: Series that share a task once their calendar is opened.
SERIES = 256


def spread(df: DataFrame, keys: list[str], series: int) -> DataFrame:
    """Rows dealt by key to a task for every ``SERIES`` of the ``series``, so that what a task holds does not grow with their number.

    Opening the calendar and taking leads makes many days of the few bytes that are shuffled; left to the size of the shuffle, tasks would be few.
    """
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-series // SERIES)), *keys)


def scaffold(df: DataFrame, keys: list[str], date: str = "date", step: str = "1 day",
             start: Column | None = None, end: Column | None = None) -> DataFrame:
    """Every calendar step from the first to the last date of each key.

    ``start`` and ``end`` (literals or scalar subqueries) give all keys the same span. The dates are
    generated next to their key; no cross join is planned.
    """
    bounds = df.groupBy(*keys).agg(F.min(date).alias("lo"), F.max(date).alias("hi"))
    lo = start if start is not None else F.col("lo")
    hi = end if end is not None else F.col("hi")
    days = F.sequence(lo, hi, F.expr(f"INTERVAL {step}"))
    return bounds.select(*keys, F.explode(days).alias(date))


def densify(df: DataFrame, keys: list[str], date: str = "date", step: str = "1 day",
            start: Column | None = None, end: Column | None = None) -> DataFrame:
    """The series on its full calendar, with null where nothing was observed.

    Every row opens the steps up to the next one, so the calendar is made where the series lies: the
    input is neither read twice nor joined to a scaffold. ``start`` and ``end`` widen all keys to one
    span. Rows must be unique per key and date.
    """
    w = along(keys, date)
    unit = F.expr(f"INTERVAL {step}")
    lo, hi = F.col(date), (F.lead(date).over(w) - unit).cast("date")
    if start is not None:
        lo = F.when(F.lag(date).over(w).isNull(), F.least(start, F.col(date))).otherwise(F.col(date))
    last = F.col(date) if end is None else F.greatest(end, F.col(date))
    opened = df.withColumns({"_lo": lo, "_hi": F.coalesce(hi, last)})
    values = [c for c in df.columns if c not in (*keys, date)]
    days = opened.withColumn("_step", F.explode(F.sequence("_lo", "_hi", unit)))
    kept = [F.when(F.col("_step") == F.col(date), F.col(c)).alias(c) for c in values]
    return days.select(*keys, F.col("_step").alias(date), *kept)


def locf(df: DataFrame, keys: list[str], cols: list[str], date: str = "date",
         direction: str = "down") -> DataFrame:
    """Carry the last value forward; ``downup`` also fills the leading gap backwards."""
    out = {}
    for c in cols:
        filled = F.last(c, ignorenulls=True).over(past(keys, date))
        if direction == "downup":
            # only the gap before the first observation is left
            earliest = F.min_by(c, F.when(F.col(c).isNotNull(), F.col(date))).over(whole(keys, date))
            filled = F.coalesce(filled, earliest)
        out[c] = filled
    return df.withColumns(out)


def interpolate(df: DataFrame, keys: list[str], value: str, date: str = "date",
                out: str | None = None) -> DataFrame:
    """Linear interpolation between the observations around each gap."""
    seen = F.when(F.col(value).isNotNull(), F.col(date))
    prev_v = F.last(value, ignorenulls=True).over(past(keys, date))
    prev_d = F.last(seen, ignorenulls=True).over(past(keys, date))
    next_v = F.last(value, ignorenulls=True).over(ahead(keys, date))
    next_d = F.last(seen, ignorenulls=True).over(ahead(keys, date))
    gap = F.datediff(next_d, prev_d)
    line = prev_v + (next_v - prev_v) * F.try_divide(
        F.datediff(F.col(date), prev_d).cast("double"), gap.cast("double"))
    return df.withColumn(out or value, F.coalesce(F.col(value), line))


def clip_to_events(series: DataFrame, events: DataFrame, keys: list[str], days: int,
                   date: str = "date") -> DataFrame:
    """Keep the days from ``days`` before the first to ``days`` after the last event of each key."""
    bounds = events.groupBy(*keys).agg(F.date_sub(F.min(date), days).alias("lo"),
                                       F.date_add(F.max(date), days).alias("hi"))
    return (series.join(bounds, keys)
            .where(F.col(date).between(F.col("lo"), F.col("hi"))).drop("lo", "hi"))


def filled_with_marks(series: DataFrame, marks: DataFrame, keys: list[str], value: str,
                      zero: list[str], flag: str = "event", date: str = "date", n_series: int | None = None) -> DataFrame:
    """Dense, filled series with a 0/1 flag on the marked days, from one shuffle of the sparse rows.

    The marks meet the observations while both are sparse and partitioned by key and day; the calendar
    is opened afterwards. ``value`` is filled down then up, the columns in ``zero`` with 0. Days before
    the first and after the last observation of a key are left out. ``n_series``, about how many keys there are, spreads many of them (see ``spread``).
    """
    marked = marks.select(*keys, date).distinct().withColumn(flag, F.lit(1))
    both = series.join(marked, [*keys, date], "full_outer")
    if n_series is not None:
        both = spread(both, keys, n_series)
    g = whole(keys, date)
    seen = F.when(F.col(value).isNotNull(), F.col(date))
    both = both.withColumns({"_first": F.min(seen).over(g), "_last": F.max(seen).over(g)})
    inside = both.where(F.col(date).between(F.col("_first"), F.col("_last"))).drop("_first", "_last")
    dense = locf(densify(inside, keys, date), keys, [value], date)
    return dense.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in (*zero, flag)})


def attach_flag(series: DataFrame, events: DataFrame, keys: list[str], flag: str = "event",
                date: str = "date") -> DataFrame:
    """0/1 event flag per row; several reports of one day count once and never duplicate rows."""
    marks = events.select(*keys, date).distinct().withColumn(flag, F.lit(1))
    return (series.join(marks, [*keys, date], "left")
            .withColumn(flag, F.coalesce(F.col(flag), F.lit(0))))


def cooldowns(df: DataFrame, keys: list[str], modes: dict[str, int], date: str = "date") -> DataFrame:
    """Thin exceedances in time, by one or both rules from one window; adds ``mode`` and ``gap_days``.

    ``since_previous`` keeps a row more than its days after the exceedance before it (the first row stays, its gap is
    null); ``until_next`` keeps a row whose successor is more than its days away (the last row goes).
    """
    w = along(keys, date)
    gaps = {"since_previous": F.datediff(F.col(date), F.lag(date).over(w)),
            "until_next": F.datediff(F.lead(date).over(w), F.col(date))}
    rows = df.withColumn("_g", F.array(*[
        F.struct(F.lit(m).alias("mode"), gaps[m].alias("gap_days"), F.lit(days).alias("days")) for m, days in modes.items()]))
    kept = F.filter("_g", lambda g: (g["gap_days"] > g["days"]) | (g["gap_days"].isNull() & (g["mode"] == "since_previous")))
    return rows.withColumn("_g", F.explode(kept)).select(*df.columns, "_g.mode", "_g.gap_days")


def cooldown(df: DataFrame, keys: list[str], days: int, date: str = "date",
             mode: str = "since_previous") -> DataFrame:
    """Thin exceedances in time by one rule of ``cooldowns``."""
    return cooldowns(df, keys, {mode: days}, date).drop("mode")
