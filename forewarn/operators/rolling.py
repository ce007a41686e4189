"""Rolling features, runs and neighbourhood windows over one series per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import along, past, span

REDUCERS = {"sum": F.sum, "mean": F.avg, "max": F.max, "min": F.min}


def rolling_centred_max(df: DataFrame, keys: list[str], value: str, out: str, before: int = 3,
                        after: int = 3, min_periods: int = 3, date: str = "date") -> DataFrame:
    """Centred rolling maximum, null unless ``min_periods`` values are present.

    An incomplete window is demanded away by ``min_periods = before + after + 1``.
    """
    w = span(keys, date, before, after)
    enough = F.count(value).over(w) >= min_periods
    return df.withColumn(out, F.when(enough, F.max(value).over(w)))


def rolling_trailing(df: DataFrame, keys: list[str], value: str, out: str, n: int,
                     how: str = "sum", full: bool = True, date: str = "date") -> DataFrame:
    """Trailing statistic of ``n`` rows; ``full`` gives null before ``n`` values exist."""
    w = span(keys, date, n - 1, 0)
    stat = REDUCERS[how](value).over(w)
    if full:
        stat = F.when(F.count(value).over(w) >= n, stat)
    return df.withColumn(out, stat)


def rolling_days(df: DataFrame, keys: list[str], value: str, days: list[int],
                 date: str = "date") -> DataFrame:
    """Trailing calendar-day maxima and sums for several spans in one sorted pass."""
    df = df.withColumn("_day", F.unix_date(date))
    w = along(keys, "_day")
    cols: dict[str, Column] = {}
    for t in days:
        frame = w.rangeBetween(-t, 0)
        cols[f"{value}_max_{t}"] = F.max(value).over(frame)
        cols[f"{value}_cum_{t}"] = F.sum(value).over(frame)
    return df.withColumns(cols).drop("_day")


def shifts(df: DataFrame, keys: list[str], value: str, lags: list[int],
           date: str = "date") -> DataFrame:
    """Lagged (positive) and leading (negative) copies, never across keys."""
    w = along(keys, date)
    return df.withColumns({
        f"{value}_lag{k}" if k >= 0 else f"{value}_lead{-k}":
        F.lag(value, k).over(w) if k >= 0 else F.lead(value, -k).over(w) for k in lags})


def runs(df: DataFrame, keys: list[str], flag: str, date: str = "date") -> DataFrame:
    """Number the stretches of equal ``flag`` and the position of each row in its stretch."""
    prev = F.lag(flag).over(along(keys, date))
    changed = F.when(prev.isNull() | (prev != F.col(flag)), 1).otherwise(0)
    df = df.withColumn("_changed", changed)
    df = df.withColumn("run_id", F.sum("_changed").over(past(keys, date)).cast("bigint"))
    return (df.withColumn("run_pos", F.row_number().over(along([*keys, "run_id"], date)))
            .drop("_changed"))


def moving_years(df: DataFrame, keys: list[str], value: str, years: int = 5,
                 year: str = "year") -> DataFrame:
    """Mean of the trailing ``years`` calendar years (all must be present), deviation and its z."""
    w = along(keys, year).rangeBetween(-(years - 1), 0)
    mean = F.when(F.count(value).over(w) >= years, F.avg(value).over(w))
    df = df.withColumn("moving_mean", mean)
    df = df.withColumn("deviation", F.col(value) - F.col("moving_mean"))
    g = Window.partitionBy(*keys)
    z = F.try_divide(F.col("deviation") - F.avg("deviation").over(g),
                     F.stddev_samp("deviation").over(g))
    return df.withColumn("deviation_z", z)


def crop_around(df: DataFrame, keys: list[str], flag: str, before: int, after: int,
                date: str = "date") -> DataFrame:
    """Rows within ``before``/``after`` rows of a flagged one, each once."""
    near = F.max(flag).over(span(keys, date, after, before))
    return df.withColumn("_near", near).where(F.col("_near") == 1).drop("_near")


def extend_alarms(df: DataFrame, keys: list[str], alarm: str, event: str, n: int = 2,
                  date: str = "date") -> DataFrame:
    """Move alarms within ``n`` rows of an event onto the event and clear the others there."""
    w = span(keys, date, n, n)
    near_alarm = F.max(alarm).over(w)
    near_event = F.max(event).over(w)
    moved = (F.when(F.col(event) == 1, near_alarm)
             .when(near_event == 1, F.lit(0)).otherwise(F.col(alarm)))
    return df.withColumn("_moved", moved).withColumn(alarm, F.col("_moved")).drop("_moved")


def rolling_origin(df: DataFrame, keys: list[str], value: str, train: int = 48,
                   date: str = "date") -> DataFrame:
    """One row per test step: the span and the mean of the ``train`` steps before it."""
    w = span(keys, date, train, -1)
    return (df.withColumns({
        "train_start": F.min(date).over(w), "train_end": F.max(date).over(w),
        "train_rows": F.count(F.lit(1)).over(w), "train_mean": F.avg(value).over(w)})
        .where(F.col("train_rows") == train))


def dry_spells(df: DataFrame, keys: list[str], value: str, n: int, limit: float = 2.0,
               date: str = "date") -> DataFrame:
    """Dry-day flag: the trailing ``n``-row sum stays within ``limit``; short windows are not dry."""
    df = rolling_trailing(df, keys, value, "_acc", n, "sum", True, date)
    return (df.withColumn("dry", F.coalesce((F.col("_acc") <= limit).cast("int"), F.lit(0)))
            .drop("_acc"))
