"""Exceedance, merged peak ranges and trigger tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import half_up, ratio
from .quantiles import levels_reached
from .windows import along, earlier, past, span

COMPARE = {
    ">=": lambda v, t: v >= t,
    ">": lambda v, t: v > t,
    "<": lambda v, t: v < t,
    "<=": lambda v, t: v <= t,
}


def exceedance(value: Column, threshold: Column, op: str = ">=") -> Column:
    """0/1 flag; a missing value never exceeds."""
    return F.coalesce(COMPARE[op](value, threshold).cast("int"), F.lit(0))


def either_hazard(df: DataFrame, keys: list[str], hazard: str, value: str, limits: dict[str, float],
                  how: str = "or", date: str = "date") -> DataFrame:
    """Combine long hazards per key and date; a hazard without data never exceeds.

    ``how='and'`` asks for every hazard named in ``limits``; ``how='both'`` gives the two flags as ``exceeds_or`` and
    ``exceeds_and`` from one aggregate.
    """
    limit = F.coalesce(*[F.when(F.col(hazard) == n, F.lit(float(v))) for n, v in limits.items()])
    flag = exceedance(F.col(value), limit)
    grouped = df.where(F.col(hazard).isin(list(limits))).groupBy(*keys, date)
    flags = {"or": F.max(flag), "and": (F.sum(flag) == len(limits)).cast("int")}
    if how == "both":
        return grouped.agg(*[c.alias(f"exceeds_{n}") for n, c in flags.items()])
    return grouped.agg(flags[how].alias("exceeds"))


def peak_ranges(df: DataFrame, keys: list[str], exceeds: str, day_range: int,
                date: str = "date", strict_na: bool = False) -> DataFrame:
    """Merge exceedance stretches whose ends reach ``day_range`` rows into the future.

    Adds ``peak_start``, ``peak_no`` (number of starts so far), ``in_range`` and ``triggered``.
    ``strict_na`` keeps the three-valued first row: a series that starts exceeding has no defined
    start, and every later count is unknown.
    """
    w, cum = along(keys, date), past(keys, date)
    e = F.col(exceeds)
    before = F.lag(exceeds).over(w)
    if strict_na:
        start = F.when(e == 0, 0).when(before.isNotNull(), 1 - before)
    else:
        start = F.when((e == 1) & (F.coalesce(before, F.lit(0)) == 0), 1).otherwise(0)
    stop = F.when((e == 1) & (F.lead(exceeds).over(w) == 0), 1).otherwise(0)
    df = df.withColumns({"peak_start": start, "_stop": stop})
    df = df.withColumn("_late", F.coalesce(F.lag("_stop", day_range).over(w), F.lit(0)))
    opened, closed = F.sum("peak_start").over(cum), F.sum("_late").over(cum)
    if strict_na:
        unknown = F.max(F.col("peak_start").isNull().cast("int")).over(cum) == 1
        opened = F.when(~unknown, opened)
    df = df.withColumns({"peak_no": opened.cast("bigint"),
                         "in_range": (opened > closed).cast("int")})
    was = F.lag("in_range").over(w)
    if not strict_na:
        was = F.coalesce(was, F.lit(0))
    fired = F.when((F.col("in_range") == 1) & (was == 0), 1).otherwise(0)
    return df.withColumn("triggered", fired).drop("_stop", "_late")


def score_columns(floods: Column, correct: Column, fired: Column, vain: Column) -> list[Column]:
    """The seven published columns of a trigger row."""
    return [floods.cast("bigint").alias("floods"), correct.cast("bigint").alias("floods_correct"),
            (floods - correct).cast("bigint").alias("floods_incorrect"),
            fired.cast("bigint").alias("protocol_triggered"),
            vain.cast("bigint").alias("triggered_in_vain"),
            half_up(ratio(correct, floods), 2).alias("detection_ratio"),
            half_up(ratio(vain, fired), 2).alias("false_alarm_ratio")]


def trigger_summary(ranges: DataFrame, keys: list[str], event: str) -> DataFrame:
    """Score the merged ranges of one threshold against the events of each key."""
    hit = F.col(event) * F.col("in_range")
    which = F.col("peak_no") * hit
    sums = ranges.groupBy(*keys).agg(
        F.sum(event).alias("_f"), F.sum(hit).alias("_c"), F.sum("triggered").alias("_t"),
        F.count_distinct(which).alias("_ids"))
    vain = F.col("_t") - (F.col("_ids") - 1)
    return sums.select(*keys, *score_columns(F.col("_f"), F.col("_c"), F.col("_t"), vain))


def falling_edge_summary(df: DataFrame, keys: list[str], exceeds: str, event: str,
                         date: str = "date") -> DataFrame:
    """Simple protocol: a trigger is the first row after an exceedance stretch."""
    was = F.lag(exceeds).over(along(keys, date))
    df = df.withColumn("_fall", F.when((F.col(exceeds) == 0) & (was == 1), 1).otherwise(0))
    sums = df.groupBy(*keys).agg(
        F.sum(event).alias("_f"), F.sum(F.col(event) * F.col(exceeds)).alias("_c"),
        F.sum("_fall").alias("_t"))
    vain = F.col("_t") - F.col("_c")
    return sums.select(*keys, *score_columns(F.col("_f"), F.col("_c"), F.col("_t"), vain))


def _bits(n: Column) -> Column:
    """Mask with the lowest ``n`` bits set."""
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), n.cast("int")) - 1


def trigger_table(series: DataFrame, keys: list[str], value: str, event: str, levels: str,
                  percents: list[int], day_range: int, date: str = "date") -> DataFrame:
    """Score every threshold of every series in one pass over its days.

    ``levels`` is an ascending array of thresholds on each row; more than 62 are scored in words of 62. A day is described by how
    many levels it reaches, and everything that follows is a bit per level in one integer: a day is
    in range of a level exactly when one of the last ``day_range`` rows reached it, starts are the
    bits gained since yesterday, and the peaks a flood falls into are told apart by the starts since
    the previous flood. No row is multiplied by the number of thresholds; only the per-key histogram
    of distinct masks is.
    """
    if len(percents) > 62:
        percents, parts = sorted(percents), []
        for i in range(0, len(percents), 62):
            word = series.withColumn(levels, F.slice(levels, i + 1, 62))
            parts.append(trigger_table(word, keys, value, event, levels, percents[i:i + 62], day_range, date))
        return reduce(DataFrame.unionByName, parts)
    w, cum = along(keys, date), past(keys, date)
    df = series.withColumn("_b", levels_reached(F.col(value), F.col(levels), len(percents)))
    df = df.withColumns({
        "_m": F.max("_b").over(span(keys, date, day_range - 1, 0)),
        "_pb": F.coalesce(F.lag("_b").over(w), F.lit(0)),
        "_seen": F.coalesce(F.sum(event).over(earlier(keys, date)), F.lit(0))})
    df = df.withColumns({
        "_starts": F.greatest(_bits(F.col("_b")) - _bits(F.col("_pb")), F.lit(0).cast("bigint")),
        "_pm": F.coalesce(F.lag("_m").over(w), F.lit(0))})
    # rows after one flood up to and including the next share "_seen"
    df = df.withColumn("_since", F.bit_or("_starts").over(past([*keys, "_seen"], date)))
    in_range = _bits(F.col("_m"))
    full = F.lit((1 << len(percents)) - 1).cast("bigint")
    fresh = F.when(F.col("_seen") == 0, full).otherwise(F.col("_since"))
    df = df.withColumns({
        "_fired": F.greatest(in_range - _bits(F.col("_pm")), F.lit(0).cast("bigint")),
        "_hit": F.when(F.col(event) == 1, in_range).otherwise(F.lit(0).cast("bigint")),
        "_new": F.when(F.col(event) == 1, in_range.bitwiseAND(fresh))
                .otherwise(F.lit(0).cast("bigint"))})
    hist = df.groupBy(*keys, "_fired", "_hit", "_new").agg(
        F.count("*").alias("_rows"), F.sum(event).alias("_floods"))

    def count_bit(mask: str, i: int) -> Column:
        return F.sum(F.when(F.col(mask).bitwiseAND(F.lit(1 << i).cast("bigint")) != 0,
                            F.col("_rows")).otherwise(0))

    cells = []
    for i, p in enumerate(sorted(percents)):
        cells.append(F.struct(F.lit(p).alias("percent"), count_bit("_hit", i).alias("c"),
                              count_bit("_fired", i).alias("t"), count_bit("_new", i).alias("u")))
    table = hist.groupBy(*keys).agg(F.sum("_rows").alias("_n"), F.sum("_floods").alias("_f"),
                                    F.array(*cells).alias("_cells"))
    flat = table.select(*keys, "_n", "_f", F.explode("_cells").alias("_c"))
    correct, fired = F.col("_c.c"), F.col("_c.t")
    has_zero = (F.col("_n") > correct).cast("int")
    vain = fired - (F.col("_c.u") + has_zero - 1)
    return flat.select(*keys, F.col("_c.percent").alias("percent"),
                       *score_columns(F.col("_f"), correct, fired, vain))


def best_row(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """First row per key under ``order``, found by a combinable minimum instead of a window.

    Every order term must be numeric and ascending; nulls come last.
    """
    terms = []
    for i, o in enumerate(order):
        terms += [o.isNull().alias(f"n{i}"), o.alias(f"o{i}")]
    cols = [c for c in df.columns if c not in keys]
    packed = df.select(*keys, F.struct(*terms).alias("_o"), F.struct(*cols).alias("_row"))
    best = packed.groupBy(*keys).agg(F.min_by("_row", "_o").alias("_row"))
    return best.select(*keys, "_row.*")


def return_period_triggers(forecast: DataFrame, keys: list[str], members: str, levels: DataFrame,
                           probability: float, gap_days: int, date: str = "date") -> DataFrame:
    """Dates on which enough members exceed a return level, thinned by a cooldown.

    ``forecast`` has one row per key and date with the member array; ``levels`` is
    ``(keys, period, level)``.
    """
    from ..functions.scalar import members_over
    from .series import cooldown
    act = members_over(F.col(members), F.col("level"))
    hot = (forecast.join(levels, keys).select(*keys, date, "period", act.alias("act"))
           .where(F.col("act") >= probability))
    return cooldown(hot, [*keys, "period"], gap_days, date)
