"""Whole workflows over any hazard, mapping and event tables.

Expected columns: ``hazard(station, date, value)`` with one row per station and day,
``mapping(station, zone)``, ``events(zone, date)``; more columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import quantiles as Q
from ..operators import skill as K
from ..operators import spatial as G
from ..operators import triggers as X
from ..operators.indices import z_score
from ..operators.joining import join_dimension
from ..operators.series import filled_with_marks, spread
from ..operators.windows import along
from ..sources.writers import upsert


def flagged_stations(hazard: DataFrame, mapping: DataFrame, events: DataFrame,
                     zero: list[str] | None = None) -> DataFrame:
    """Dense station series with the 0/1 event flag of the station's zone."""
    days = events.select("zone", "date").distinct()
    n = mapping.count()
    # each station takes the days of its zone where it lies, else a few tasks would make the marks of all
    marks = join_dimension(spread(mapping.select("station", "zone"), ["station"], n), days, ["zone"]).select("station", "date")
    filled = filled_with_marks(hazard, marks, ["station"], "value", zero or [], n_series=n)
    return filled.join(mapping.select("station", "zone"), "station")


def lead_series(flagged: DataFrame, leads: list[int]) -> DataFrame:
    """Each station series once per lead time, the value taken ``lead`` days ahead."""
    w = along(["station"], "date")
    ahead = F.array(*[F.struct(F.lit(k).alias("lead"), F.lead("value", k).over(w).alias("v")) for k in leads])
    return (flagged.withColumn("_l", ahead).select("zone", "station", "date", "event", F.inline("_l"))
            .where(F.col("v").isNotNull()).withColumnRenamed("v", "value"))


def warning_table(flagged: DataFrame, leads: list[int], percents: list[int], day_range: int) -> DataFrame:
    """Trigger scores of every zone, station, lead time and threshold that detects anything."""
    keys = ["zone", "station", "lead"]
    leveled = Q.with_levels(lead_series(flagged, leads), keys, "value", percents)
    table = X.trigger_table(leveled, keys, "value", "event", "levels", percents, day_range)
    return table.where(F.col("detection_ratio") > 0)


def best_warnings(table: DataFrame, weight_false_alarms: float = 0.5) -> DataFrame:
    """The row of each zone with the smallest weighted loss; longer leads win ties."""
    w = weight_false_alarms
    loss = w * F.col("false_alarm_ratio") + (1 - w) * (1 - F.col("detection_ratio"))
    return X.best_row(table, ["zone"], loss, -F.col("lead"), F.col("station"), F.col("percent"))


def station_skill(flagged: DataFrame, hazard: DataFrame, block: Column, percents: list[int],
                  hits: str = "per_period") -> DataFrame:
    """Period skill of every station at quantiles of its own observed block maxima."""
    probs = F.array(*[F.lit(p / 100.0) for p in sorted(percents)])
    maxima = Q.block_maxima(hazard, ["station"], "value", block)
    levels = maxima.groupBy("station").agg(F.percentile("block_max", probs).alias("q")).select(
        "station", F.transform("q", lambda x: F.round(x, 6)).alias("levels"))
    return K.threshold_sweep(flagged.join(levels, "station"), ["zone", "station"], "value", "event",
                             "levels", percents, hits)


def best_thresholds(scores: DataFrame, weight_false_alarms: float = 0.5) -> DataFrame:
    """Station and threshold of each zone with the smallest ``w * far + (1 - w) * (1 - pod)``."""
    w = weight_false_alarms
    scored = scores.withColumn("objective", F.round(w * F.col("far") + (1 - w) * (1 - F.col("pod")), 6))
    return X.best_row(scored, ["zone"], F.col("objective"), F.col("station"), F.col("percent"))


def refresh_indicator(cells: DataFrame, bridge: DataFrame, table: str, indicator: str, level: int = 1,
                      cell: tuple[str, str] = ("iy", "ix")) -> str:
    """Add new grid rows of one indicator to the stored zone series.

    ``bridge`` holds the cells of each zone that pass the land-use mask. Zone means replace stored rows
    with the same zone and date, so a refresh can be repeated or overlap the last one.
    """
    means = G.zonal_stats(cells, bridge, list(cell), ["zone", "date"], "value").select(
        "zone", "date", F.col("mean").alias("value"), F.lit(level).alias("admin_lvl"),
        F.lit(indicator).alias("indicator"), F.year("date").alias("year"))
    return upsert(means, table, ["zone", "date", "indicator"], ["admin_lvl", "indicator", "year"])


def standardised_indicator(stored: DataFrame) -> DataFrame:
    """Stored zone series as deviations from the zone's own month, in standard deviations."""
    keyed = stored.withColumn("month", F.month("date"))
    return z_score(keyed, ["zone", "indicator", "month"], "value", "normal", sd="population")
