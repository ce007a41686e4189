"""Domain view of the star schema: stations, zones, hazards, events, forecasts, grids.

The Spark functions and the SQL texts in ``COMMON`` describe the same tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.series import collapse, densify, filled_with_marks, locf, spread

COMMON: dict[str, str] = {
    "all_reports": """
SELECT CAST(c_nationkey AS BIGINT) AS zone, CAST(o_orderdate AS DATE) AS date,
       o_totalprice AS severity, o_orderkey AS report, o_orderpriority AS class, o_orderstatus AS status
FROM orders JOIN customer ON o_custkey = c_custkey""",
    "impact_reports": """
SELECT zone, date, severity, report FROM all_reports WHERE class = '1-URGENT' AND status = 'F'""",
    "event_days": """SELECT DISTINCT zone, date FROM impact_reports""",
    "station_days": """
SELECT l_suppkey AS station, CAST(l_shipdate AS DATE) AS date, sum(l_quantity) AS value,
       round(sum(l_extendedprice), 2) AS rain FROM lineitem GROUP BY 1, 2""",
    "station_dense": """
SELECT c.station, c.date, d.value, d.rain FROM (
  SELECT station, CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date
  FROM station_days GROUP BY station) c LEFT JOIN station_days d USING (station, date)""",
    "station_filled": """
SELECT station, date, coalesce(
  last_value(value IGNORE NULLS) OVER (PARTITION BY station ORDER BY date),
  first_value(value IGNORE NULLS) OVER (PARTITION BY station ORDER BY date
    ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS value,
  coalesce(rain, 0.0) AS rain FROM station_dense""",
    "station_flagged": """
SELECT f.station, CAST(s_nationkey AS BIGINT) AS zone, f.date, f.value, f.rain,
       CASE WHEN e.zone IS NULL THEN 0 ELSE 1 END AS event
FROM station_filled f JOIN supplier ON f.station = s_suppkey
LEFT JOIN event_days e ON e.zone = s_nationkey AND e.date = f.date""",
    "zone_days": """
SELECT CAST(s_nationkey AS BIGINT) AS zone, date, sum(value) AS value, round(sum(rain), 2) AS rain
FROM station_days JOIN supplier ON station = s_suppkey GROUP BY 1, 2""",
    "zone_dense": """
SELECT c.zone, c.date, d.value, d.rain FROM (
  SELECT zone, CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date
  FROM zone_days GROUP BY zone) c LEFT JOIN zone_days d USING (zone, date)""",
    "zone_filled": """
SELECT zone, date, coalesce(
  last_value(value IGNORE NULLS) OVER (PARTITION BY zone ORDER BY date),
  first_value(value IGNORE NULLS) OVER (PARTITION BY zone ORDER BY date
    ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS value,
  coalesce(rain, 0.0) AS rain FROM zone_dense""",
    "zone_months": """
SELECT zone, CAST(date_trunc('month', date) AS DATE) AS date, sum(value) AS value,
       round(sum(rain), 2) AS rain FROM zone_days GROUP BY 1, 2""",
    "zone_flagged": """
SELECT f.zone, f.date, f.value, f.rain, CASE WHEN e.zone IS NULL THEN 0 ELSE 1 END AS event
FROM zone_filled f LEFT JOIN event_days e USING (zone, date)""",
    "station_places": """
SELECT s_suppkey AS station, CAST(s_nationkey AS BIGINT) AS zone,
       CAST((s_suppkey * 7) % 100 AS BIGINT) AS iy, CAST((s_suppkey * 13) % 97 AS BIGINT) AS ix,
       ((s_suppkey * 7) % 100) / 10.0 + 0.05 AS lat, ((s_suppkey * 13) % 97) / 10.0 + 0.05 AS lon
FROM supplier""",
    "zone_shapes": """
SELECT CAST(n_nationkey AS BIGINT) AS zone, CAST(n_regionkey AS BIGINT) AS region,
       (n_nationkey % 5) * 2.0 + 1.0 AS cx, (n_nationkey // 5) * 2.0 + 1.0 AS cy, 1.23 AS r FROM nation""",
    "cell_days": """
SELECT iy, ix, date, sum(value) AS value FROM station_days JOIN station_places USING (station)
GROUP BY 1, 2, 3""",
    "cells": """SELECT DISTINCT iy, ix, lat, lon FROM station_places""",
    "cell_zone": """
SELECT c.iy, c.ix, z.zone FROM cells c JOIN zone_shapes z
ON abs(c.lon - z.cx) + abs(c.lat - z.cy) < z.r""",
}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def station_days(spark, sf) -> DataFrame:
    """Hazard series: one row per station and day with an observation."""
    li = table(spark, sf, "lineitem").withColumnRenamed("l_suppkey", "station")
    return collapse(li, ["station"], "l_shipdate", {
        "value": F.sum("l_quantity"), "rain": F.round(F.sum("l_extendedprice"), 2)})


def mapping(spark, sf) -> DataFrame:
    """Station to zone."""
    return table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("station"), F.col("s_nationkey").cast("bigint").alias("zone"))


def spread_stations(spark, sf) -> DataFrame:
    """Station days dealt to tasks by the number of stations, before their calendar is opened."""
    return spread(station_days(spark, sf), ["station"], mapping(spark, sf).count())


def zone_days(spark, sf) -> DataFrame:
    """Zone series; stations are collapsed to days before they meet the mapping."""
    return (station_days(spark, sf).join(mapping(spark, sf), "station").groupBy("zone", "date")
            .agg(F.sum("value").alias("value"), F.round(F.sum("rain"), 2).alias("rain")))


def _filled(df: DataFrame, key: str) -> DataFrame:
    dense = densify(df, [key])
    return locf(dense, [key], ["value"], direction="downup").withColumn(
        "rain", F.coalesce("rain", F.lit(0.0)))


def station_dense(spark, sf) -> DataFrame:
    return densify(spread_stations(spark, sf), ["station"])


def station_filled(spark, sf) -> DataFrame:
    return _filled(spread_stations(spark, sf), "station")


def zone_dense(spark, sf) -> DataFrame:
    return densify(zone_days(spark, sf), ["zone"])


def zone_filled(spark, sf) -> DataFrame:
    return _filled(zone_days(spark, sf), "zone")


def zone_months(spark, sf) -> DataFrame:
    return (zone_days(spark, sf).groupBy("zone", F.trunc("date", "month").alias("date"))
            .agg(F.sum("value").alias("value"), F.round(F.sum("rain"), 2).alias("rain")))


def reports(spark, sf) -> DataFrame:
    """All reports per zone and date, with their severity, class and status."""
    customer = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    return table(spark, sf, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("c_nationkey").cast("bigint").alias("zone"), F.to_date("o_orderdate").alias("date"),
        F.col("o_totalprice").alias("severity"), F.col("o_orderkey").alias("report"),
        F.col("o_orderpriority").alias("class"), F.col("o_orderstatus").alias("status"))


#: What makes a report an impact event: closed reports of the highest class.
EVENT_CLASS, EVENT_STATUS = "1-URGENT", "F"


def events(spark, sf) -> DataFrame:
    """Reports that count as impact events."""
    return reports(spark, sf).where((F.col("class") == EVENT_CLASS) & (F.col("status") == EVENT_STATUS)).drop(
        "class", "status")


def event_days(spark, sf) -> DataFrame:
    return events(spark, sf).select("zone", "date").distinct()


def zone_flagged(spark, sf) -> DataFrame:
    """Filled zone series with the event flag."""
    return filled_with_marks(zone_days(spark, sf), event_days(spark, sf), ["zone"], "value", ["rain"])


def station_flagged(spark, sf) -> DataFrame:
    """Filled station series with the event flag of the station's zone."""
    from .pipelines import flagged_stations
    return flagged_stations(station_days(spark, sf), mapping(spark, sf), event_days(spark, sf), ["rain"])


def station_places(spark, sf) -> DataFrame:
    """Stations on a 0.1 degree grid of 100 x 97 cells."""
    k = F.col("s_suppkey")
    iy, ix = (k * 7) % 100, (k * 13) % 97
    return table(spark, sf, "supplier").select(
        k.alias("station"), F.col("s_nationkey").cast("bigint").alias("zone"), iy.alias("iy"),
        ix.alias("ix"), (iy / 10.0 + 0.05).alias("lat"), (ix / 10.0 + 0.05).alias("lon"))


def zone_shapes(spark, sf) -> DataFrame:
    """Zones as closed rings (diamonds on a 5 x 5 lattice that overlap their neighbours)."""
    n = F.col("n_nationkey")
    cx, cy, r = (n % 5) * 2.0 + 1.0, F.floor(n / 5) * 2.0 + 1.0, 1.23

    def corner(dx: float, dy: float):
        return F.struct((cx + dx).alias("x"), (cy + dy).alias("y"))

    ring = F.array(corner(r, 0), corner(0, r), corner(-r, 0), corner(0, -r), corner(r, 0))
    return table(spark, sf, "nation").select(
        n.cast("bigint").alias("zone"), F.col("n_regionkey").cast("bigint").alias("region"),
        cx.alias("cx"), cy.alias("cy"), ring.alias("ring"))


def cell_days(spark, sf) -> DataFrame:
    """Gridded hazard: one row per cell and day."""
    places = station_places(spark, sf).select("station", "iy", "ix")
    return (station_days(spark, sf).join(places, "station").groupBy("iy", "ix", "date")
            .agg(F.sum("value").alias("value")))


def cells(spark, sf) -> DataFrame:
    return station_places(spark, sf).select("iy", "ix", "lat", "lon").distinct()


def cell_zone(spark, sf) -> DataFrame:
    """Bridge of grid cells and zones, computed once per place."""
    from ..operators.spatial import points_in_zones
    return points_in_zones(cells(spark, sf), zone_shapes(spark, sf).select("zone", "ring"), "zone",
                           "lon", "lat").select("iy", "ix", "zone")
