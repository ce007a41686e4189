"""Join queries: keys, bands, neighbourhoods, geometry, graph closure."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import impacts as I
from ..operators import rolling as W
from ..operators import spatial as G
from ..operators import zone_index as Z
from ..operators.joining import join_dimension
from ..operators.series import scaffold
from . import domain as D
from .registry import query


@query("j01_inner_mapping", """
SELECT d.station, CAST(s_nationkey AS BIGINT) AS zone, d.date, d.value FROM station_days d
JOIN supplier ON d.station = s_suppkey WHERE s_acctbal > 0""")
def _(spark, sf):
    good = D.table(spark, sf, "supplier").where("s_acctbal > 0").select(
        F.col("s_suppkey").alias("station"), F.col("s_nationkey").alias("zone"))
    return D.station_days(spark, sf).join(good, "station").select("station", "zone", "date", "value")


@query("j02_event_flag", "SELECT zone, date, value, event FROM zone_flagged")
def _(spark, sf):
    return D.zone_flagged(spark, sf).select("zone", "date", "value", "event")


@query("j03_composite_keys", """
SELECT m.zone, m.date, m.value, coalesce(r.n, 0) AS reports FROM zone_months m
JOIN nation ON m.zone = n_nationkey LEFT JOIN (
  SELECT lower(n_name) AS place, year(date) AS y, month(date) AS mo, count(*) AS n
  FROM impact_reports JOIN nation ON zone = n_nationkey GROUP BY 1, 2, 3) r
ON lower(n_name) = r.place AND year(m.date) = r.y AND month(m.date) = r.mo""")
def _(spark, sf):
    names = D.table(spark, sf, "nation").select(F.col("n_nationkey").cast("bigint").alias("zone"),
                                                F.col("n_name").alias("name"))
    reports = D.events(spark, sf).join(names, "zone").groupBy(
        F.lower("name").alias("place"), F.year("date").alias("y"), F.month("date").alias("mo")).agg(
        F.count("*").alias("n"))
    m = D.zone_months(spark, sf).join(names, "zone")
    on = [F.lower(m["name"]) == reports["place"], F.year(m["date"]) == reports["y"],
          F.month(m["date"]) == reports["mo"]]
    return m.join(reports, on, "left").select("zone", "date", "value",
                                              F.coalesce("n", F.lit(0)).alias("reports"))


@query("j04_shared_keys", """
SELECT m.zone, m.date, m.value, e.severity FROM zone_months m JOIN (
  SELECT zone, CAST(date_trunc('month', date) AS DATE) AS date, max(severity) AS severity
  FROM impact_reports GROUP BY 1, 2) e USING (zone, date)""")
def _(spark, sf):
    ev = D.events(spark, sf).groupBy("zone", F.trunc("date", "month").alias("date")).agg(
        F.max("severity").alias("severity"))
    return D.zone_months(spark, sf).join(ev, ["zone", "date"]).select("zone", "date", "value", "severity")


@query("j05_full_outer", """
SELECT zone, date, h.value, e.severity FROM zone_days h FULL JOIN (
  SELECT zone, date, sum(severity) AS severity FROM impact_reports GROUP BY 1, 2) e USING (zone, date)""")
def _(spark, sf):
    ev = D.events(spark, sf).groupBy("zone", "date").agg(F.sum("severity").alias("severity"))
    return D.zone_days(spark, sf).select("zone", "date", "value").join(ev, ["zone", "date"], "full_outer")


@query("j06_right_join", """
SELECT CAST(n_nationkey AS BIGINT) AS zone, n_name AS name, v.worst
FROM (SELECT zone, max(value) AS worst FROM zone_days GROUP BY zone) v
RIGHT JOIN nation ON v.zone = n_nationkey""")
def _(spark, sf):
    worst = D.zone_days(spark, sf).groupBy("zone").agg(F.max("value").alias("worst"))
    shapes = D.table(spark, sf, "nation").select(F.col("n_nationkey").cast("bigint").alias("zone"),
                                                 F.col("n_name").alias("name"))
    return worst.join(shapes, "zone", "right").select("zone", "name", "worst")


@query("j07_calendar_scaffold", """
SELECT k.station, c.date FROM (SELECT DISTINCT station FROM station_days) k
JOIN (SELECT CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 MONTH)) AS DATE) AS date
      FROM (SELECT CAST(date_trunc('month', date) AS DATE) AS date FROM station_days)) c ON TRUE""")
def _(spark, sf):
    months = D.station_days(spark, sf).groupBy("station").agg(F.min("date").alias("lo"),
                                                              F.max("date").alias("hi"))
    ends = months.unpivot(["station"], ["lo", "hi"], "end", "date").select(
        "station", F.trunc("date", "month").alias("date"))
    lo = ends.agg(F.min("date")).scalar()
    hi = ends.agg(F.max("date")).scalar()
    return scaffold(ends, ["station"], step="1 month", start=lo, end=hi)


@query("j08_semi_join", """
SELECT station, date, value FROM station_days WHERE station IN (
  SELECT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT zone FROM impact_reports GROUP BY zone HAVING count(*) > 40))""")
def _(spark, sf):
    hit = D.events(spark, sf).groupBy("zone").count().where("count > 40")
    stations = D.mapping(spark, sf).join(hit, "zone", "left_semi")
    return D.station_days(spark, sf).select("station", "date", "value").join(stations, "station", "left_semi")


@query("j09_anti_join", """
SELECT zone, date, value FROM zone_days z WHERE NOT EXISTS (
  SELECT 1 FROM event_days e WHERE e.zone = z.zone AND e.date = z.date)""")
def _(spark, sf):
    return D.zone_days(spark, sf).select("zone", "date", "value").join(
        D.event_days(spark, sf), ["zone", "date"], "left_anti")


@query("j10_point_in_polygon", """
SELECT p.station, z.zone FROM station_places p JOIN zone_shapes z
ON abs(p.lon - z.cx) + abs(p.lat - z.cy) < z.r""")
def _(spark, sf):
    points = D.station_places(spark, sf).select("station", "lat", "lon")
    shapes = D.zone_shapes(spark, sf).select("zone", "ring")
    return G.points_in_zones(points, shapes, "zone", "lon", "lat").select("station", "zone")


@query("j11_cells_in_zones", "SELECT iy, ix, zone FROM cell_zone")
def _(spark, sf):
    return D.cell_zone(spark, sf)


@query("j12_cell_touches_zone", """
SELECT c.iy, c.ix, z.zone FROM cells c JOIN zone_shapes z
ON greatest(abs(c.lon - z.cx) - 0.05, 0) + greatest(abs(c.lat - z.cy) - 0.05, 0) < z.r""")
def _(spark, sf):
    shapes = D.zone_shapes(spark, sf).select("zone", "ring")
    return G.cells_touching_zones(D.cells(spark, sf), shapes, "zone", "lon", "lat").select("iy", "ix", "zone")


@query("j13_largest_overlap", """
WITH s AS (SELECT a.zone, b.iy % 7 AS partner, count(*) AS cells FROM cell_zone a
           JOIN cells b ON a.iy = b.iy AND a.ix = b.ix GROUP BY 1, 2)
SELECT zone, partner, cells FROM (SELECT *, row_number() OVER (PARTITION BY zone
  ORDER BY cells DESC, partner) AS rn FROM s) WHERE rn = 1""")
def _(spark, sf):
    # livelihood zones: stripes of cell rows
    other = D.cells(spark, sf).select("iy", "ix", (F.col("iy") % 7).alias("partner"))
    return G.largest_overlap(D.cell_zone(spark, sf), other, "zone", "partner", ["iy", "ix"])


@query("j13b_overlay_area", """
WITH a AS (SELECT station, lon AS x, lat AS y, 0.3 + (station % 9) * 0.15 AS r FROM station_places),
o AS (SELECT a.station, z.zone, a.r, a.x + a.y AS u, a.x - a.y AS v, z.cx + z.cy AS zu, z.cx - z.cy AS zv, z.r AS zr FROM a JOIN zone_shapes z ON TRUE),
s AS (SELECT station, zone, round((greatest(least(u + r, zu + zr) - greatest(u - r, zu - zr), 0) * greatest(least(v + r, zv + zr) - greatest(v - r, zv - zr), 0)
  - greatest(least(u + r / 3, zu + zr) - greatest(u - r / 3, zu - zr), 0) * greatest(least(v + r / 3, zv + zr) - greatest(v - r / 3, zv - zr), 0)) / 2, 9) AS area FROM o)
SELECT station, zone, round(area, 6) AS area, round(total, 6) AS area_total FROM (
  SELECT *, sum(area) OVER (PARTITION BY station) AS total, row_number() OVER (PARTITION BY station ORDER BY area DESC, zone) AS rn FROM s WHERE area > 0) WHERE rn = 1""")
def _(spark, sf):
    # catchments: a diamond around each station, with a hole of a third of its width
    x, y, r = F.col("lon"), F.col("lat"), 0.3 + (F.col("station") % 9) * 0.15

    def diamond(h):
        return F.array(*[F.struct((x + dx * h).alias("x"), (y + dy * h).alias("y")) for dx, dy in ((1, 0), (0, 1), (-1, 0), (0, -1), (1, 0))])

    catchments = D.station_places(spark, sf).select("station", F.array(diamond(r), diamond(r / 3)).alias("ring"))
    areas = Z.overlay_areas(catchments, D.zone_shapes(spark, sf).select("zone", "ring"), "station", "zone")
    return Z.largest_area(areas, "station", "zone").withColumns({"area": F.round("area", 6), "area_total": F.round("area_total", 6)})


@query("j14_nearest_stations", """
WITH d AS (SELECT z.zone, p.station, round(2 * 6371.0088 * asin(sqrt(least(1.0,
    pow(sin(radians(p.lat - z.cy) / 2), 2) + cos(radians(z.cy)) * cos(radians(p.lat))
    * pow(sin(radians(p.lon - z.cx) / 2), 2)))), 6) AS km FROM zone_shapes z JOIN station_places p ON TRUE)
SELECT zone, rank, station, km FROM (SELECT *, row_number() OVER (PARTITION BY zone ORDER BY km, station)
  AS rank FROM d WHERE km <= 90) WHERE rank <= 2""")
def _(spark, sf):
    zones = D.zone_shapes(spark, sf).select("zone", "cx", "cy")
    stations = D.station_places(spark, sf).select("station", "lon", "lat")
    return G.nearest_stations(zones, stations, "zone", "station", "cx", "cy", "lon", "lat", 2, 90.0)


@query("j15_nearest_cell", """
SELECT p.station, p.iy, p.ix, c.date, c.value FROM station_places p
JOIN cell_days c ON c.iy = p.iy AND c.ix = p.ix""")
def _(spark, sf):
    # nearest centre of a regular grid is the cell the coordinate falls into
    p = D.station_places(spark, sf).select(
        "station", G.cell_index(F.col("lat") + 0.001, 0.1).cast("bigint").alias("iy"),
        G.cell_index(F.col("lon") + 0.001, 0.1).cast("bigint").alias("ix"))
    return D.cell_days(spark, sf).join(p, ["iy", "ix"]).select("station", "iy", "ix", "date", "value")


@query("j16_box_window", """
SELECT p.station, c.iy, c.ix FROM station_places p JOIN cells c
ON abs(c.lat - p.lat) <= 0.31 AND abs(c.lon - p.lon) <= 0.31""")
def _(spark, sf):
    st = D.station_places(spark, sf).select("station", F.col("lat").alias("slat"), F.col("lon").alias("slon"))
    return G.box_window(D.cells(spark, sf), st, "station", "lon", "lat", "slon", "slat", 0.31, 0.5).select(
        "station", "iy", "ix")


@query("j17_date_band", """
SELECT DISTINCT h.zone, e.date AS event_date, h.date, h.value FROM zone_days h JOIN event_days e
ON h.zone = e.zone AND h.date > e.date - 30 AND h.date < e.date + 30""")
def _(spark, sf):
    # every event is sent to the 59 days around it; each of them meets one hazard row
    days = D.event_days(spark, sf).select(
        "zone", F.col("date").alias("event_date"),
        F.explode(F.sequence(F.date_sub("date", 29), F.date_add("date", 29))).alias("date"))
    return D.zone_days(spark, sf).select("zone", "date", "value").join(days, ["zone", "date"])


@query("j18_row_window", """
SELECT zone, date, value, event FROM (SELECT *, max(event) OVER (PARTITION BY zone ORDER BY date
  ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING) AS near FROM zone_flagged) WHERE near = 1""")
def _(spark, sf):
    return W.crop_around(D.zone_flagged(spark, sf), ["zone"], "event", 10, 10).select(
        "zone", "date", "value", "event")


@query("j19_year_neighbours", """
SELECT zone, date, value FROM zone_months m WHERE EXISTS (
  SELECT 1 FROM impact_reports e WHERE e.zone = m.zone AND e.severity > 450000
  AND year(m.date) BETWEEN year(e.date) - 1 AND year(e.date) + 1)""")
def _(spark, sf):
    y = F.year("date")
    years = (D.events(spark, sf).where("severity > 450000")
             .select("zone", F.explode(F.array(y - 1, y, y + 1)).alias("year")).distinct())
    return (D.zone_months(spark, sf).withColumn("year", y).join(years, ["zone", "year"], "left_semi")
            .select("zone", "date", "value"))


@query("j20_year_shift", """
WITH y AS (SELECT zone, year(date) AS year, sum(value) AS value FROM zone_days GROUP BY 1, 2)
SELECT a.zone, a.year, a.value, b.value AS next_value FROM y a JOIN y b ON a.zone = b.zone AND b.year = a.year + 1""")
def _(spark, sf):
    from ..operators.windows import along
    y = D.zone_days(spark, sf).groupBy("zone", F.year("date").alias("year")).agg(F.sum("value").alias("value"))
    w = along(["zone"], "year")
    nxt = F.when(F.lead("year").over(w) == F.col("year") + 1, F.lead("value").over(w))
    return y.withColumn("next_value", nxt).where("next_value IS NOT NULL")


@query("j21_upstream_closure", """
WITH RECURSIVE up(basin, steps) AS (
  SELECT c_custkey, 0 FROM customer WHERE c_nationkey = 3 AND c_custkey > 0
  UNION SELECT c.c_custkey, u.steps + 1 FROM customer c JOIN up u ON c.c_custkey // 3 = u.basin
  WHERE c.c_custkey > 0)
SELECT basin, min(steps) AS steps FROM up GROUP BY basin""")
def _(spark, sf):
    cust = D.table(spark, sf, "customer").where("c_custkey > 0")
    edges = cust.select(F.col("c_custkey").alias("basin"),
                        F.floor(F.col("c_custkey") / 3).alias("next_down"))
    start = cust.where("c_nationkey = 3").select(F.col("c_custkey").alias("basin"))
    return G.upstream_sets(edges, start, "basin", "next_down", [])


@query("j21b_upstream_by_area", """
WITH RECURSIVE b AS (SELECT c_custkey AS basin, c_custkey - 1 - c_custkey % 2 AS next_down, c_acctbal AS area, c_nationkey FROM customer WHERE c_custkey > 0),
up(zone, basin, steps) AS (
  SELECT CAST(c_nationkey AS BIGINT), basin, 0::BIGINT FROM b WHERE basin % 10 = 3
  UNION SELECT u.zone, b.basin, u.steps + 1 FROM b JOIN up u ON b.next_down = u.basin WHERE b.area <= 9500)
SELECT zone, basin, min(steps) AS steps FROM up GROUP BY zone, basin""")
def _(spark, sf):
    cust = D.table(spark, sf, "customer").where("c_custkey > 0")
    k = F.col("c_custkey")
    edges = cust.select(k.alias("basin"), (k - 1 - k % 2).alias("next_down"), F.col("c_acctbal").alias("area"))
    start = cust.where("c_custkey % 10 = 3").select(F.col("c_nationkey").cast("bigint").alias("zone"), k.alias("basin"))
    return G.upstream_sets(edges, start, "basin", "next_down", ["zone"], "area", 9500.0)


@query("j22_dimension_join", """
SELECT z.zone, n_name AS zone_name, r_name AS region, sum(z.value) AS value FROM zone_days z
JOIN nation ON z.zone = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2, 3""")
def _(spark, sf):
    region = D.table(spark, sf, "region")
    dim = D.table(spark, sf, "nation").join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").cast("bigint").alias("zone"), F.col("n_name").alias("zone_name"),
        F.col("r_name").alias("region"))
    sums = D.zone_days(spark, sf).groupBy("zone").agg(F.sum("value").alias("value"))
    return join_dimension(sums, dim, ["zone"]).select("zone", "zone_name", "region", "value")


@query("j23_multi_name_events", """
SELECT word AS place, count(*) AS reports, min(p_partkey) AS first_report FROM (
  SELECT p_partkey, trim(unnest(string_split(p_name, ' '))) AS word FROM part)
WHERE word <> '' GROUP BY 1""")
def _(spark, sf):
    parts = D.table(spark, sf, "part").select("p_partkey", "p_name")
    return (I.split_names(parts, "p_name", " ", "place").groupBy("place")
            .agg(F.count("*").alias("reports"), F.min("p_partkey").alias("first_report")))


@query("j24_spread_to_children", """
SELECT s_suppkey AS ward, m.date, m.value FROM zone_months m JOIN supplier ON m.zone = s_nationkey""")
def _(spark, sf):
    wards = D.mapping(spark, sf).withColumnRenamed("station", "ward")
    return D.zone_months(spark, sf).join(wards, "zone").select("ward", "date", "value")


