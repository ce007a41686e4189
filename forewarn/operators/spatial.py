"""Points, cells, zones and river basins as equi-joins on integer cells."""

from __future__ import annotations

import math
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import haversine_km, ratio
from ..session import cut_lineage
from .windows import along, past, whole
from .zone_index import points_in_index, squares_in_index, zone_index


def cell_index(c: Column, size: float) -> Column:
    """Integer cell number of a coordinate."""
    return F.floor(c / F.lit(size)).cast("int")


def cell_centre(c: Column) -> Column:
    """Snap a coordinate to the centre of its 0.1 degree cell."""
    return F.floor(c * 10) / F.lit(10.0) + F.lit(0.05)


def points_in_zones(points: DataFrame, zones: DataFrame, zone: str, x: str, y: str,
                    ring: str = "ring", size: float = 1.0) -> DataFrame:
    """Zone of each point through an adaptive cell cover of the zones. Points outside are dropped.

    A zone is a closed ring or an array of rings, its parts and holes. Points in cells inside a zone never meet its geometry,
    those in cells on its border meet a strip of it. Run it on distinct coordinates (stations, grid cells) and join facts to the
    result, so that the geometry is tested once per place and not once per observation.
    """
    return points_in_index(points, zone_index(zones, zone, ring, size), zone, x, y, size)


def cells_touching_zones(cells: DataFrame, zones: DataFrame, zone: str, x: str, y: str,
                         half: float = 0.05, ring: str = "ring", size: float = 1.0) -> DataFrame:
    """Zones met by each square cell: an edge of the zone meets the square, or the square lies inside.

    Cells and zones meet through the same cover as points do.
    """
    return squares_in_index(cells, zone_index(zones, zone, ring, size), zone, x, y, half, size)


def box_window(cells: DataFrame, stations: DataFrame, station: str, x: str, y: str, sx: str, sy: str,
               half: float, size: float) -> DataFrame:
    """Grid rows within ``half`` of a station on both axes, by the cells the box touches."""
    box = stations.select(station, sx, sy, *[
        cell_index(F.col(c) + s * half, size).alias(n)
        for n, c, s in (("_x0", sx, -1), ("_x1", sx, 1), ("_y0", sy, -1), ("_y1", sy, 1))])
    box = box.withColumn("_cx", F.explode(F.sequence("_x0", "_x1")))
    box = box.withColumn("_cy", F.explode(F.sequence("_y0", "_y1"))).drop("_x0", "_x1", "_y0", "_y1")
    keyed = cells.withColumns({"_cx": cell_index(F.col(x), size), "_cy": cell_index(F.col(y), size)})
    near = (F.abs(F.col(x) - F.col(sx)) <= half) & (F.abs(F.col(y) - F.col(sy)) <= half)
    return keyed.join(box, ["_cx", "_cy"]).where(near).drop("_cx", "_cy")


def nearest_stations(zones: DataFrame, stations: DataFrame, zone: str, station: str, zx: str,
                     zy: str, x: str, y: str, k: int, max_km: float) -> DataFrame:
    """The ``k`` nearest stations of every zone centroid within ``max_km``.

    Stations are met through degree cells of at least ``max_km``. Only the ``k`` first stations of one
    location can be among the k nearest, so crowded locations are thinned to those first; the
    neighbours are then taken one rank at a time by combinable minima.
    """
    size = max_km / 100.0  # a degree of latitude is 111 km
    rest, locs = stations.select(station, x, y), None
    for _ in range(k):
        first = rest.groupBy(x, y).agg(F.min(station).alias(station))
        locs = first if locs is None else locs.unionByName(first)
        rest = rest.join(first.withColumnRenamed(station, "_first"), [x, y]).where(
            F.col(station) > F.col("_first")).drop("_first")
    # the map ends at 180 degrees, the earth does not: each place also stands one turn away
    turned = locs.withColumn(x, F.when(F.col(x) < 0, F.col(x) + 360.0).otherwise(F.col(x) - 360.0))
    locs = locs.unionByName(turned)
    locs = locs.withColumns({"_cx": cell_index(F.col(x), size), "_cy": cell_index(F.col(y), size)})
    # a degree of longitude shrinks with the cosine of the latitude; near a pole all longitudes are near
    narrow = F.cos(F.radians(F.least(F.abs(F.col(zy)) + size, F.lit(90.0))))
    reach = F.least(F.ceil(F.lit(1.0) / F.greatest(narrow, F.lit(1e-6))), F.lit(math.ceil(180.0 / size)))
    around = zones.select(zone, zx, zy, cell_index(F.col(zx), size).alias("_zx"),
                          cell_index(F.col(zy), size).alias("_zy"), reach.cast("int").alias("_r"))
    around = around.withColumn("_cx", F.explode(F.sequence(F.col("_zx") - F.col("_r"),
                                                           F.col("_zx") + F.col("_r"))))
    around = around.withColumn("_cy", F.explode(F.sequence(F.col("_zy") - 1, F.col("_zy") + 1)))
    km = haversine_km(F.col(zy), F.col(zx), F.col(y), F.col(x))
    pairs = (locs.join(around, ["_cx", "_cy"]).select(zone, station, F.round(km, 6).alias("km"))
             .where(F.col("km") <= max_km).distinct())
    found = None
    for rank in range(1, k + 1):
        left = pairs if found is None else pairs.join(found.select(zone, station), [zone, station],
                                                      "left_anti")
        best = left.groupBy(zone).agg(F.min(F.struct("km", station)).alias("_b")).select(
            zone, F.lit(rank).alias("rank"), F.col(f"_b.{station}").alias(station),
            F.col("_b.km").alias("km"))
        found = best if found is None else found.unionByName(best)
    return found


def largest_overlap(bridge_a: DataFrame, bridge_b: DataFrame, a: str, b: str,
                    cell: list[str]) -> DataFrame:
    """Partner sharing most cells with each zone; ties go to the smaller partner id."""
    shared = bridge_a.join(bridge_b, cell).groupBy(a, b).agg(F.count("*").alias("cells"))
    best = shared.groupBy(a).agg(F.max_by(F.struct(b, "cells"),
                                          F.struct("cells", (-F.col(b)).alias("o"))).alias("_b"))
    return best.select(a, f"_b.{b}", "_b.cells")


def zonal_stats(cells: DataFrame, bridge: DataFrame, cell: list[str], keys: list[str], value: str,
                low: float | None = None, high: float | None = None) -> DataFrame:
    """Mean, max, sum and 95 % quantile per zone and time over the valid cells."""
    v = F.col(value)
    ok = v.isNotNull()
    if low is not None:
        ok = ok & (v >= low)
    if high is not None:
        ok = ok & (v <= high)
    # two stages: equal values are counted before they meet, and the quantile is read off a running count of the sorted
    # values, which spills, instead of a buffer that holds all values of a zone
    counts = cells.where(ok).join(bridge, cell).groupBy(*keys, v.alias("_v")).agg(F.count("*").alias("_n"))
    ordered = counts.withColumns({"_cum": F.sum("_n").over(past(keys, "_v")), "_all": F.sum("_n").over(whole(keys))})
    place = (F.col("_all") - 1) * F.lit(0.95)

    def at(rank: Column) -> Column:
        return F.min(F.when(F.col("_cum") > rank, F.col("_v")))

    found = ordered.groupBy(*keys).agg(
        (F.sum(F.col("_v") * F.col("_n")) / F.sum("_n")).alias("mean"), F.max("_v").alias("max"), F.sum(F.col("_v") * F.col("_n")).alias("sum"),
        at(F.floor(place)).alias("_a"), at(F.ceil(place)).alias("_b"), F.max(place - F.floor(place)).alias("_share"), F.sum("_n").alias("cells"))
    return found.withColumn("q95", F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_share")).select(*keys, "mean", "max", "sum", "q95", "cells")


def neighbour_overlap(extremes: DataFrame, cx: str, cy: str, date: str, rounds: int = 1) -> DataFrame:
    """How often a neighbour is extreme when the cell is, in percent.

    Each extreme cell day is sent to its neighbour positions (8 for one round, 24 for two) and meets
    their extreme days by an equi-join; the cell itself is kept with 100 %.
    """
    steps = range(-rounds, rounds + 1)
    offsets = F.array(*[F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy"))
                        for i in steps for j in steps])
    days = extremes.select(cx, cy, date).distinct()
    totals = days.groupBy(cx, cy).agg(F.count("*").alias("_days"))
    sent = days.withColumn("_o", F.explode(offsets)).select(
        cx, cy, date, (F.col(cx) + F.col("_o.dx")).alias("nx"),
        (F.col(cy) + F.col("_o.dy")).alias("ny"))
    there = days.select(F.col(cx).alias("nx"), F.col(cy).alias("ny"), date)
    both = sent.join(there, ["nx", "ny", date]).groupBy(cx, cy, "nx", "ny").agg(
        F.count("*").alias("both_days"))
    return both.join(totals, [cx, cy]).select(
        cx, cy, "nx", "ny", "both_days", ratio(F.col("both_days") * 100, F.col("_days")).alias("percentage"))


#: One row of state: the cells met so far (``o`` is the negative id, so that the largest is the strongest and then the smallest id),
#: and the cells chosen. The recursive part joins it to the neighbours of the best open cell and needs no aggregate.
GREEDY = """
WITH RECURSIVE path(step, pool, visited) AS (
  SELECT 0, transform(nbrs, n -> struct(n.percentage AS p, -n.neighbour AS o, {near}.cell AS poi, 0 AS step)), array({near}.cell)
  FROM {near} JOIN {seed} ON {near}.cell = {seed}.cell
  UNION ALL
  SELECT /*+ BROADCAST(s) */ s.step + 1,
    concat(s.pool, transform(filter(n.nbrs, x -> NOT array_contains(s.visited, x.neighbour) AND x.neighbour <> n.cell AND NOT exists(s.pool, q -> q.o = -x.neighbour)),
                             x -> struct(x.percentage AS p, -x.neighbour AS o, n.cell AS poi, s.step + 1 AS step))),
    array_append(s.visited, n.cell)
  FROM (SELECT step, pool, visited, array_max(filter(pool, q -> NOT array_contains(visited, -q.o))) AS best FROM path) s
  JOIN {near} n ON n.cell = -s.best.o
  WHERE s.best.p > :limit AND s.step < :steps)
SELECT step, pool, visited FROM path"""


def greedy_path(overlap: DataFrame, cell: str, neighbour: str, start, steps: int = 10,
                limit: float = 60.0) -> DataFrame:
    """Follow the strongest unselected neighbour from ``start``, an id or a table with one row of ``cell``.

    ``overlap`` is ``(cell, neighbour, percentage)`` with whole-number ids. A recursive query carries one row of state through at
    most ``steps`` joins with a table of each cell's neighbours (a bounded number); nothing comes to the driver. Returns the cells met with
    the cell and step that met them, and whether they were ``selected``. Ties go to the smaller neighbour id.
    """
    spark = overlap.sparkSession
    rows = overlap.select(F.col(cell).cast("bigint").alias("cell"), F.col(neighbour).cast("bigint").alias("neighbour"),
                          F.col("percentage").cast("double").alias("percentage"))
    ends = rows.select(F.col("neighbour").alias("cell"), F.lit(None).cast("bigint").alias("neighbour"), F.lit(None).cast("double").alias("percentage"))
    link = F.when(F.col("cell") != F.col("neighbour"), F.struct("neighbour", "percentage"))
    near = cut_lineage(rows.unionByName(ends.distinct()).groupBy("cell").agg(F.collect_list(link).alias("nbrs")))
    seed = start.select(F.col(cell).cast("bigint").alias("cell")) if isinstance(start, DataFrame) else spark.range(1).select(
        F.lit(start).cast("bigint").alias("cell"))
    path = spark.sql(GREEDY, args={"limit": float(limit), "steps": int(steps)}, near=near, seed=seed)
    last = path.agg(F.max_by(F.struct("step", "pool", "visited"), "step").alias("s")).where("s IS NOT NULL").select("s.*")
    best = F.array_max(F.filter("pool", lambda q: ~F.array_contains("visited", -q["o"])))
    ended = last.withColumn("_b", best)
    also = F.when((F.col("step") == steps) & (F.col("_b.p") > limit), F.array(-F.col("_b.o"))).otherwise(F.array().cast("array<bigint>"))
    chosen = F.concat(F.slice("visited", 2, steps + 1), also)
    found = ended.select(F.explode("pool").alias("q"), chosen.alias("_c"))
    return found.select((-F.col("q.o")).alias(neighbour), F.col("q.p").alias("percentage"), F.col("q.poi").alias("poi"), F.col("q.step").alias("step"),
                        F.array_contains("_c", -F.col("q.o")).cast("int").alias("selected"))


def upstream(edges: DataFrame, start: DataFrame, basin: str, down: str) -> DataFrame:
    """All basins draining into the start set, with the number of steps.

    Breadth first: every round joins the last frontier only. Frontiers are checkpointed, so neither
    the plan nor a lost executor makes earlier rounds run again. A basin enters once, so cycles end as well.
    """
    frontier = cut_lineage(start.select(basin).distinct().withColumn("steps", F.lit(0)))
    seen = frontier
    for step in count(1):
        below = frontier.select(F.col(basin).alias(down))
        nxt = (edges.join(below, down).select(basin).distinct()
               .join(seen.select(basin), basin, "left_anti").withColumn("steps", F.lit(step)))
        frontier = cut_lineage(nxt)
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier)


def upstream_sets(edges: DataFrame, start: DataFrame, basin: str, down: str, keys: list[str],
                  area: str | None = None, max_area: float | None = None) -> DataFrame:
    """For each key of ``start`` all basins that drain into one of its basins, with the least number of steps.

    Every basin drains to one other at most (``edges`` has a row per basin, null ``down`` at an outlet). Ways double: in each
    round a basin takes over what the basin at the end of its way has reached, and its way becomes twice as long, so a river
    of n basins takes log2(n) rounds, each one join on the end of the way; rounds are checkpointed. The start belongs to its set
    whatever its area; with ``max_area`` only basins of at most that area are added, and the way ends at a larger one or one
    whose area is not known. Cycles end when no round adds a pair.
    """
    kept = edges.where(F.col(down).isNotNull())
    if area is not None:
        kept = kept.where(F.col(area) <= F.lit(max_area))
    way = cut_lineage(kept.groupBy(basin).agg(F.min(down).alias("_to")))
    reach = cut_lineage(start.select(*keys, basin).distinct().withColumn("steps", F.lit(0).cast("bigint")))
    pairs, length = reach.count(), 1
    while not way.isEmpty():
        there = reach.withColumnRenamed(basin, "_to")
        new = way.join(there, "_to").select(*keys, basin, (F.col("steps") + length).alias("steps"))
        reach = cut_lineage(reach.unionByName(new).groupBy(*keys, basin).agg(F.min("steps").alias("steps")))
        now = reach.count()
        if now == pairs:
            break
        pairs, length = now, 2 * length
        ends = way.select(F.col(basin).alias("_to"), F.col("_to").alias("_end"))
        way = cut_lineage(way.join(ends, "_to").select(basin, F.col("_end").alias("_to")))
    return reach
