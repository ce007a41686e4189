"""Adaptive cell cover of zones, and joins and areas on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import inside_edges, ring_edges

#: Quarterings of a coarse cell after which it is looked at, the last of which gives the finest cells, and the edges that a cell may
#: hold without being cut further.
LEVELS, FEW_EDGES = (0, 3), 4


def with_edges(zones: DataFrame, zone: str, ring: str) -> DataFrame:
    """``zone`` and ``_edges``: of one closed ring, or of an array of rings (parts and holes)."""
    several = dict(zones.dtypes)[ring].startswith("array<array<")
    edges = F.flatten(F.transform(ring, ring_edges)) if several else ring_edges(F.col(ring))
    return zones.select(zone, edges.alias("_edges"))


def meets_square(e: Column, x: Column, y: Column, half: Column | float) -> Column:
    """Whether an edge meets the closed square around a centre (separating axes)."""
    p, q = e["a"], e["b"]
    dx, dy = q["x"] - p["x"], q["y"] - p["y"]
    apart = F.abs(dx * (y - p["y"]) - dy * (x - p["x"]))
    return ((F.least(p["x"], q["x"]) <= x + half) & (F.greatest(p["x"], q["x"]) >= x - half)
            & (F.least(p["y"], q["y"]) <= y + half) & (F.greatest(p["y"], q["y"]) >= y - half)
            & (apart <= half * (F.abs(dx) + F.abs(dy))))


def cell_code(ix: Column, iy: Column, level: int, levels: int) -> Column:
    """Quadtree code of the cell of ``level`` that holds the finest cell (``ix``, ``iy``): the coarse cell, then a digit for each
    quartering. The code of a cell is a prefix of those inside it, so it is also an order that keeps neighbours together."""
    base = [F.shiftright(ix, levels).cast("string"), F.lit("_"), F.shiftright(iy, levels).cast("string"), F.lit("/")]
    digits = [(F.shiftright(ix, k).bitwiseAND(F.lit(1)) + 2 * F.shiftright(iy, k).bitwiseAND(F.lit(1))).cast("string")
              for k in range(levels - 1, levels - 1 - level, -1)]
    return F.concat(*base, *digits)


def codes_of(x: Column, y: Column, size: float, levels: tuple[int, ...] = LEVELS) -> Column:
    """Codes of the cells of all levels that hold a point."""
    step = F.lit(size / (1 << levels[-1]))
    ix, iy = F.floor(x / step), F.floor(y / step)
    return F.array(*[cell_code(ix, iy, k, levels[-1]) for k in levels])


def zone_index(zones: DataFrame, zone: str, ring: str = "ring", size: float = 1.0, levels: tuple[int, ...] = LEVELS,
               few: int = FEW_EDGES) -> DataFrame:
    """Cells that cover each zone: (``zone``, ``code``, ``inside``, ``edges``).

    A cell that no edge meets lies inside (its ``edges`` are null) or is left out. One that is met is quartered to the next of ``levels``
    while more than ``few`` edges meet it; the last ones keep the edges that a ray from their points to the right can
    cross, so points there are tested with the same arithmetic as with the whole ring but against a strip of it. A zone
    with a dense ring or many points spreads over its cells.
    """
    points = F.transform("_edges", lambda e: e["a"])

    def span(c: str) -> Column:
        at = F.transform(points, lambda p: p[c])
        return F.sequence(*[F.floor(f(at) / F.lit(size)).cast("long") for f in (F.array_min, F.array_max)])

    cells = F.flatten(F.transform("_xs", lambda x: F.transform("_ys", lambda y: F.struct(x.alias("x"), y.alias("y")))))
    now = with_edges(zones, zone, ring).where(F.size("_edges") > 0).select(zone, "_edges", span("x").alias("_xs"), span("y").alias("_ys"))
    now = now.select(zone, "_edges", F.explode(cells).alias("_c"))
    out = None
    for level, after in zip(levels, [*levels[1:], None]):
        side = size / (1 << level)
        half = F.lit(side / 2 * (1 + 1e-9))
        cx, cy = (F.col("_c.x") + 0.5) * side, (F.col("_c.y") + 0.5) * side

        def reached(e: Column) -> Column:
            """Whether a ray to the right from the cell can cross the edge."""
            return ((F.least(e["a"]["y"], e["b"]["y"]) <= cy + half) & (F.greatest(e["a"]["y"], e["b"]["y"]) >= cy - half)
                    & (F.greatest(e["a"]["x"], e["b"]["x"]) >= cx - half))

        strip = now.select(zone, "_c", F.filter("_edges", reached).alias("_edges"))
        strip = strip.select(zone, "_c", "_edges", F.size(F.filter("_edges", lambda e: meets_square(e, cx, cy, half))).alias("_met"))
        strip = strip.where((F.col("_met") > 0) | inside_edges(cx, cy, F.col("_edges")))
        more = F.col("_met") > few
        fine = [F.shiftleft(F.col(f"_c.{c}"), levels[-1] - level) for c in ("x", "y")]
        inside = F.col("_met") == 0
        done = (strip if after is None else strip.where(~more)).select(
            zone, cell_code(*fine, level, levels[-1]).alias("code"), inside.alias("inside"), F.when(~inside, F.col("_edges")).alias("edges"))
        out = done if out is None else out.unionByName(done)
        if after is not None:
            k = 1 << (after - level)
            parts = F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long"))
            inner = F.flatten(F.transform(parts, lambda x: F.transform(parts, lambda y: F.struct(
                (F.col("_c.x") * k + x).alias("x"), (F.col("_c.y") * k + y).alias("y")))))
            now = strip.where(more).select(zone, "_edges", F.explode(inner).alias("_c"))
    return out


def points_in_index(points: DataFrame, index: DataFrame, zone: str, x: str, y: str, size: float = 1.0,
                    levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """Zone of each point: an equi-join on cell codes; only points in cells that an edge meets are tested. A point meets at most
    one cell of a zone. Points outside are dropped."""
    keyed = points.withColumn("code", F.explode(codes_of(F.col(x), F.col(y), size, levels)))
    held = F.col("inside") | inside_edges(F.col(x), F.col(y), F.col("edges"))
    return keyed.join(index, "code").where(held).select(*points.columns, zone)


def squares_in_index(cells: DataFrame, index: DataFrame, zone: str, x: str, y: str, half: float, size: float = 1.0,
                     levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """Zones that each square cell meets: it overlaps a cell inside, an edge meets it, or its centre lies inside."""
    cols = cells.columns
    step = size / (1 << levels[-1])
    spans = cells
    for c, n in ((x, "_ix"), (y, "_iy")):
        lo, hi = (F.floor((F.col(c) + s * half * (1 + 1e-9)) / F.lit(step)) for s in (-1, 1))
        spans = spans.withColumn(n, F.explode(F.sequence(lo, hi)))
    # a square is sent once to each cell it overlaps, of any level
    codes = F.explode(F.array(*[cell_code(F.col("_ix"), F.col("_iy"), k, levels[-1]) for k in levels]))
    sent = spans.select(*cols, codes.alias("code")).distinct()
    own = F.array_contains(codes_of(F.col(x), F.col(y), size, levels), F.col("code"))
    met = F.exists("edges", lambda e: meets_square(e, F.col(x), F.col(y), half))
    held = F.col("inside") | met | (own & inside_edges(F.col(x), F.col(y), F.col("edges")))
    return sent.join(index, "code").where(held).select(*cols, zone).distinct()


def signed_edges(zones: DataFrame, zone: str, ring: str, size: float) -> DataFrame:
    """Pieces of a zone's edges by vertical strip: (``zone``, ``_strip``, ``l``, ``r``, ``yl``, ``yr``, ``sign``).

    For every x the signed heights of the edges above it add up to the height of the zone there. Rings may turn either way:
    one that lies in an odd number of others is a hole. Rings of a zone do not cross each other; vertical edges have no height.
    """
    several = dict(zones.dtypes)[ring].startswith("array<array<")
    rings = F.col(ring) if several else F.array(ring)
    edged = zones.select(zone, F.transform(rings, ring_edges).alias("_rings"))
    each = edged.select(zone, "_rings", F.posexplode("_rings").alias("_i", "_own")).where(F.size("_own") > 0)
    first = F.get("_own", F.lit(0))
    mid = [(first["a"][c] + first["b"][c]) / 2 for c in ("x", "y")]
    around = F.aggregate(
        F.transform("_rings", lambda r, j: F.when((j != F.col("_i")) & inside_edges(mid[0], mid[1], r), F.lit(1)).otherwise(F.lit(0))),
        F.lit(0), lambda n, v: n + v)
    turn = F.aggregate("_own", F.lit(0.0), lambda s, e: s + e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"])
    each = each.select(zone, F.explode("_own").alias("e"), (F.signum(turn) * F.when(around % 2 == 1, -1).otherwise(1)).alias("_turn"))
    leftward = F.col("e.a.x") > F.col("e.b.x")
    p, q = F.when(leftward, F.col("e.b")).otherwise(F.col("e.a")), F.when(leftward, F.col("e.a")).otherwise(F.col("e.b"))
    lines = each.where(F.col("e.a.x") != F.col("e.b.x")).select(
        zone, p["x"].alias("x0"), p["y"].alias("y0"), q["x"].alias("x1"), q["y"].alias("y1"),
        (F.col("_turn") * F.when(leftward, 1).otherwise(-1)).alias("sign"))
    strips = lines.withColumn("_strip", F.explode(F.sequence(F.floor(F.col("x0") / size), F.floor(F.col("x1") / size))))
    left, right = F.greatest("x0", F.col("_strip") * F.lit(size)), F.least("x1", (F.col("_strip") + 1) * F.lit(size))
    cut = strips.withColumns({"l": left, "r": right}).where("l < r")

    def height(x: Column) -> Column:
        slope = (F.col("y1") - F.col("y0")) / (F.col("x1") - F.col("x0"))
        return F.when(x == F.col("x1"), F.col("y1")).otherwise(F.col("y0") + slope * (x - F.col("x0")))

    return cut.select(zone, "_strip", "l", "r", height(F.col("l")).alias("yl"), height(F.col("r")).alias("yr"), "sign")


def overlay_areas(left: DataFrame, right: DataFrame, a: str, b: str, ring_a: str = "ring", ring_b: str = "ring",
                  size: float = 1.0, decimals: int = 9) -> DataFrame:
    """Area that each zone of ``left`` shares with each of ``right``: (``a``, ``b``, ``area``), positive areas only.

    Zones whose boxes share a coarse cell meet. The area is the sum over their edges, taken in pairs, of the signed area below the
    lower of the two; only edges in the same vertical strip are paired, by an equi-join on zone pair and strip, so a long
    ring is as many short groups, and sums are combined before the last shuffle. Heights are taken from a level near the pair, which
    cancels but keeps the digits of zones far from the origin.
    """
    def boxes(zones: DataFrame, zone: str, ring: str) -> DataFrame:
        points = F.transform("_edges", lambda e: e["a"])
        span = {f"_{c}": F.sequence(*[F.floor(f(a) / F.lit(size)) for f in (F.array_min, F.array_max)])
                for c, a in (("x", F.transform(points, lambda p: p["x"])), ("y", F.transform(points, lambda p: p["y"])))}
        box = with_edges(zones, zone, ring).where(F.size("_edges") > 0).select(zone, *[v.alias(k) for k, v in span.items()])
        return box.withColumn("_x", F.explode("_x")).withColumn("_y", F.explode("_y"))

    low = boxes(left, a, ring_a)
    pairs = low.join(boxes(right, b, ring_b), ["_x", "_y"]).groupBy(a, b).agg((F.min("_y") * F.lit(size)).alias("_level"))
    e = signed_edges(left, a, ring_a, size).select(a, "_strip", F.struct("l", "r", "yl", "yr", "sign").alias("e"))
    f = signed_edges(right, b, ring_b, size).select(b, "_strip", F.struct("l", "r", "yl", "yr", "sign").alias("f"))
    met = pairs.join(e, a).join(f, [b, "_strip"])
    l, r = F.greatest("e.l", "f.l"), F.least("e.r", "f.r")
    met = met.withColumns({"_l": l, "_r": r}).where("_l < _r")

    def at(edge: str, x: Column) -> Column:
        share = (x - F.col(f"{edge}.l")) / (F.col(f"{edge}.r") - F.col(f"{edge}.l"))
        return F.col(f"{edge}.yl") + (F.col(f"{edge}.yr") - F.col(f"{edge}.yl")) * share - F.col("_level")

    met = met.withColumns({"_el": at("e", F.col("_l")), "_er": at("e", F.col("_r")), "_fl": at("f", F.col("_l")), "_fr": at("f", F.col("_r"))})
    dl, dr = F.col("_el") - F.col("_fl"), F.col("_er") - F.col("_fr")
    low_l, low_r = F.least("_el", "_fl"), F.least("_er", "_fr")
    cross = dl / (dl - dr)
    at_cross = F.col("_el") + (F.col("_er") - F.col("_el")) * cross
    mean = F.when(dl * dr < 0, (cross * (low_l + at_cross) + (1 - cross) * (at_cross + low_r)) / 2).otherwise((low_l + low_r) / 2)
    area = F.round(F.sum(F.col("e.sign") * F.col("f.sign") * (F.col("_r") - F.col("_l")) * mean), decimals)
    return met.groupBy(a, b).agg(area.alias("area")).where("area > 0")


def largest_area(areas: DataFrame, a: str, b: str) -> DataFrame:
    """The partner that shares the largest area with each zone, that area, and the area shared with all; ties go to the smaller partner."""
    best = areas.groupBy(a).agg(F.max(F.struct("area", (-F.col(b)).alias("o"))).alias("_b"), F.sum("area").alias("area_total"))
    return best.select(a, (-F.col("_b.o")).alias(b), F.col("_b.area").alias("area"), "area_total")
