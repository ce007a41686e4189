"""Frugal trees, tuned trees, station matrices, zone cover, overlay areas and upstream sets next to brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from forewarn.operators import frugal, spatial, tuning, zone_index

RING = "zone string, ring array<struct<x:double,y:double>>"
RINGS = "zone string, ring array<array<struct<x:double,y:double>>>"


def points(xy):
    return [dict(x=float(a), y=float(b)) for a, b in xy]


# frugal trees -----------------------------------------------------------------------------------------------------------

def score(tp, p, tn, n):
    return 0.75 * (tp / p if p else 0.0) + 0.25 * (tn / n if n else 0.0)


def rules_by_hand(rows, cues, keep):
    """rows: (label, {cue: value})."""
    p, n = sum(y for y, _ in rows), sum(1 - y for y, _ in rows)
    best = []
    for c in cues:
        tried = []
        for cut in {x[c] for _, x in rows if x[c] is not None}:
            for d in (0, 1):
                says = [x[c] is not None and (x[c] <= cut if d == 0 else x[c] > cut) for _, x in rows]
                tp = sum(s and y for s, (y, _) in zip(says, rows))
                tn = n - sum(s and not y for s, (y, _) in zip(says, rows))
                tried.append((-score(tp, p, tn, n), d, cut))
        if tried:
            best.append((*min(tried), c))
    best.sort(key=lambda b: (b[0], b[3]))
    return [(c, d, cut) for _, d, cut, c in best[:keep]]


def trees_by_hand(rows, cues, levels=5):
    rules = rules_by_hand(rows, cues, levels)
    bits = [[x[c] is not None and (x[c] <= cut if d == 0 else x[c] > cut) for c, d, cut in rules] for _, x in rows]

    def told(b, m, exits):
        for k in range(m - 1):
            if b[k] == bool(exits >> k & 1):
                return int(b[k])
        return int(b[m - 1])

    out = {}
    for top in range(1, levels + 1):
        counts = [0, 0, 0, 0]
        for i, (y, _) in enumerate(rows):
            rest = [k for k in range(len(rows)) if k != i]
            p, n = sum(rows[k][0] for k in rest), sum(1 - rows[k][0] for k in rest)
            tried = []
            for m in range(1, min(top, len(rules)) + 1):
                for e in range(1 << (m - 1)):
                    said = [told(bits[k], m, e) for k in rest]
                    tp = sum(s and rows[k][0] for s, k in zip(said, rest))
                    tn = sum(not s and not rows[k][0] for s, k in zip(said, rest))
                    tried.append((-score(tp, p, tn, n), m, e))
            _, m, e = min(tried)
            counts[{(1, 1): 0, (0, 1): 1, (0, 0): 2, (1, 0): 3}[y, told(bits[i], m, e)]] += 1
        out[top] = tuple(counts)
    return out


def test_frugal_trees_by_refitting(spark):
    rng = random.Random(4)
    cues, rows = ["a", "b", "c", "d", "e", "f"], []
    for zone in range(3):
        for _ in range(45):
            x = {c: rng.choice([None, *map(float, range(6))]) if c in "ab" else float(rng.randint(0, 9)) for c in cues}
            y = int((x["c"] > 6 and x["d"] <= 5) or rng.random() < 0.15)
            rows.append((zone, y, x))
    rows += [(3, 0, dict.fromkeys(cues, 1.0))] * 4 + [(4, 1, {**dict.fromkeys(cues, None), "c": 2.0}), (4, 0, {**dict.fromkeys(cues, None), "c": 2.0})]
    df = spark.createDataFrame([(z, y, *[x[c] for c in cues]) for z, y, x in rows], "zone int, y int, " + ", ".join(f"{c} double" for c in cues))
    got = {(r["zone"], r["levels"]): (r["tp"], r["fp"], r["tn"], r["fn"]) for r in frugal.frugal_trees(df, ["zone"], cues, "y").collect()}
    want = {(z, k): v for z in range(5) for k, v in trees_by_hand([(y, x) for zone, y, x in rows if zone == z], cues).items()}
    assert got == want


def test_two_cues_beat_one_and_shuffled_labels_do_not(spark):
    """The event needs a low value of one cue and a high one of another: direction and conjunction are found."""
    rng = np.random.default_rng(7)
    x = rng.uniform(size=(400, 3))
    y = ((x[:, 0] <= 0.4) & (x[:, 1] > 0.5)).astype(int)
    lucky = rng.permutation(y)
    df = spark.createDataFrame([(int(a), int(b), *map(float, v)) for a, b, v in zip(y, lucky, x)], "y int, shuffled int, p double, q double, r double")
    wacc = {r["levels"]: r["wacc"] for r in frugal.frugal_trees(df.withColumn("k", F.lit(1)), ["k"], ["p", "q", "r"], "y").collect()}
    assert wacc[2] > 0.97 > 0.95 > wacc[1]
    chance = {r["levels"]: r["wacc"] for r in frugal.frugal_trees(df.withColumn("k", F.lit(1)), ["k"], ["p", "q", "r"], "shuffled").collect()}
    assert max(chance.values()) < 0.8
    rules = frugal.cue_rules(df.withColumn("k", F.lit(1)), ["k"], ["p", "q", "r"], "y").first()["rules"]
    assert {r["cue"]: r["direction"] for r in rules[:2]} == {"p": 0, "q": 1}


def test_exit_patterns():
    trees = frugal.exit_patterns(5)
    assert len(trees) == 31 and len({mask for _, _, mask in trees}) == 31
    assert frugal.exit_patterns(1) == [(1, 0, 0b10)]


def test_labels_of_quantiles(spark):
    df = spark.createDataFrame([(1, float(v)) for v in range(1, 11)] + [(1, None), (2, 5.0)], "k int, t double")
    got = frugal.below_quantiles(df, ["k"], "t", [20, 50]).groupBy("k", "percent").agg(F.sum("label").alias("n")).collect()
    assert {(r["k"], r["percent"]): r["n"] for r in got} == {(1, 20): 2, (1, 50): 5, (2, 20): 1, (2, 50): 1}


# tuned trees and station matrices ---------------------------------------------------------------------------------------

def test_folds_are_stratified(spark):
    df = spark.range(5000).select("id", (F.col("id") % 10 == 0).cast("int").alias("label"), (F.col("id") % 2).alias("lead"))
    out = tuning.split_and_folds(df, "lead", ["id"], "label").cache()
    assert out.count() == 5000
    for r in out.groupBy("lead", "label", "part").count().collect():
        total = df.where((F.col("lead") == r["lead"]) & (F.col("label") == r["label"])).count()
        assert abs(r["count"] / total - (0.3 if r["part"] == "test" else 0.7)) < 0.01
    sizes = out.groupBy("lead", "part", "label", "fold").count().groupBy("lead", "part", "label").agg(
        (F.max("count") - F.min("count")).alias("gap"), F.count("*").alias("folds")).collect()
    assert all(r["gap"] <= 1 and r["folds"] == 5 for r in sizes)
    again = tuning.split_and_folds(df.repartition(7), "lead", ["id"], "label")
    assert out.exceptAll(again).isEmpty()


def test_drawn_sets_lie_on_the_grid(spark):
    rows = tuning.drawn_sets(spark, 400, 5).collect()
    for name, (n, first, step) in tuning.GRID.items():
        seen = {round((r[name] - first) / step, 6) for r in rows}
        assert seen == set(range(n))


def test_search_finds_planted_events(spark):
    rng = np.random.default_rng(2)
    x = rng.uniform(size=(500, 2))
    y = (np.abs(x[:, 0] - 0.5) < 0.12).astype(int)
    rows = [(i, i % 3, int(a), int(b), *map(float, v)) for i, (a, b, v) in enumerate(zip(y, rng.permutation(y), x))]
    df = spark.createDataFrame(rows, "id long, region long, label int, shuffled int, p double, q double").withColumn("lead", F.lit(1))
    for label, low, high in (("label", 0.9, 1.0), ("shuffled", 0.0, 0.7)):
        data = tuning.split_and_folds(df, "lead", ["id"], label)
        out = tuning.tuned_by_key(data, "lead", [1], ["p", "q"], label, "region", sets=3, rounds=5, folds=3).collect()
        test = [r for r in out if r["part"] == "test"]
        assert {r["region"] for r in test} == {0, 1, 2} and [r["region"] for r in out if r["part"] == "train"] == [None]
        recall = sum(r["tp"] for r in test) / sum(r["tp"] + r["fn"] for r in test)
        assert low <= recall <= high and low <= out[0]["cv_recall"] <= high


def test_station_matrix_and_importances(spark):
    rng = np.random.default_rng(3)
    rows = []
    for day in range(300):
        v = rng.uniform(size=3)
        flood = int(v[1] > 0.8)
        rows += [(1, s, day, float(v[k]), flood) for k, s in enumerate((11, 12, 13)) if not (s == 13 and day % 50 == 0)]
    rows += [(2, 21, day, 1.0, 0) for day in range(10)] + [(1, 11, 5, 0.0, 0)]
    df = spark.createDataFrame(rows, "zone long, station long, date int, value double, event int")
    matrix = tuning.station_matrix(df, "zone", "station", "date", "value", "event").cache()
    assert matrix.count() == 310
    first = matrix.where("zone = 1 AND date = 50").first()
    assert first["stations"] == [11, 12, 13] and first["x"][2] == 0.0
    floods = sum(r[4] for r in rows if r[1] == 12)
    assert {(r["label"], round(r["weight"], 6)) for r in matrix.where("zone = 1").select("label", "weight").distinct().collect()} == {
        (1, round(300 / floods, 6)), (0, round(300 / (300 - floods), 6))}
    scores, weights = tuning.trees_by_zone(matrix, "zone", rounds=5)
    s = scores.collect()
    assert [r["zone"] for r in s] == [1] and s[0]["recall"] == 1.0 and s[0]["tp"] == floods
    w = {r["station"]: r["importance"] for r in weights.collect()}
    assert set(w) == {11, 12, 13} and w[12] > 0.9
    shuffled = matrix.withColumn("label", (F.xxhash64("date") % 5 == 0).cast("int"))
    w = {r["station"]: r["importance"] for r in tuning.trees_by_zone(shuffled, "zone", rounds=5)[1].where("zone = 1").collect()}
    assert w[12] < 0.9


def test_station_matrix_of_many_stations(spark):
    n = 1500
    cells = spark.range(n * 6).select((F.col("id") % n).alias("station"), (F.col("id") / n).cast("int").alias("date"))
    cells = cells.where("NOT (date = 2 AND station % 3 = 1) AND NOT (date = 4 AND station <> 7)")
    days = cells.select(F.lit(1).alias("zone"), "station", "date", (F.col("station") + F.col("date") / 8).alias("value"), (F.col("date") % 2).alias("event"))
    twice = days.union(days.withColumn("value", F.col("value") - 1))
    matrix = tuning.station_matrix(twice, "zone", "station", "date", "value", "event", n)
    assert "element_at" not in matrix._jdf.queryExecution().optimizedPlan().toString()  # looks a map through from its start
    got = {r["date"]: r for r in matrix.collect()}
    assert set(got) == set(range(6)) and all(r["stations"] == list(range(n)) for r in got.values())
    assert got[0]["x"] == [float(s) for s in range(n)] and got[4]["x"] == [7.5 if s == 7 else 0.0 for s in range(n)]
    assert got[2]["x"] == [0.0 if s % 3 == 1 else s + 0.25 for s in range(n)]
    assert {r["weight"] for r in got.values()} == {2.0}


# zone cover --------------------------------------------------------------------------------------------------------------

def wavy(n, cx, cy, r):
    ring = [(cx + (r + 0.2 * r * math.sin(9 * t)) * math.cos(t), cy + (r + 0.2 * r * math.sin(9 * t)) * math.sin(t))
            for t in (2 * math.pi * k / n for k in range(n))]
    return [*ring, ring[0]]


def holds(x, y, ring):
    odd = False
    for (ax, ay), (bx, by) in zip(ring, ring[1:]):
        if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
            odd = not odd
    return odd


def test_zone_index_tests_only_points_on_the_border(spark):
    shapes = {"big": wavy(1500, 2.5, 2.5, 2.0), "small": wavy(30, -3.2, 1.1, 0.3), "square": [(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)]}
    zones = spark.createDataFrame([(n, points(r)) for n, r in shapes.items()], RING)
    index = zone_index.zone_index(zones, "zone").cache()
    assert index.where("inside AND edges IS NOT NULL").isEmpty() and index.where("NOT inside AND edges IS NULL").isEmpty()
    assert index.where("zone = 'big' AND inside").count() > 20
    assert index.agg(F.max(F.size("edges"))).first()[0] < 1500 / 4
    assert index.groupBy("zone", "code").count().where("count > 1").isEmpty()
    rng = np.random.default_rng(1)
    pts = [(i, float(a), float(b)) for i, (a, b) in enumerate(np.round(rng.uniform(-4, 6, (3000, 2)), 2))] + [(9000, 0.5, 0.5), (9001, 1.0, 0.5), (9002, 0.0, 0.0)]
    df = spark.createDataFrame(pts, "id int, x double, y double")
    keyed = zone_index.points_in_index(df, index, "zone", "x", "y")
    assert {(r["id"], r["zone"]) for r in keyed.collect()} == {(i, n) for i, x, y in pts for n, ring in shapes.items() if holds(x, y, ring)}
    met = df.withColumn("code", F.explode(zone_index.codes_of(F.col("x"), F.col("y"), 1.0))).join(index, "code").where("zone = 'big'")
    untested = met.where("inside").count()
    assert untested > met.where("NOT inside").count() and met.where("inside AND edges IS NOT NULL").count() == 0


# overlay areas -------------------------------------------------------------------------------------------------------------

def box(x, y, w, h, turn=1):
    ring = [(x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y)]
    return points(ring[::turn])


def clipped(subject, clip):
    """Area of the intersection of two convex rings, both counter-clockwise."""
    out = subject[:-1]
    for (ax, ay), (bx, by) in zip(clip, clip[1:]):
        side = lambda p: (bx - ax) * (p[1] - ay) - (by - ay) * (p[0] - ax)
        given, out = out, []
        for p, q in zip(given, given[1:] + given[:1]):
            s, t = side(p), side(q)
            if s >= 0:
                out.append(p)
            if s * t < 0:
                out.append((p[0] + (q[0] - p[0]) * s / (s - t), p[1] + (q[1] - p[1]) * s / (s - t)))
    return sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(out, out[1:] + out[:1])) / 2


def areas(spark, left, right):
    a = spark.createDataFrame(left, RINGS)
    b = spark.createDataFrame(right, RINGS).withColumnRenamed("zone", "other")
    return {(r["zone"], r["other"]): r["area"] for r in zone_index.overlay_areas(a, b, "zone", "other").collect()}


@pytest.mark.parametrize("far", [0.0, 1500.0])
def test_areas_of_known_shapes(spark, far):
    left = [("holed", [box(far, far, 4, 4), box(far + 1, far + 1, 2, 2), box(far + 1.5, far + 1.5, 1, 1), box(far + 9, far, 1, 1, -1)]),
            ("holed again", [box(far, far, 4, 4, -1), box(far + 1, far + 1, 2, 2, -1), box(far + 1.5, far + 1.5, 1, 1, -1)]),
            ("notch", [points([(far, far), (far + 4, far), (far + 4, far + 4), (far + 2, far + 1), (far, far + 4), (far, far)])]), ("none", [])]
    right = [("all", [box(far - 5, far - 5, 50, 50)]), ("half", [box(far - 1, far - 1, 3, 9)]), ("away", [box(far + 20, far, 1, 1)]),
             ("touching", [box(far + 4, far, 1, 1)]), ("tilted", [points([(far + 2, far), (far + 4, far + 2), (far + 2, far + 4), (far, far + 2), (far + 2, far)])])]
    got = areas(spark, left, right)
    want = {("holed", "all"): 14.0, ("holed", "half"): 6.5, ("holed again", "all"): 13.0, ("holed again", "half"): 6.5,
            ("notch", "all"): 10.0, ("notch", "half"): 5.0, ("holed", "tilted"): 5.0, ("holed again", "tilted"): 5.0}
    assert {k: v for k, v in got.items() if k in want} == pytest.approx(want, abs=1e-9 if not far else 1e-6)
    assert not {k for k in got if k[1] in ("away", "touching") or k[0] == "none"}


def test_areas_of_convex_shapes(spark):
    rng = np.random.default_rng(5)

    def convex():
        n, (cx, cy), r = rng.integers(3, 9), rng.uniform(0, 5, 2), rng.uniform(0.2, 2.5)
        t = np.sort(rng.uniform(0, 2 * np.pi, n))
        ring = [(float(cx + r * np.cos(v)), float(cy + r * np.sin(v))) for v in t]
        return [*ring, ring[0]]

    left, right = [(f"a{i}", convex()) for i in range(25)], [(f"b{i}", convex()) for i in range(25)]
    got = areas(spark, [(n, [points(r)]) for n, r in left], [(n, [points(r[::-1])]) for n, r in right])
    want = {(n, m): clipped(r, s) for n, r in left for m, s in right}
    assert got == pytest.approx({k: v for k, v in want.items() if v > 5e-10}, abs=2e-9)
    best = zone_index.largest_area(spark.createDataFrame([(1, 5, 2.0), (1, 3, 2.0), (1, 4, 1.0)], "a int, b int, area double"), "a", "b").first()
    assert tuple(best) == (1, 3, 2.0, 5.0)


# upstream sets -------------------------------------------------------------------------------------------------------------

def sets_by_hand(edges, start, most=None):
    above = {}
    for b, d, area in edges:
        if d is not None and (most is None or (area is not None and area <= most)):
            above.setdefault(d, []).append(b)
    out = {}
    for key in {k for k, _ in start}:
        now, steps = {b for k, b in start if k == key}, 0
        while now:
            out.update({(key, b): steps for b in now})
            now = {u for b in now for u in above.get(b, ()) if (key, u) not in out}
            steps += 1
    return out


def test_upstream_sets(spark):
    rng = random.Random(6)
    edges = [(b, rng.randrange(b) if b and rng.random() < 0.95 else None, rng.choice([None, 10.0, 20.0, 30.0])) for b in range(200)]
    edges += [(300, 301, 1.0), (301, 302, 1.0), (302, 300, 1.0)]
    start = [("x", 3), ("x", 9), ("y", 9), ("y", 301), ("z", 150), ("w", 999)]
    e = spark.createDataFrame(edges, "basin long, down long, area double")
    s = spark.createDataFrame(start + start[:1], "admin string, basin long")
    for most in (None, 20.0):
        got = spatial.upstream_sets(e, s, "basin", "down", ["admin"], "area" if most else None, most)
        assert {(r["admin"], r["basin"]): r["steps"] for r in got.collect()} == sets_by_hand(edges, start, most)


def test_a_long_river_takes_few_rounds(spark, monkeypatch):
    n, rounds = 10_000, []
    kept = spatial.cut_lineage
    monkeypatch.setattr(spatial, "cut_lineage", lambda df: rounds.append(1) or kept(df))
    edges = spark.range(1, n).select(F.col("id").alias("basin"), (F.col("id") - 1).alias("down"))
    got = spatial.upstream_sets(edges, spark.createDataFrame([(0,)], "basin long"), "basin", "down", [])
    assert got.agg(F.count("*"), F.max("steps"), F.sum(F.col("steps") - F.col("basin"))).first() == (n, n - 1, 0)
    assert (len(rounds) - 2) / 2 <= 15
