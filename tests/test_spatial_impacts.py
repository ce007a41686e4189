import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from forewarn.functions import scalar as S
from forewarn.operators import impacts as I
from forewarn.operators import reshape as R
from forewarn.operators import spatial as G
from forewarn.operators.triggers import best_row
from forewarn.session import work_path
from forewarn.sources import readers, writers

D0 = dt.date(2020, 1, 1)


def inside(x, y, ring):
    odd = False
    for (ax, ay), (bx, by) in zip(ring, ring[1:]):
        if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
            odd = not odd
    return odd


def test_points_in_concave_zone(spark):
    ring = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (2.0, 1.0), (0.0, 4.0), (0.0, 0.0)]
    zones = spark.createDataFrame([("u", [dict(x=a, y=b) for a, b in ring])], "zone string, ring array<struct<x:double,y:double>>")
    rng = np.random.default_rng(1)
    pts = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.uniform(-1, 5, (300, 2)))]
    df = spark.createDataFrame(pts, "id int, x double, y double")
    got = {r["id"] for r in G.points_in_zones(df, zones, "zone", "x", "y").collect()}
    assert got == {i for i, x, y in pts if inside(x, y, ring)}


@pytest.mark.parametrize("k,max_km", [(1, 30.0), (2, 70.0), (3, 90.0)])
def test_nearest_stations_brute_force(spark, k, max_km):
    rng = np.random.default_rng(3)
    st = [(i, *[round(float(v), 1) for v in rng.uniform(0, 3, 2)]) for i in range(60)]
    st += [(100 + i, 1.0, 1.0) for i in range(5)]  # five stations in one place
    zs = [(z, *[float(v) for v in rng.uniform(0, 3, 2)]) for z in range(12)] + [(50, 1.0, 1.05)]
    stations = spark.createDataFrame(st, "station int, x double, y double")
    zones = spark.createDataFrame(zs, "zone int, zx double, zy double")
    got = {(r["zone"], r["rank"]): r["station"] for r in
           G.nearest_stations(zones, stations, "zone", "station", "zx", "zy", "x", "y", k, max_km).collect()}
    want = {}
    pairs = zones.select("zone", "zx", "zy").crossJoin(stations).select(
        "zone", "station", F.round(S.haversine_km(F.col("zy"), F.col("zx"), F.col("y"), F.col("x")), 6).alias("km")).collect()
    for z, *_ in zs:
        near = sorted((r["km"], r["station"]) for r in pairs if r["zone"] == z and r["km"] <= max_km)[:k]
        want.update({(z, i + 1): s for i, (_, s) in enumerate(near)})
    assert got == want


def greedy(table, start, steps, limit):
    """The published procedure on plain dictionaries: pool the new neighbours, take the best."""
    pool, chosen, poi = {}, [], start
    for _ in range(steps + 1):
        for (a, b), p in table.items():
            if a == poi and b != start and b not in chosen and b not in pool:
                pool[b] = p
        free = [(-p, b) for b, p in pool.items() if b not in chosen]
        if not free or -min(free)[0] <= limit:
            break
        poi = min(free)[1]
        chosen.append(poi)
    return pool, chosen


def test_greedy_path_brute_force(spark):
    rng = np.random.default_rng(5)
    table = {(a, b): float(rng.integers(1, 100)) for a in range(12) for b in range(12) if a != b and rng.random() < 0.4}
    df = spark.createDataFrame([(a, b, p) for (a, b), p in table.items()], "cell int, neighbour int, percentage double")
    out = G.greedy_path(df, "cell", "neighbour", 0, steps=5, limit=40.0).collect()
    pool, chosen = greedy(table, 0, 5, 40.0)
    assert {r["neighbour"]: r["percentage"] for r in out} == pool
    assert {r["neighbour"] for r in out if r["selected"] == 1} == set(chosen)


def test_upstream_closure_with_hub_and_cycle(spark):
    edges = spark.createDataFrame([(2, 1), (3, 1), (4, 2), (5, 4), (7, 6), (1, 5)], "basin int, down int")
    start = spark.createDataFrame([(1,)], "basin int")
    got = {r["basin"]: r["steps"] for r in G.upstream(edges, start, "basin", "down").collect()}
    assert got == {1: 0, 2: 1, 3: 1, 4: 2, 5: 3}


def test_neighbour_overlap(spark):
    rows = [(0, 0, D0), (0, 0, D0 + dt.timedelta(1)), (1, 0, D0), (3, 0, D0)]
    df = spark.createDataFrame(rows, "cx int, cy int, date date")
    got = {(r["cx"], r["nx"]): r["percentage"] for r in G.neighbour_overlap(df, "cx", "cy", "date").collect()}
    assert got == {(0, 0): 100.0, (0, 1): 50.0, (1, 0): 100.0, (1, 1): 100.0, (3, 3): 100.0}


def test_event_chain(spark):
    rows = [("a", D0 + dt.timedelta(d), float(v)) for d, v in ((0, 10), (5, 0), (11, 20), (18, 5))]
    out = I.cluster_events(spark.createDataFrame(rows, "z string, date date, n double"), ["z"], ["n"], 7).orderBy("event_no").collect()
    assert [(r["reports"], r["n"]) for r in out] == [(3, 15.0), (1, 5.0)]


def test_missing_parts_of_dates(spark):
    df = spark.createDataFrame([(2015, None, None, None, None, None), (2015, 4, None, None, None, None), (2015, 2, 31, 2015, 3, 2)],
                               "a int, b int, c int, d int, e int, f int")
    s, e, m = S.event_interval(*[F.col(c) for c in "abcdef"])
    rows = [tuple(str(v) for v in r) for r in df.select(s, e, m).collect()]
    assert rows[0][:2] == ("2015-01-01", "2015-12-31") and rows[1] == ("2015-04-01", "2015-04-30", "2015-04-15")
    assert rows[2][:2] == ("2015-02-01", "2015-03-02")


def test_missing_addend_and_bad_dates(spark):
    r = spark.createDataFrame([(1, None)], "a int, b int").select(S.add_missing(F.col("a"), F.col("b"))).first()
    assert r[0] == 1
    d = spark.createDataFrame([("31/02/2020",), ("05/03/2020",)], "d string").select(S.parse_date(F.col("d"), "dd/MM/yyyy")).collect()
    assert d[0][0] is None and str(d[1][0]) == "2020-03-05"


def test_reshape_round_trip(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0), (2, 4.0, 5.0)], "k int, a double, b double")
    long = R.to_long(df, ["k"], ["a", "b"])
    wide = R.to_wide(long, ["k"], "variable", ["a", "b"], F.first("value"))
    assert sorted(wide.collect()) == sorted(df.collect())
    text = spark.createDataFrame([(1, "G1", "NA", " ", None)], "k int, s1 string, s2 string, s3 string, s4 string")
    assert [r["value"] for r in R.to_long(text, ["k"], ["s1", "s2", "s3", "s4"]).collect()] == ["G1"]


def test_clean_names(spark):
    df = spark.createDataFrame([(1, 2, 3)], ["Area (km2)", "area km2", "X"])
    assert R.clean_columns(df).columns == ["area_km2", "area_km2_2", "x"]


def test_best_row_puts_missing_last(spark):
    df = spark.createDataFrame([("a", None, 1), ("a", 0.5, 3), ("a", 0.5, 2)], "k string, far double, s int")
    assert best_row(df, ["k"], F.col("far"), F.col("s")).first()["s"] == 2


def test_nan_is_missing(spark):
    path = work_path(spark, "nan")
    df = spark.createDataFrame([(1, 1.5), (2, float("nan"))], "k int, v double")
    writers.write_delimited(df, path, sep=";")
    out = readers.read_delimited(spark, path, "k INT, v DOUBLE", sep=";")
    assert out.agg(F.max("v")).first()[0] == 1.5


def test_upsert_is_idempotent(spark):
    path = work_path(spark, "upsert")
    a = spark.createDataFrame([(1, "x", 1.0), (2, "y", 2.0)], "k int, p string, v double")
    b = spark.createDataFrame([(2, "y", 9.0), (3, "y", 3.0)], "k int, p string, v double")
    for part in (a, b, b):
        writers.upsert(part, path, ["k"], ["p"])
    assert sorted((r["k"], r["v"]) for r in spark.read.parquet(path).collect()) == [(1, 1.0), (2, 9.0), (3, 3.0)]


def test_cells_meet_small_and_thin_zones(spark):
    """A zone inside a cell and a sliver across one, neither of which holds a centre or a corner."""
    shapes = {"inside": [(0.51, 0.51), (0.53, 0.51), (0.53, 0.53), (0.51, 0.51)],
              "sliver": [(-1.0, 1.565), (3.0, 1.566), (3.0, 1.567), (-1.0, 1.565)],
              "around": [(0.0, 2.0), (1.0, 2.0), (1.0, 3.0), (0.0, 3.0), (0.0, 2.0)], "far": [(9.0, 9.0), (9.1, 9.0), (9.0, 9.1), (9.0, 9.0)]}
    zones = spark.createDataFrame([(n, [dict(x=a, y=b) for a, b in r]) for n, r in shapes.items()],
                                  "zone string, ring array<struct<x:double,y:double>>")
    cells = spark.createDataFrame([(1, 0.55, 0.55), (2, 0.45, 1.55), (3, 0.55, 2.55), (4, 0.95, 1.45)], "id int, x double, y double")
    got = {(r["id"], r["zone"]) for r in G.cells_touching_zones(cells, zones, "zone", "x", "y").collect()}
    assert got == {(1, "inside"), (2, "sliver"), (3, "around")}


def test_numbering_keeps_all_rows(spark):
    df = spark.createDataFrame([(1, i, float(i)) for i in range(9)] + [(2, 7, 1.0)], "zone int, station int, level double")
    wide = R.spread_slots(R.number_within(df, ["zone"], [F.desc("level")], "st"), ["zone"], "station")
    slots = {r["zone"]: r["slots"] for r in wide.collect()}
    assert slots == {1: {f"st{i + 1}": 8 - i for i in range(9)}, 2: {"st1": 7}}


def test_upsert_moves_keys_and_keeps_the_latest(spark):
    path = work_path(spark, "moves")
    schema = "id int, day string, v double, n int"
    writers.upsert(spark.createDataFrame([(1, "a", 1.0, 0), (2, "a", 2.0, 0), (3, "b", 3.0, 0)], schema), path, ["id"], ["day"], "n")
    moved = spark.createDataFrame([(1, "c", 9.0, 1), (3, "a", 5.0, 2), (3, "c", 4.0, 1), (2, "a", 0.0, -1)], schema)
    for _ in range(2):  # a replay changes nothing
        writers.upsert(moved, path, ["id"], ["day"], "n")
        got = sorted((r["id"], r["day"], r["v"]) for r in spark.read.parquet(path).collect())
        assert got == [(1, "c", 9.0), (2, "a", 2.0), (3, "a", 5.0)]


def test_upsert_into_a_broken_table_fails(spark):
    path = work_path(spark, "broken")
    spark.createDataFrame([("no table",)], "value string").write.text(path)
    with pytest.raises(Exception):
        writers.upsert(spark.createDataFrame([(1, "a")], "id int, day string"), path, ["id"], ["day"])
    assert spark.read.text(path).count() == 1


def test_ingest_resumes_and_live_triggers_ignore_order(spark):
    from forewarn.streaming import jobs
    base = dt.datetime(2024, 1, 1)
    days = [0, 1, 5, 6, 11, 20, 21, 30, 40]
    rows = [(1, base + dt.timedelta(days=d), 1) for d in days] + [(2, base + dt.timedelta(days=d), d % 2) for d in range(41)]
    halves = [rows[::2], rows[1::2]]
    found = []
    for number, (order, files) in enumerate([((0, 1), 1), ((1, 0), 1), ((0, 1), 9)]):
        inbox = work_path(spark, "inbox")
        for i in order:
            spark.createDataFrame(halves[i], "key long, ts timestamp, over int").coalesce(1).write.mode("append").parquet(inbox)
        stream = jobs.file_stream(spark, inbox, "key long, ts timestamp, over int", files_per_batch=files)
        out = jobs.live_triggers(stream, "key", "ts", "over", 3, late="100 days")
        # a last row far ahead lets the watermark pass
        spark.createDataFrame([(3, base + dt.timedelta(days=200), 0)], "key long, ts timestamp, over int").coalesce(1).write.mode("append").parquet(inbox)
        t = spark.read.parquet(jobs.available_now(out, f"live{number}"))
        found.append(sorted((r["station"], (r["date"] - base.date()).days) for r in t.collect()))
    assert found[0] == found[1] == found[2] == [(1, 0), (1, 5), (1, 11), (1, 20), (1, 30), (1, 40), (2, 1)]


def test_live_triggers_keep_one_timer_for_a_station():
    import pandas as pd
    from forewarn.streaming import jobs

    class State:
        def __init__(self):
            self.rows = []

        def get(self):
            return list(self.rows)

        def exists(self):
            return bool(self.rows)

        def put(self, rows):
            self.rows = list(rows)

        def appendList(self, rows):
            self.rows += rows

        def update(self, row):
            self.rows = row

        def clear(self):
            self.rows = []

    class Handle:
        def __init__(self):
            self.timers = []

        def getValueState(self, *_):
            return State()

        def getListState(self, *_):
            return State()

        def registerTimer(self, at):
            self.timers.append(at)

    class Now:
        def __init__(self, day):
            self.day = day

        def getCurrentWatermarkInMs(self):
            return self.day * jobs.DAY_MS

    p, handle = jobs.PeakRanges(3), Handle()
    p.init(handle)

    def come(days, now):
        rows = pd.DataFrame({"day": days, "exceeds": [1] * len(days)})
        return [d for t in p.handleInputRows((1,), iter([rows]), Now(now)) for d in t["day"]]

    def wake(now):
        return [d for t in p.handleExpiredTimer((1,), Now(now), None) for d in t["day"]]

    assert come(list(range(10, 40)), 0) == [] and handle.timers == [11 * jobs.DAY_MS]
    assert come([50, 60], 0) == [] and len(handle.timers) == 1
    assert come([5], 0) == [] and handle.timers[1:] == [6 * jobs.DAY_MS]  # an earlier day wakes earlier
    assert wake(30) == [5, 10] and handle.timers[2:] == [31 * jobs.DAY_MS]
    assert wake(61) == [50, 60] and len(handle.timers) == 3


def test_live_triggers_go_on_after_a_restart(spark):
    """Days that waited in the state of a query that ended are decided by the next one, as if it had never ended."""
    from forewarn.streaming import jobs
    base = dt.datetime(2024, 1, 1)
    days = [0, 1, 5, 6, 11, 20, 21, 30, 40]
    rows = [(1, base + dt.timedelta(days=d), 1) for d in days] + [(2, base + dt.timedelta(days=d), d % 2) for d in range(41)]
    inbox, table, progress = (work_path(spark, x) for x in ("inbox", "fired", "progress"))
    schema = "key long, ts timestamp, over int"
    for part in (rows[1::2], rows[::2], [(3, base + dt.timedelta(days=200), 0)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(inbox)
        stream = jobs.file_stream(spark, inbox, schema)
        jobs.available_now(jobs.live_triggers(stream, "key", "ts", "over", 3, late="100 days"), "live", checkpoint=progress, table=table)
    found = sorted((r["station"], (r["date"] - base.date()).days) for r in spark.read.parquet(table).collect())
    assert found == [(1, 0), (1, 5), (1, 11), (1, 20), (1, 30), (1, 40), (2, 1)]


def test_upstream_has_no_round_limit(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(12)] + [(0, 12)], "basin long, down long")
    start = spark.createDataFrame([(0,)], "basin long")
    assert {r["basin"]: r["steps"] for r in G.upstream(edges, start, "basin", "down").collect()} == {i: i for i in range(13)}


def test_work_tables_are_removed(spark):
    from forewarn.session import workspace
    with workspace(spark) as made:
        path = work_path(spark, "gone")
        spark.range(3).write.parquet(path)
        assert made == [path] and writers.exists(spark, path)
    assert not writers.exists(spark, path)


def test_a_cluster_needs_a_shared_folder():
    from forewarn import session

    class Context:
        master = "spark://host"

        def getCheckpointDir(self):
            return None

    class Fake:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(name, default=None):
                return default

    with pytest.raises(RuntimeError):
        session.shared_dir(Fake())


def test_zones_with_holes_and_parts(spark):
    square = lambda x, y, s: [dict(x=a, y=b) for a, b in ((x, y), (x + s, y), (x + s, y + s), (x, y + s), (x, y))]
    zones = spark.createDataFrame([("z", [square(0.0, 0.0, 4.0), square(1.0, 1.0, 2.0), square(1.5, 1.5, 1.0), square(9.0, 9.0, 1.0)])],
                                  "zone string, ring array<array<struct<x:double,y:double>>>")
    df = spark.createDataFrame([(1, 0.5, 0.5), (2, 1.2, 1.2), (3, 2.0, 2.0), (4, 9.5, 9.5), (5, 6.0, 6.0)], "id int, x double, y double")
    assert {r["id"] for r in G.points_in_zones(df, zones, "zone", "x", "y").collect()} == {1, 3, 4}
    assert {r["id"] for r in G.cells_touching_zones(df, zones, "zone", "x", "y", half=0.25).collect()} == {1, 2, 3, 4}


def test_nearest_stations_across_the_date_line_and_at_the_pole(spark):
    stations = spark.createDataFrame([(1, -179.9, 0.0), (2, 178.0, 0.0), (3, 10.0, 89.9), (4, -179.95, 50.0)], "station int, x double, y double")
    zones = spark.createDataFrame([(1, 179.9, 0.0), (2, -170.0, 89.8), (3, -179.95, 50.1)], "zone int, zx double, zy double")
    got = {(r["zone"], r["rank"]): r["station"] for r in
           G.nearest_stations(zones, stations, "zone", "station", "zx", "zy", "x", "y", 2, 60.0).collect()}
    assert got == {(1, 1): 1, (2, 1): 3, (3, 1): 4}
