import datetime as dt

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from forewarn.operators import rolling as W
from forewarn.operators import series as T
from forewarn.operators import triggers as X
from forewarn.plans import pipelines as P

D0 = dt.date(2020, 1, 1)


def series(spark, values, key=1, name="value"):
    rows = [(key, D0 + dt.timedelta(days=i), float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, f"k int, date date, {name} double")


def pull(df, *cols):
    return [tuple(r) if len(cols) > 1 else r[0] for r in df.orderBy("k", "date").select(*cols).collect()]


def test_densify_and_fill(spark):
    df = spark.createDataFrame([(1, D0, 1.0), (1, D0 + dt.timedelta(3), 4.0), (2, D0, None), (2, D0 + dt.timedelta(1), 7.0)],
                               "k int, date date, value double")
    dense = T.densify(df, ["k"])
    assert pull(dense, "value") == [1.0, None, None, 4.0, None, 7.0]
    assert pull(T.locf(dense, ["k"], ["value"]), "value") == [1.0, 1.0, 1.0, 4.0, None, 7.0]
    both = T.locf(dense, ["k"], ["value"], direction="downup")
    assert pull(both, "value") == [1.0, 1.0, 1.0, 4.0, 7.0, 7.0]
    assert pull(T.locf(both, ["k"], ["value"]), "value") == pull(both, "value")  # idempotent
    assert pull(T.interpolate(dense, ["k"], "value"), "value")[:4] == [1.0, 2.0, 3.0, 4.0]


def test_densify_to_common_span(spark):
    df = series(spark, [5.0])
    out = T.densify(df, ["k"], start=F.lit("2019-12-30").cast("date"), end=F.lit("2020-01-02").cast("date"))
    assert pull(out, "value") == [None, None, 5.0, None]


def test_filled_with_marks_equals_fill_then_join(spark):
    df = spark.createDataFrame([(1, D0, 1.0), (1, D0 + dt.timedelta(4), 4.0)], "k int, date date, value double")
    marks = spark.createDataFrame([(1, D0 + dt.timedelta(i)) for i in (-2, 1, 1, 4, 9)], "k int, date date")
    got = T.filled_with_marks(df, marks, ["k"], "value", [])
    want = T.attach_flag(T.locf(T.densify(df, ["k"]), ["k"], ["value"]), marks, ["k"])
    assert pull(got, "value", "event") == pull(want, "value", "event") == [
        (1.0, 0), (1.0, 1), (1.0, 0), (1.0, 0), (4.0, 1)]


def test_events_of_one_day_do_not_duplicate_rows(spark):
    df = series(spark, [1.0, 2.0])
    ev = spark.createDataFrame([(1, D0), (1, D0)], "k int, date date")
    assert pull(T.attach_flag(df, ev, ["k"]), "event") == [1, 0]


def test_rolling_windows(spark):
    df = series(spark, [1.0, 5.0, 2.0, 4.0, 3.0])
    assert pull(W.rolling_centred_max(df, ["k"], "value", "m", 1, 1, 3), "m") == [None, 5.0, 5.0, 4.0, None]
    assert pull(W.rolling_trailing(df, ["k"], "value", "s", 3), "s") == [None, None, 8.0, 11.0, 9.0]
    assert pull(W.rolling_trailing(df, ["k"], "value", "s", 3, full=False), "s") == [1.0, 6.0, 8.0, 11.0, 9.0]
    days = W.rolling_days(df, ["k"], "value", [0, 2])
    assert pull(days, "value_max_2", "value_cum_2")[2] == (5.0, 8.0)


def test_short_windows_are_not_dry(spark):
    assert pull(W.dry_spells(series(spark, [0.0, 0.0, 5.0, 0.0]), ["k"], "value", 2, 2.0), "dry") == [0, 1, 0, 0]


def test_runs_never_cross_keys(spark):
    df = series(spark, [1, 1, 0]).union(series(spark, [0, 1], key=2)).selectExpr("k", "date", "cast(value as int) f")
    assert pull(W.runs(df, ["k"], "f"), "run_id", "run_pos") == [(1, 1), (1, 2), (2, 1), (1, 1), (2, 1)]


def test_extend_alarms(spark):
    rows = [(1, D0 + dt.timedelta(i), a, e) for i, (a, e) in enumerate([(0, 0), (1, 0), (0, 1), (1, 0), (0, 0), (1, 0)])]
    df = spark.createDataFrame(rows, "k int, date date, a int, e int")
    assert pull(W.extend_alarms(df, ["k"], "a", "e", 2), "a") == [0, 0, 1, 0, 0, 1]


def test_cooldown_modes(spark):
    df = spark.createDataFrame([(1, D0 + dt.timedelta(i)) for i in (0, 1, 20, 30, 60)], "k int, date date")
    keep = [r[0] for r in T.cooldown(df, ["k"], 14).orderBy("date").select(F.datediff("date", F.lit(D0))).collect()]
    assert keep == [0, 20, 60]
    keep = [r[0] for r in T.cooldown(df, ["k"], 14, mode="until_next").orderBy("date").select(F.datediff("date", F.lit(D0))).collect()]
    assert keep == [1, 30]


def test_peak_ranges_by_hand(spark):
    x = [0, 1, 1, 0, 0, 1, 0, 0, 0, 0]
    p = X.peak_ranges(series(spark, x, name="x").selectExpr("k", "date", "cast(x as int) x"), ["k"], "x", 2)
    assert pull(p, "peak_start") == [0, 1, 0, 0, 0, 1, 0, 0, 0, 0]
    assert pull(p, "in_range") == [0, 1, 1, 1, 0, 1, 1, 0, 0, 0]
    assert pull(p, "triggered") == [0, 1, 0, 0, 0, 1, 0, 0, 0, 0]


def test_strict_na_first_row(spark):
    x = series(spark, [1, 0, 1], name="x").selectExpr("k", "date", "cast(x as int) x")
    strict = X.peak_ranges(x, ["k"], "x", 1, strict_na=True)
    assert pull(strict, "in_range") == [None, None, None]
    assert pull(X.peak_ranges(x, ["k"], "x", 1), "in_range") == [1, 0, 1]


@pytest.mark.parametrize("seed", [1, 2])
def test_trigger_table_equals_single_thresholds(spark, seed):
    rng = np.random.default_rng(seed)
    n = 300
    vals = rng.integers(0, 30, n).astype(float)
    ev = (rng.random(n) < 0.06).astype(int)
    rows = [(1, D0 + dt.timedelta(i), float(vals[i]), int(ev[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "k int, date date, value double, event int")
    percents = [50, 80, 95]
    levels = [float(np.quantile(vals, p / 100)) for p in percents]
    leveled = df.withColumn("levels", F.array(*[F.lit(v) for v in levels]))
    for day_range in (1, 4, 15):
        table = {r["percent"]: r.asDict() for r in X.trigger_table(leveled, ["k"], "value", "event", "levels", percents, day_range).collect()}
        last = None
        for p, lv in zip(percents, levels):
            one = X.peak_ranges(df.withColumn("x", X.exceedance(F.col("value"), F.lit(lv))), ["k"], "x", day_range)
            want = X.trigger_summary(one, ["k"], "event").first().asDict()
            got = dict(table[p])
            got.pop("percent")
            assert got == want
            assert want["floods_correct"] <= want["floods"]
            assert want["floods_incorrect"] == want["floods"] - want["floods_correct"]
            last = want
        assert last is not None


def test_wider_range_never_adds_triggers(spark):
    rng = np.random.default_rng(3)
    x = series(spark, [float(v) for v in (rng.random(200) < 0.2)], name="x").selectExpr("k", "date", "cast(x as int) x")
    counts = [X.peak_ranges(x, ["k"], "x", r).agg(F.sum("triggered")).first()[0] for r in (1, 3, 10, 40)]
    assert counts == sorted(counts, reverse=True)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(0, 1), min_size=3, max_size=40), st.integers(1, 6))
def test_in_range_is_a_recent_exceedance(spark, flags, day_range):
    x = series(spark, [float(f) for f in flags], name="x").selectExpr("k", "date", "cast(x as int) x")
    got = pull(X.peak_ranges(x, ["k"], "x", day_range), "in_range")
    s = pd.Series(flags).rolling(day_range, min_periods=1).max().astype(int).tolist()
    assert got == s


def test_more_thresholds_than_bits(spark):
    values = [float((i * 37) % 101) for i in range(120)]
    df = series(spark, values).withColumn("event", (F.dayofyear("date") % 11 == 0).cast("int"))
    percents = list(range(1, 71))
    levels = df.withColumn("levels", F.array(*[F.lit(float(p)) for p in percents]))
    whole = {r["percent"]: tuple(r) for r in X.trigger_table(levels, ["k"], "value", "event", "levels", percents, 5).collect()}
    some = df.withColumn("levels", F.array(*[F.lit(float(p)) for p in (3, 40, 69)]))
    for r in X.trigger_table(some, ["k"], "value", "event", "levels", [3, 40, 69], 5).collect():
        assert whole[r["percent"]] == tuple(r)
    assert sorted(whole) == percents


def test_series_are_spread_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(T, "SERIES", 2)
    day = F.to_date(F.lit("2020-01-01"))
    df = spark.range(40).select(F.col("id").alias("k"), day.alias("date"), F.lit(1.0).alias("value"))
    ends = df.union(df.withColumn("date", F.date_add("date", 9)))
    out = T.filled_with_marks(ends, df.select("k", "date"), ["k"], "value", [], n_series=40)
    assert out.rdd.getNumPartitions() == 20 and out.count() == 400 and out.where("event = 1").count() == 40
    mapping = df.select(F.col("k").alias("station"), F.lit(1).alias("zone"))
    hazard, events = ends.withColumnRenamed("k", "station"), df.limit(1).select(F.lit(1).alias("zone"), "date")
    flagged = P.flagged_stations(hazard, mapping, events)
    assert flagged.rdd.getNumPartitions() == 20 and flagged.where("event = 1").count() == 40
