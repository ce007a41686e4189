"""Window queries over densified series."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rolling as W
from ..operators import series as T
from ..operators import triggers as X
from ..operators.windows import along, whole
from . import domain as D
from .registry import query


@query("w01_centred_max", """
SELECT zone, date, CASE WHEN count(value) OVER w >= 3 THEN max(value) OVER w END AS max_7 FROM zone_dense
WINDOW w AS (PARTITION BY zone ORDER BY date ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)""")
def _(spark, sf):
    return W.rolling_centred_max(D.zone_dense(spark, sf), ["zone"], "value", "max_7").select("zone", "date", "max_7")


@query("w01b_centred_max_full", """
SELECT zone, date, CASE WHEN count(value) OVER a >= 21 THEN max(value) OVER a END AS max_21,
  CASE WHEN count(value) OVER b >= 14 THEN max(value) OVER b END AS max_14 FROM zone_filled
WINDOW a AS (PARTITION BY zone ORDER BY date ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING),
  b AS (PARTITION BY zone ORDER BY date ROWS BETWEEN 6 PRECEDING AND 7 FOLLOWING)""")
def _(spark, sf):
    df = W.rolling_centred_max(D.zone_filled(spark, sf), ["zone"], "value", "max_21", 10, 10, 21)
    return W.rolling_centred_max(df, ["zone"], "value", "max_14", 6, 7, 14).select("zone", "date", "max_21", "max_14")


@query("w02_trailing_sums", """
SELECT zone, date, sum(value) OVER p AS sum_3, CASE WHEN count(value) OVER f >= 10 THEN sum(value) OVER f END AS sum_10,
  CASE WHEN count(value) OVER p >= 3 THEN round(avg(value) OVER p, 6) END AS mean_3 FROM zone_filled
WINDOW p AS (PARTITION BY zone ORDER BY date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW),
  f AS (PARTITION BY zone ORDER BY date ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)""")
def _(spark, sf):
    df = W.rolling_trailing(D.zone_filled(spark, sf), ["zone"], "value", "sum_3", 3, "sum", full=False)
    df = W.rolling_trailing(df, ["zone"], "value", "sum_10", 10)
    df = W.rolling_trailing(df, ["zone"], "value", "mean_3", 3, "mean")
    return df.select("zone", "date", "sum_3", "sum_10", F.round("mean_3", 6).alias("mean_3"))


@query("w03_trailing_days", """
SELECT station, date, """ + ", ".join(
    f"max(value) OVER w{t} AS value_max_{t}, sum(value) OVER w{t} AS value_cum_{t}" for t in (0, 3, 9)) + """
FROM station_days WINDOW """ + ", ".join(
    f"w{t} AS (PARTITION BY station ORDER BY date RANGE BETWEEN INTERVAL {t} DAY PRECEDING AND CURRENT ROW)" for t in (0, 3, 9)))
def _(spark, sf):
    return W.rolling_days(D.station_days(spark, sf), ["station"], "value", [0, 3, 9]).drop("rain", "value")


@query("w04_shifts", """
SELECT zone, date, lag(value, 1) OVER w AS value_lag1, lag(value, 4) OVER w AS value_lag4,
  lead(value, 3) OVER w AS value_lead3, lead(value, 7) OVER w AS value_lead7 FROM zone_filled
WINDOW w AS (PARTITION BY zone ORDER BY date)""")
def _(spark, sf):
    return W.shifts(D.zone_filled(spark, sf), ["zone"], "value", [1, 4, -3, -7]).drop("value", "rain")


@query("w05_locf", "SELECT station, date, value FROM station_filled")
def _(spark, sf):
    return D.station_filled(spark, sf).select("station", "date", "value")


@query("w06_interpolate", """
WITH f AS (SELECT zone, date, value,
  last_value(value IGNORE NULLS) OVER p AS pv, last_value(CASE WHEN value IS NOT NULL THEN date END IGNORE NULLS) OVER p AS pd,
  first_value(value IGNORE NULLS) OVER n AS nv, first_value(CASE WHEN value IS NOT NULL THEN date END IGNORE NULLS) OVER n AS nd
  FROM zone_dense WINDOW p AS (PARTITION BY zone ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  n AS (PARTITION BY zone ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT zone, date, round(coalesce(value, pv + (nv - pv) * ((date - pd) / (nd - pd))), 6) AS value FROM f""")
def _(spark, sf):
    return T.interpolate(D.zone_dense(spark, sf), ["zone"], "value").select(
        "zone", "date", F.round("value", 6).alias("value"))


@query("w07_resample_daily", """
SELECT zone, date, last_value(value IGNORE NULLS) OVER (PARTITION BY zone ORDER BY date) AS value FROM (
  SELECT c.zone, c.date, m.value FROM (SELECT zone, CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date
  FROM zone_months GROUP BY zone) c LEFT JOIN zone_months m USING (zone, date))""")
def _(spark, sf):
    monthly = D.zone_months(spark, sf).select("zone", "date", "value")
    return T.locf(T.densify(monthly, ["zone"]), ["zone"], ["value"])


@query("w08_runs", """
WITH f AS (SELECT zone, date, CASE WHEN value >= 60 THEN 1 ELSE 0 END AS wet FROM zone_filled),
c AS (SELECT *, CASE WHEN lag(wet) OVER (PARTITION BY zone ORDER BY date) = wet THEN 0 ELSE 1 END AS ch FROM f),
r AS (SELECT zone, date, wet, CAST(sum(ch) OVER (PARTITION BY zone ORDER BY date) AS BIGINT) AS run_id FROM c)
SELECT zone, date, wet, run_id, row_number() OVER (PARTITION BY zone, run_id ORDER BY date) AS run_pos FROM r""")
def _(spark, sf):
    f = D.zone_filled(spark, sf).select("zone", "date", X.exceedance(F.col("value"), F.lit(60.0)).alias("wet"))
    return W.runs(f, ["zone"], "wet")


def peaks(spark, sf, day_range: int = 30):
    days = D.zone_flagged(spark, sf).withColumn("exceeds", X.exceedance(F.col("value"), F.lit(150.0)))
    return X.peak_ranges(days, ["zone"], "exceeds", day_range)


PEAKS_SQL = """
WITH e AS (SELECT zone, date, event, CASE WHEN value >= 150 THEN 1 ELSE 0 END AS exceeds FROM zone_flagged),
s AS (SELECT *, CASE WHEN exceeds = 1 AND coalesce(lag(exceeds) OVER w, 0) = 0 THEN 1 ELSE 0 END AS peak_start,
  CASE WHEN exceeds = 1 AND lead(exceeds) OVER w = 0 THEN 1 ELSE 0 END AS stop FROM e WINDOW w AS (PARTITION BY zone ORDER BY date)),
d AS (SELECT *, coalesce(lag(stop, 30) OVER (PARTITION BY zone ORDER BY date), 0) AS late FROM s),
c AS (SELECT *, CAST(sum(peak_start) OVER w AS BIGINT) AS peak_no, CASE WHEN sum(peak_start) OVER w > sum(late) OVER w THEN 1 ELSE 0 END AS in_range
  FROM d WINDOW w AS (PARTITION BY zone ORDER BY date)),
t AS (SELECT *, CASE WHEN in_range = 1 AND coalesce(lag(in_range) OVER (PARTITION BY zone ORDER BY date), 0) = 0
  THEN 1 ELSE 0 END AS triggered FROM c)
"""


@query("w09_merged_ranges", PEAKS_SQL + "SELECT zone, date, exceeds, peak_no, in_range FROM t")
def _(spark, sf):
    return peaks(spark, sf).select("zone", "date", "exceeds", "peak_no", "in_range")


@query("w10_cooldown", """
WITH h AS (SELECT zone, date, value FROM zone_filled WHERE value >= 150)
SELECT 'since_previous' AS mode, zone, date, gap_days FROM (SELECT *, date - lag(date) OVER (PARTITION BY zone ORDER BY date) AS gap_days FROM h)
WHERE gap_days IS NULL OR gap_days > 14 UNION ALL
SELECT 'until_next', zone, date, gap_days FROM (SELECT *, lead(date) OVER (PARTITION BY zone ORDER BY date) - date AS gap_days FROM h)
WHERE gap_days > 30""")
def _(spark, sf):
    hot = D.zone_filled(spark, sf).where("value >= 150").select("zone", "date")
    return T.cooldowns(hot, ["zone"], {"since_previous": 14, "until_next": 30})


@query("w11_extend_alarms", """
SELECT zone, date, event, CASE WHEN event = 1 THEN max(alarm) OVER w WHEN max(event) OVER w = 1 THEN 0 ELSE alarm END AS alarm
FROM (SELECT zone, date, event, CASE WHEN value >= 100 THEN 1 ELSE 0 END AS alarm FROM zone_flagged)
WINDOW w AS (PARTITION BY zone ORDER BY date ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)""")
def _(spark, sf):
    days = D.zone_flagged(spark, sf).withColumn("alarm", X.exceedance(F.col("value"), F.lit(100.0)))
    return W.extend_alarms(days, ["zone"], "alarm", "event", 2).select("zone", "date", "event", "alarm")


@query("w12_moving_years", """
WITH y AS (SELECT zone, year(date) AS year, sum(value) AS value FROM zone_days GROUP BY 1, 2),
m AS (SELECT *, CASE WHEN count(value) OVER w >= 5 THEN avg(value) OVER w END AS mm FROM y
  WINDOW w AS (PARTITION BY zone ORDER BY year RANGE BETWEEN 4 PRECEDING AND CURRENT ROW))
SELECT zone, year, round(mm, 6) AS moving_mean, round(value - mm, 6) AS deviation,
  round((value - mm - avg(value - mm) OVER g) / nullif(stddev_samp(value - mm) OVER g, 0), 6) AS deviation_z
FROM m WINDOW g AS (PARTITION BY zone)""")
def _(spark, sf):
    y = D.zone_days(spark, sf).groupBy("zone", F.year("date").alias("year")).agg(F.sum("value").alias("value"))
    out = W.moving_years(y, ["zone"], "value", 5)
    return out.select("zone", "year", *[F.round(c, 6).alias(c) for c in ("moving_mean", "deviation", "deviation_z")])


@query("w13_ranking", """
SELECT zone, date, value, row_number() OVER (PARTITION BY zone ORDER BY value DESC, date) AS rn,
  r FROM (SELECT zone, date, value, rank() OVER (PARTITION BY zone ORDER BY value DESC) AS r FROM zone_days) WHERE r <= 10""")
def _(spark, sf):
    by = along(["zone"], [F.desc("value")])
    top = D.zone_days(spark, sf).withColumn("r", F.rank().over(by)).where("r <= 10")
    rn = F.row_number().over(along(["zone"], [F.desc("value"), "date"]))
    return top.select("zone", "date", "value", rn.alias("rn"), "r")


@query("w14_group_transform", """
SELECT zone, date, value, round(avg(value) OVER w, 6) AS mean, max(value) OVER w AS high, min(value) OVER w AS low
FROM zone_months WINDOW w AS (PARTITION BY zone)""")
def _(spark, sf):
    g = whole(["zone"])
    return D.zone_months(spark, sf).select(
        "zone", "date", "value", F.round(F.avg("value").over(g), 6).alias("mean"),
        F.max("value").over(g).alias("high"), F.min("value").over(g).alias("low"))


@query("w15_rolling_origin", """
SELECT zone, date, value, train_start, train_end, round(train_mean, 6) AS train_mean FROM (
  SELECT *, min(date) OVER w AS train_start, max(date) OVER w AS train_end, count(*) OVER w AS n, avg(value) OVER w AS train_mean
  FROM zone_months WINDOW w AS (PARTITION BY zone ORDER BY date ROWS BETWEEN 48 PRECEDING AND 1 PRECEDING)) WHERE n = 48""")
def _(spark, sf):
    out = W.rolling_origin(D.zone_months(spark, sf), ["zone"], "value", 48)
    return out.select("zone", "date", "value", "train_start", "train_end", F.round("train_mean", 6).alias("train_mean"))
