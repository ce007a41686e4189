"""Trigger, skill, index and impact queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import forecast_metrics as M
from ..operators import frugal
from ..operators import impacts as I
from ..operators import indices as N
from ..operators import models as L
from ..operators import quantiles as Q
from ..operators import reshape as R
from ..operators import rolling as W
from ..operators import series as T
from ..operators import skill as K
from ..operators import spatial as G
from ..operators import triggers as X
from ..operators.windows import along, whole
from ..session import cut_lineage, work_path
from . import domain as D
from . import pipelines as P
from .q_aggregates import PERCENTS, Q90, predicted
from .q_scalars import ppf_sql
from .q_windows import PEAKS_SQL, peaks
from .registry import query


def half_up_sql(num: str, den: str) -> str:
    return f"floor(CAST({num} AS DOUBLE) / nullif({den}, 0) * 100.0 + 0.5) / 100.0"


SCORES_SQL = f"""CAST(f AS BIGINT) AS floods, CAST(c AS BIGINT) AS floods_correct, CAST(f - c AS BIGINT) AS floods_incorrect,
  CAST(t AS BIGINT) AS protocol_triggered, CAST(v AS BIGINT) AS triggered_in_vain,
  {half_up_sql('c', 'f')} AS detection_ratio, {half_up_sql('v', 't')} AS false_alarm_ratio"""


@query("x01_exceedance", """
SELECT zone, date, CASE WHEN value >= 100 THEN 1 ELSE 0 END AS ge, CASE WHEN value > 100 THEN 1 ELSE 0 END AS gt,
  CASE WHEN value < 100 THEN 1 ELSE 0 END AS lt, CASE WHEN value <= 100 THEN 1 ELSE 0 END AS le FROM zone_dense""")
def _(spark, sf):
    v, t = F.col("value"), F.lit(100.0)
    names = {">=": "ge", ">": "gt", "<": "lt", "<=": "le"}
    return D.zone_dense(spark, sf).select("zone", "date", *[X.exceedance(v, t, o).alias(n) for o, n in names.items()])


@query("x02_either_hazard", """
SELECT zone, date, CASE WHEN value >= 150 OR (zone % 3 <> 0 AND rain >= 300000) THEN 1 ELSE 0 END AS exceeds_or,
  CASE WHEN value >= 150 AND zone % 3 <> 0 AND rain >= 300000 THEN 1 ELSE 0 END AS exceeds_and FROM zone_filled""")
def _(spark, sf):
    days = D.zone_filled(spark, sf).withColumn("rain", F.when(F.col("zone") % 3 != 0, F.col("rain")))
    # zones divisible by three have no rain data at all
    long = days.withColumnRenamed("value", "flow").unpivot(["zone", "date"], ["flow", "rain"], "hazard", "v")
    limits = {"flow": 150.0, "rain": 300000.0}
    return X.either_hazard(long, ["zone"], "hazard", "v", limits, how="both")


@query("x03_peak_ranges", PEAKS_SQL + """SELECT zone, date, event, peak_start, peak_no, in_range, triggered,
  CASE WHEN event = 1 AND in_range = 1 THEN peak_no ELSE 0 END AS flood_in_which_peak FROM t""")
def _(spark, sf):
    p = peaks(spark, sf)
    return p.select("zone", "date", "event", "peak_start", "peak_no", "in_range", "triggered",
                    (F.col("peak_no") * F.col("event") * F.col("in_range")).alias("flood_in_which_peak"))


@query("x04_trigger_summary", PEAKS_SQL + f"""SELECT zone, {SCORES_SQL} FROM (SELECT zone, sum(event) AS f,
  sum(event * in_range) AS c, sum(triggered) AS t, sum(triggered) - (count(DISTINCT peak_no * event * in_range) - 1) AS v
  FROM t GROUP BY zone)""")
def _(spark, sf):
    return X.trigger_summary(peaks(spark, sf), ["zone"], "event")


@query("x05_falling_edge", f"""
WITH e AS (SELECT zone, date, event, CASE WHEN value > 150 THEN 1 ELSE 0 END AS x FROM zone_flagged),
g AS (SELECT *, CASE WHEN x = 0 AND lag(x) OVER (PARTITION BY zone ORDER BY date) = 1 THEN 1 ELSE 0 END AS fall FROM e)
SELECT zone, {SCORES_SQL} FROM (SELECT zone, sum(event) AS f, sum(event * x) AS c, sum(fall) AS t,
  sum(fall) - sum(event * x) AS v FROM g GROUP BY zone)""")
def _(spark, sf):
    days = D.zone_flagged(spark, sf).withColumn("x", X.exceedance(F.col("value"), F.lit(150.0), ">"))
    return X.falling_edge_summary(days, ["zone"], "x", "event")


LEADS = [3, 7]


def best_triggers(spark, sf):
    return P.warning_table(D.station_flagged(spark, sf), LEADS, PERCENTS, 40)


TABLE_SQL = f"""
WITH l AS (SELECT zone, station, date, event, k AS lead, lead(value, CAST(k AS INTEGER)) OVER (PARTITION BY station, k ORDER BY date) AS value
  FROM station_flagged, (VALUES (3), (7)) x(k)),
s AS (SELECT * FROM l WHERE value IS NOT NULL),
q AS (SELECT station, lead, p AS percent, round(list_extract(quantile_cont(value, {[p / 100 for p in PERCENTS]}),
  CAST(list_position({PERCENTS}, p) AS INTEGER)), 6) AS threshold FROM s, (SELECT unnest({PERCENTS}) AS p) GROUP BY station, lead, p),
e AS (SELECT s.*, percent, CASE WHEN value >= threshold THEN 1 ELSE 0 END AS x FROM s JOIN q USING (station, lead)),
a AS (SELECT *, CASE WHEN x = 1 AND coalesce(lag(x) OVER w, 0) = 0 THEN 1 ELSE 0 END AS start,
  CASE WHEN x = 1 AND lead(x) OVER w = 0 THEN 1 ELSE 0 END AS stop FROM e WINDOW w AS (PARTITION BY station, lead, percent ORDER BY date)),
b AS (SELECT *, coalesce(lag(stop, 40) OVER (PARTITION BY station, lead, percent ORDER BY date), 0) AS late FROM a),
c AS (SELECT *, sum(start) OVER w AS no, CASE WHEN sum(start) OVER w > sum(late) OVER w THEN 1 ELSE 0 END AS inr
  FROM b WINDOW w AS (PARTITION BY station, lead, percent ORDER BY date)),
d AS (SELECT *, CASE WHEN inr = 1 AND coalesce(lag(inr) OVER (PARTITION BY station, lead, percent ORDER BY date), 0) = 0 THEN 1 ELSE 0 END AS fire FROM c),
t AS (SELECT zone, station, lead, percent, sum(event) AS f, sum(event * inr) AS c, sum(fire) AS t,
  sum(fire) - (count(DISTINCT no * event * inr) - 1) AS v FROM d GROUP BY 1, 2, 3, 4),
tt AS (SELECT zone, station, lead, percent, {SCORES_SQL} FROM t)
"""


@query("x06_trigger_table", TABLE_SQL + "SELECT * FROM tt WHERE detection_ratio > 0")
def _(spark, sf):
    return best_triggers(spark, sf)


PERIOD_SQL = """round(h / nullif(h + m, 0), 6) AS pod, round((s - h) / nullif(s, 0), 6) AS far,
  round((s - h) / nullif(s + m, 0), 6) AS pofd, round(h / nullif(s + m, 0), 6) AS csi"""


@query("x07_period_skill", f"""
WITH p AS (SELECT f.zone, date, event, CASE WHEN value >= thr THEN 1 ELSE 0 END AS x FROM zone_flagged f JOIN {Q90} t ON f.zone = t.zone),
s AS (SELECT *, CASE WHEN x = 1 AND coalesce(lag(x) OVER (PARTITION BY zone ORDER BY date), 0) = 0 THEN 1 ELSE 0 END AS st FROM p),
n AS (SELECT *, sum(st) OVER (PARTITION BY zone ORDER BY date) AS no FROM s),
g AS (SELECT zone, count(DISTINCT CASE WHEN event = 1 AND x = 1 THEN no END) AS hp, count(*) FILTER (event = 1 AND x = 1) AS hd,
  CAST(sum(st) AS BIGINT) AS s, count(*) FILTER (event = 1 AND x = 0) AS m FROM n GROUP BY zone)
SELECT zone, variant, h AS hits, s - h AS false_alarms, m AS misses, {PERIOD_SQL} FROM (
  SELECT zone, 'per_period' AS variant, hp AS h, s, m FROM g UNION ALL SELECT zone, 'per_day', hd, s, m FROM g)""")
def _(spark, sf):
    return K.period_skill(predicted(spark, sf), ["zone"], "event", "pred", hits="both")


RATIO_SQL = """round(tp / nullif(tp + fn, 0), 6) AS pod, round(fp / nullif(tp + fp, 0), 6) AS far,
  round(fp / nullif(fp + tn, 0), 6) AS pofd, round(tp / nullif(tp + fp + fn, 0), 6) AS csi"""
COUNTS_SQL = """count(*) FILTER (event = 1 AND x = 1) AS tp, count(*) FILTER (event = 0 AND x = 1) AS fp,
  count(*) FILTER (event = 0 AND x = 0) AS tn, count(*) FILTER (event = 1 AND x = 0) AS fn"""


@query("x08_day_skill", f"""
WITH p AS (SELECT f.zone, date, event, CASE WHEN value >= thr THEN 1 ELSE 0 END AS x FROM zone_flagged f JOIN {Q90} t ON f.zone = t.zone),
c AS (SELECT zone, {COUNTS_SQL} FROM p GROUP BY zone) SELECT *, {RATIO_SQL} FROM c""")
def _(spark, sf):
    return K.skill_ratios(K.confusion(predicted(spark, sf), ["zone"], "event", "pred"))


def sweep_sql(block: str, percents: list[int]) -> str:
    return f"""
WITH bm AS (SELECT station, {block} AS b, max(value) AS mx FROM station_days GROUP BY 1, 2),
q AS (SELECT station, p AS percent, round(list_extract(quantile_cont(mx, {[p / 100 for p in percents]}),
  CAST(list_position({percents}, p) AS INTEGER)), 6) AS thr FROM bm, (SELECT unnest({percents}) AS p) GROUP BY station, p),
p AS (SELECT zone, station, percent, date, event, CASE WHEN value >= thr THEN 1 ELSE 0 END AS x FROM station_flagged JOIN q USING (station)),
s AS (SELECT *, CASE WHEN x = 1 AND coalesce(lag(x) OVER (PARTITION BY station, percent ORDER BY date), 0) = 0 THEN 1 ELSE 0 END AS st FROM p),
n AS (SELECT *, sum(st) OVER (PARTITION BY station, percent ORDER BY date) AS no FROM s),
g AS (SELECT zone, station, percent, count(DISTINCT CASE WHEN event = 1 AND x = 1 THEN no END) AS h,
  CAST(sum(st) AS BIGINT) AS s, count(*) FILTER (event = 1 AND x = 0) AS m FROM n GROUP BY 1, 2, 3),
k AS (SELECT zone, station, percent, h AS hits, s - h AS false_alarms, m AS misses, {PERIOD_SQL} FROM g)
"""


def maxima_sweep(spark, sf, block, percents):
    return P.station_skill(D.station_flagged(spark, sf), D.station_days(spark, sf), block, percents)


@query("x09_fixed_quantiles", sweep_sql("year(date)", [50, 80, 90]) + "SELECT * FROM k")
def _(spark, sf):
    return maxima_sweep(spark, sf, F.year("date"), [50, 80, 90])


@query("x09b_lookback_quantiles", f"""
WITH r AS (SELECT zone, date, event, max(value) OVER (PARTITION BY zone ORDER BY date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS v FROM zone_flagged),
q AS (SELECT zone, p AS percent, round(list_extract(quantile_cont(value, [0.9, 0.95, 0.98]), CAST(list_position([90, 95, 98], p) AS INTEGER)), 6) AS thr
  FROM zone_flagged, (SELECT unnest([90, 95, 98]) AS p) GROUP BY zone, p),
p AS (SELECT r.zone, percent, event, CASE WHEN v >= thr THEN 1 ELSE 0 END AS x FROM r JOIN q ON r.zone = q.zone),
c AS (SELECT zone, percent, {COUNTS_SQL} FROM p GROUP BY 1, 2) SELECT *, {RATIO_SQL} FROM c""")
def _(spark, sf):
    days = Q.with_levels(D.zone_flagged(spark, sf), ["zone"], "value", [90, 95, 98])
    days = W.rolling_trailing(days, ["zone"], "value", "recent", 3, "max", full=False)
    return K.skill_ratios(K.day_sweep(days, ["zone"], "recent", "event", "levels", [90, 95, 98]))


GRID = list(range(50, 100))


@query("x10_threshold_search", sweep_sql(
    "year(date) * 2 + CASE WHEN month(date) > 6 THEN 1 ELSE 0 END", GRID) + """
SELECT zone, station, percent, hits, false_alarms, misses, pod, far, pofd, csi, objective FROM (SELECT *, row_number() OVER (
  PARTITION BY zone ORDER BY objective NULLS LAST, station, percent) AS rn FROM (
  SELECT *, round(0.5 * far + 0.5 * (1 - pod), 6) AS objective FROM k)) WHERE rn = 1""")
def _(spark, sf):
    return P.best_thresholds(maxima_sweep(spark, sf, S.half_year(F.col("date")), GRID))


YEARLY = [80, 90, 95, 99]


@query("x11_yearly_hits", f"""
WITH l AS (SELECT zone, station, date, k AS lead, lead(value, CAST(k AS INTEGER)) OVER (PARTITION BY station, k ORDER BY date) AS value
  FROM station_flagged, (VALUES (0), (4), (7)) x(k)),
q AS (SELECT station, lead, p AS percent, round(list_extract(quantile_cont(value, [0.8, 0.9, 0.95, 0.99]),
  CAST(list_position({YEARLY}, p) AS INTEGER)), 6) AS thr FROM l, (SELECT unnest({YEARLY}) AS p) WHERE value IS NOT NULL GROUP BY 1, 2, 3),
y AS (SELECT zone, station, lead, year(date) AS year, max(value) AS mx FROM l WHERE value IS NOT NULL GROUP BY 1, 2, 3, 4),
t AS (SELECT DISTINCT zone, year(date) AS year FROM impact_reports WHERE severity > 350000),
p AS (SELECT y.zone, y.lead, percent, CASE WHEN mx > thr THEN 1 ELSE 0 END AS x, CASE WHEN t.zone IS NULL THEN 0 ELSE 1 END AS event
  FROM y JOIN q USING (station, lead) LEFT JOIN t ON t.zone = y.zone AND t.year = y.year)
SELECT zone, lead, percent, {COUNTS_SQL} FROM p GROUP BY 1, 2, 3""")
def _(spark, sf):
    by = ["zone", "station", "lead"]
    s = P.lead_series(D.station_flagged(spark, sf), [0, 4, 7])
    # one pass per series: its quantiles and its yearly maxima come from the same partitions
    y = Q.with_levels(s, by, "value", YEARLY).groupBy(*by, F.year("date").alias("year")).agg(
        F.max("value").alias("mx"), F.any_value("levels").alias("levels"))
    truth = D.events(spark, sf).where("severity > 350000").select("zone", F.year("date").alias("year")).distinct()
    y = y.join(truth.withColumn("event", F.lit(1)), ["zone", "year"], "left").withColumn(
        "event", F.coalesce("event", F.lit(0)))
    grid = F.array(*[F.struct(F.lit(p).alias("percent"), (F.col("mx") > F.col("levels")[i]).cast("int").alias("x"))
                     for i, p in enumerate(YEARLY)])
    flat = y.select("zone", "lead", "event", F.inline(grid))
    return K.confusion(flat, ["zone", "lead", "percent"], "event", "x")


PERIODS = [2, 5, 10, 20, 25]

GEV_SQL = """
rk AS (SELECT *, row_number() OVER (PARTITION BY station ORDER BY mx) AS r, count(*) OVER (PARTITION BY station) AS n FROM bm),
lm AS (SELECT station, count(*) AS n, avg(mx) AS b0, sum(CAST(r - 1 AS DOUBLE) / nullif(n - 1, 0) * mx) / count(*) AS b1,
  sum(CAST((r - 1) * (r - 2) AS DOUBLE) / nullif((n - 1) * (n - 2), 0) * mx) / count(*) AS b2 FROM rk GROUP BY station),
l3 AS (SELECT station, n, b0 AS l1, 2 * b1 - b0 AS l2, 6 * b2 - 6 * b1 + b0 AS l3 FROM lm),
sh AS (SELECT *, 7.8590 * c + 2.9554 * c * c AS k FROM (SELECT *, 2.0 / (3.0 + l3 / l2) - ln(2) / ln(3) AS c
  FROM l3 WHERE n >= 3 AND l2 > 0)),
sc AS (SELECT *, l2 * k / ((1 - pow(2.0, -k)) * gamma(1 + k)) AS a FROM sh),
lv AS (SELECT station, n, k, a, l1 - a * (1 - gamma(1 + k)) / k AS loc FROM sc),
rl AS (SELECT station, period, round(loc + a * (1 - pow(-ln(1 - 1.0 / period), k)) / k, 6) AS level
  FROM lv, (VALUES (2), (5), (10), (20), (25)) p(period))
"""

ENSEMBLE_SQL = """
en AS (SELECT label + 10 * (vec_id // 500) AS station, DATE '1990-01-01' + CAST((vec_id % 500) * 20 AS INTEGER) AS date, embedding FROM embeddings),
mem AS (SELECT station, date, unnest(embedding) AS m FROM en),
mean AS (SELECT station, date, round(avg(CAST(m AS DOUBLE)), 9) AS v FROM mem GROUP BY 1, 2),
bm AS (SELECT station, year(date) AS y, max(v) AS mx FROM mean GROUP BY 1, 2),
"""


def ensemble(spark, sf):
    """Forecast members per station and date."""
    date = F.date_add(F.lit("1990-01-01").cast("date"), ((F.col("vec_id") % 500) * 20).cast("int"))
    return D.table(spark, sf, "embeddings").select(
        (F.col("label") + 10 * F.floor(F.col("vec_id") / 500)).alias("station"), date.alias("date"),
        F.col("embedding").cast("array<double>").alias("members"))


def ensemble_levels(spark, sf, periods=PERIODS):
    means = ensemble(spark, sf).select("station", "date", F.round(S.array_mean(F.col("members")), 9).alias("v"))
    maxima = Q.block_maxima(means, ["station"], "v", F.year("date"))
    return Q.return_levels(Q.gev_parameters(Q.l_moments(maxima, ["station"], "block_max")), ["station"], periods)


@query("x12_return_period_triggers", "WITH " + ENSEMBLE_SQL.strip() + GEV_SQL + """,
act AS (SELECT m.station, m.date, period, 100.0 * count(*) FILTER (m > level) / count(*) AS act FROM mem m
  JOIN rl ON m.station = rl.station GROUP BY 1, 2, 3),
hot AS (SELECT *, date - lag(date) OVER (PARTITION BY station, period ORDER BY date) AS gap FROM act WHERE act >= 40)
SELECT station, period, count(*) AS triggers, min(date) AS first_trigger FROM hot WHERE coalesce(gap, 9999) > 14 GROUP BY 1, 2""")
def _(spark, sf):
    hot = X.return_period_triggers(ensemble(spark, sf), ["station"], "members", ensemble_levels(spark, sf), 40.0, 14)
    return hot.groupBy("station", "period").agg(F.count("*").alias("triggers"), F.min("date").alias("first_trigger"))


@query("x13_spaced_triggers", f"""
WITH e AS (SELECT f.zone, date, CASE WHEN value > thr THEN 1 ELSE 0 END AS x FROM zone_filled f JOIN {Q90} q ON f.zone = q.zone),
s AS (SELECT *, CASE WHEN x = 1 AND coalesce(lag(x) OVER w, 0) = 0 THEN 1 ELSE 0 END AS st,
  CASE WHEN x = 1 AND lead(x) OVER w = 0 THEN 1 ELSE 0 END AS stop FROM e WINDOW w AS (PARTITION BY zone ORDER BY date)),
d AS (SELECT *, coalesce(lag(stop, 50) OVER (PARTITION BY zone ORDER BY date), 0) AS late FROM s),
c AS (SELECT *, CASE WHEN sum(st) OVER w > sum(late) OVER w THEN 1 ELSE 0 END AS inr FROM d WINDOW w AS (PARTITION BY zone ORDER BY date)),
t AS (SELECT zone, date, inr, coalesce(lag(inr) OVER (PARTITION BY zone ORDER BY date), 0) AS was FROM c),
h AS (SELECT zone, date, lead(date) OVER (PARTITION BY zone ORDER BY date) - date AS gap_days FROM t WHERE inr = 1 AND was = 0)
SELECT zone, date, gap_days FROM h WHERE gap_days > 90""")
def _(spark, sf):
    days = Q.with_levels(D.zone_filled(spark, sf), ["zone"], "value", [90])
    days = days.withColumn("x", X.exceedance(F.col("value"), F.col("levels")[0], ">"))
    fired = X.peak_ranges(days, ["zone"], "x", 50).where("triggered = 1").select("zone", "date")
    return T.cooldown(fired, ["zone"], 90, mode="until_next")


@query("x14_drought_quantile", f"""
WITH ev AS (SELECT DISTINCT zone, CAST(date_trunc('month', date) AS DATE) AS date FROM impact_reports WHERE severity > 400000),
m AS (SELECT z.zone, z.date, z.value, z.rain, CASE WHEN ev.zone IS NULL THEN 0 ELSE 1 END AS event FROM zone_months z LEFT JOIN ev USING (zone, date)),
l AS (SELECT zone, date, event, 'value' AS indicator, value AS v FROM m UNION ALL SELECT zone, date, event, 'rain', rain FROM m),
t AS (SELECT *, round(quantile_cont(v, 0.1) OVER (PARTITION BY zone, indicator), 6) AS thr FROM l),
n AS (SELECT *, max(event) OVER (PARTITION BY zone, indicator ORDER BY date ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING) AS near FROM t),
a AS (SELECT *, CASE WHEN v < thr THEN 1 ELSE 0 END AS alarm FROM n WHERE near = 1),
x AS (SELECT zone, indicator, event, CASE WHEN event = 1 THEN max(alarm) OVER w WHEN max(event) OVER w = 1 THEN 0 ELSE alarm END AS x
  FROM a WINDOW w AS (PARTITION BY zone, indicator ORDER BY date ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
c AS (SELECT CAST(n_regionkey AS BIGINT) AS country, zone, indicator, {COUNTS_SQL} FROM x JOIN nation ON zone = n_nationkey GROUP BY 1, 2, 3),
u AS (SELECT country, zone, indicator, tp, fp, tn, fn FROM c UNION ALL
  SELECT country, -1, indicator, CAST(sum(tp) AS BIGINT), CAST(sum(fp) AS BIGINT), CAST(sum(tn) AS BIGINT), CAST(sum(fn) AS BIGINT) FROM c GROUP BY 1, 3)
SELECT *, {RATIO_SQL}, tp + fn AS n_events FROM u""")
def _(spark, sf):
    ev = D.events(spark, sf).where("severity > 400000").select("zone", F.trunc("date", "month").alias("date"))
    m = T.attach_flag(D.zone_months(spark, sf), ev, ["zone"])
    by = ["zone", "indicator"]
    long = m.unpivot(["zone", "date", "event"], ["value", "rain"], "indicator", "v").where("v IS NOT NULL")
    long = Q.with_levels(long, by, "v", [10])
    near = W.crop_around(long, by, "event", 10, 10)
    near = near.withColumn("alarm", X.exceedance(F.col("v"), F.col("levels")[0], "<"))
    counts = K.confusion(W.extend_alarms(near, by, "alarm", "event", 2), by, "event", "alarm")
    country = D.table(spark, sf, "nation").select(F.col("n_nationkey").cast("bigint").alias("zone"),
                                                  F.col("n_regionkey").cast("bigint").alias("country"))
    counts = counts.join(country, "zone")
    total = counts.groupBy("country", "indicator").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "tn", "fn")])
    both = counts.unionByName(total.withColumn("zone", F.lit(-1).cast("bigint")))
    return K.skill_ratios(both).withColumn("n_events", F.col("tp") + F.col("fn"))


@query("x15_seasonal_skill", f"""
WITH s AS (SELECT zone, year(date) AS year, CASE WHEN month(date) IN (3,4,5) THEN 1 WHEN month(date) IN (7,8,9) THEN 2 ELSE 3 END AS season,
  round(sum(rain), 2) AS rain, sum(value) / count(*) AS flow FROM zone_months GROUP BY 1, 2, 3),
i AS (SELECT zone, year, season, 'rain_season' AS indicator, rain AS v, round(0.01 * round(avg(rain) OVER (PARTITION BY zone, season), 4) * (100 - 10), 4) AS thr FROM s
  UNION ALL SELECT zone, year, season, 'flow', flow, 1150.0 FROM s),
ev AS (SELECT DISTINCT zone, year(date) AS year FROM impact_reports WHERE severity > 400000),
p AS (SELECT i.zone, season, indicator, CASE WHEN v < thr THEN 1 ELSE 0 END AS x, CASE WHEN ev.zone IS NULL THEN 0 ELSE 1 END AS event
  FROM i LEFT JOIN ev ON ev.zone = i.zone AND ev.year = i.year),
c AS (SELECT zone, season, indicator, {COUNTS_SQL} FROM p GROUP BY 1, 2, 3)
SELECT *, {RATIO_SQL} FROM c""")
def _(spark, sf):
    m = D.zone_months(spark, sf).withColumns({"year": F.year("date"), "season": S.season_code(F.col("date"))})
    s = m.groupBy("zone", "year", "season").agg(F.round(F.sum("rain"), 2).alias("rain_season"),
                                                (F.sum("value") / F.count("*")).alias("flow"))
    long = s.unpivot(["zone", "year", "season"], ["rain_season", "flow"], "indicator", "v")
    mean = F.round(F.avg("v").over(whole(["zone", "season", "indicator"])), 4)
    thr = F.when(F.col("indicator") == "rain_season", F.round(0.01 * mean * (100 - 10), 4)).otherwise(F.lit(1150.0))
    long = long.withColumn("thr", thr)
    long = long.withColumn("x", X.exceedance(F.col("v"), F.col("thr"), "<"))
    ev = D.events(spark, sf).where("severity > 400000").select("zone", F.year("date").alias("year")).distinct()
    long = long.join(ev.withColumn("event", F.lit(1)), ["zone", "year"], "left").withColumn(
        "event", F.coalesce("event", F.lit(0)))
    return K.skill_ratios(K.confusion(long, ["zone", "season", "indicator"], "event", "x"))


@query("x16_index_vs_yield", f"""
WITH z AS (SELECT zone, date, round((value - avg(value) OVER w) / stddev_samp(value) OVER w, 6) AS z FROM zone_months WINDOW w AS (PARTITION BY zone)),
i AS (SELECT zone, year(date) AS year, min(z) AS idx FROM z WHERE month(date) <= 3 GROUP BY 1, 2),
y AS (SELECT zone, year(date) AS year, round(sum(rain), 2) AS yield FROM zone_days GROUP BY 1, 2),
yz AS (SELECT zone, year, round((yield - avg(yield) OVER w) / stddev_samp(yield) OVER w, 6) AS yz FROM y WINDOW w AS (PARTITION BY zone)),
p AS (SELECT CAST(n_regionkey AS BIGINT) AS region, i.year, max(CASE WHEN idx <= -0.65 THEN 1 ELSE 0 END) AS x, max(CASE WHEN yz <= -0.5 THEN 1 ELSE 0 END) AS event
  FROM i JOIN yz USING (zone, year) JOIN nation ON i.zone = n_nationkey GROUP BY 1, 2),
c AS (SELECT region, {COUNTS_SQL} FROM p GROUP BY 1) SELECT *, {RATIO_SQL} FROM c""")
def _(spark, sf):
    z = N.z_score(D.zone_months(spark, sf), ["zone"], "value", "z")
    i = z.where(F.month("date") <= 3).groupBy("zone", F.year("date").alias("year")).agg(F.round(F.min("z"), 6).alias("idx"))
    y = D.zone_days(spark, sf).groupBy("zone", F.year("date").alias("year")).agg(F.round(F.sum("rain"), 2).alias("yield"))
    y = N.z_score(y, ["zone"], "yield", "yz").withColumn("yz", F.round("yz", 6))
    region = D.table(spark, sf, "nation").select(F.col("n_nationkey").cast("bigint").alias("zone"), F.col("n_regionkey").alias("region"))
    both = i.join(y, ["zone", "year"]).join(region, "zone").groupBy("region", "year").agg(
        F.max((F.col("idx") <= -0.65).cast("int")).alias("x"), F.max((F.col("yz") <= -0.5).cast("int")).alias("event"))
    return K.skill_ratios(K.confusion(both, ["region"], "event", "x"))


@query("x17_phase_vs_next_year", f"""
WITH y AS (SELECT zone, year(date) AS year, sum(value) AS value, round(sum(rain), 2) AS rain FROM zone_days GROUP BY 1, 2),
z AS (SELECT zone, year, round((value - avg(value) OVER w) / stddev_samp(value) OVER w, 6) AS vz,
  round((rain - avg(rain) OVER w) / stddev_samp(rain) OVER w, 6) AS rz FROM y WINDOW w AS (PARTITION BY zone)),
p AS (SELECT a.zone, a.year, CASE WHEN a.vz < -1 THEN 4 WHEN a.vz < -0.25 THEN 3 WHEN a.vz < 0.5 THEN 2 ELSE 1 END AS phase,
  b.rz AS next_anomaly FROM z a JOIN z b ON a.zone = b.zone AND b.year = a.year + 1),
q AS (SELECT zone, CASE WHEN phase >= 3 THEN 1 ELSE 0 END AS x, CASE WHEN next_anomaly < -0.2 THEN 1 ELSE 0 END AS event FROM p)
SELECT *, {RATIO_SQL} FROM (SELECT zone, {COUNTS_SQL} FROM q GROUP BY zone)""")
def _(spark, sf):
    y = D.zone_days(spark, sf).groupBy("zone", F.year("date").alias("year")).agg(
        F.sum("value").alias("value"), F.round(F.sum("rain"), 2).alias("rain"))
    z = N.z_score(N.z_score(y, ["zone"], "value", "vz"), ["zone"], "rain", "rz")
    z = z.withColumns({"vz": F.round("vz", 6), "rz": F.round("rz", 6)})
    w = along(["zone"], "year")
    nxt = F.when(F.lead("year").over(w) == F.col("year") + 1, F.lead("rz").over(w))
    phase = F.when(F.col("vz") < -1, 4).when(F.col("vz") < -0.25, 3).when(F.col("vz") < 0.5, 2).otherwise(1)
    p = z.select("zone", phase.alias("phase"), nxt.alias("nxt")).where("nxt IS NOT NULL")
    p = p.select("zone", (F.col("phase") >= 3).cast("int").alias("x"), X.exceedance(F.col("nxt"), F.lit(-0.2), "<").alias("event"))
    return K.skill_ratios(K.confusion(p, ["zone"], "event", "x"))


@query("x18_dry_spells", """
WITH d AS (SELECT zone, date, coalesce(value, 0) AS v FROM zone_dense),
f AS (SELECT zone, date, v, CASE WHEN count(v) OVER w >= 5 AND sum(v) OVER w <= 60 THEN 1 ELSE 0 END AS dry FROM d
  WINDOW w AS (PARTITION BY zone ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
SELECT zone, year(date) AS year, """ + ", ".join(
    f"CAST(coalesce(sum(CASE WHEN month(date) = {m} THEN dry END), 0) AS BIGINT) AS dry_{m}, "
    f"coalesce(sum(CASE WHEN month(date) = {m} THEN v END), 0) AS rain_{m}" for m in range(1, 13)) + " FROM f GROUP BY 1, 2")
def _(spark, sf):
    days = D.zone_dense(spark, sf).withColumn("v", F.coalesce("value", F.lit(0.0)))
    dry = W.dry_spells(days, ["zone"], "v", 5, 60.0)
    m = dry.select("zone", F.year("date").alias("year"), F.month("date").alias("month"), "dry", "v")
    wide = m.groupBy("zone", "year").pivot("month", list(range(1, 13))).agg(F.sum("dry").alias("dry"), F.sum("v").alias("rain"))
    return wide.select("zone", "year", *[F.coalesce(f"{i}_{c}", F.lit(0)).alias(f"{c}_{i}") for i in range(1, 13) for c in ("dry", "rain")])


@query("x18b_dry_month_classes", """
WITH f AS (SELECT zone, date, CASE WHEN value <= 1150 THEN 1 ELSE 0 END AS dry FROM zone_months),
c AS (SELECT *, CASE WHEN lag(dry) OVER (PARTITION BY zone ORDER BY date) = dry THEN 0 ELSE 1 END AS ch FROM f),
r AS (SELECT zone, dry, sum(ch) OVER (PARTITION BY zone ORDER BY date) AS run FROM c),
s AS (SELECT zone, run, count(*) AS months FROM r WHERE dry = 1 GROUP BY 1, 2)
SELECT zone, count(*) FILTER (months < 3) AS under_3, count(*) FILTER (months BETWEEN 3 AND 4) AS from_3,
  count(*) FILTER (months BETWEEN 5 AND 9) AS from_5, count(*) FILTER (months >= 10) AS from_10 FROM s GROUP BY zone""")
def _(spark, sf):
    m = D.zone_months(spark, sf).withColumn("dry", X.exceedance(F.col("value"), F.lit(1150.0), "<="))
    return I.dry_month_classes(m, ["zone"], "dry")


SCALES = [1, 2, 3, 6, 12]
#: Monthly sums over every scale, as one long table.
ACCUMULATED_SQL = "a AS (" + " UNION ALL ".join(
    f"SELECT zone, date, {n} AS scale, CASE WHEN count(value) OVER w{n} >= {n} THEN sum(value) OVER w{n} END AS acc FROM src "
    f"WINDOW w{n} AS (PARTITION BY zone ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in SCALES) + ")"


@query("x19_spi", "WITH src AS (SELECT zone, date, value FROM zone_months), " + ACCUMULATED_SQL + """,
m AS (SELECT *, avg(acc) OVER g AS mean, avg(ln(acc)) OVER g AS lm FROM a WHERE acc IS NOT NULL WINDOW g AS (PARTITION BY zone, scale, month(date))),
s AS (SELECT *, CASE WHEN ln(mean) - lm > 0 THEN (1 + sqrt(1 + 4 * (ln(mean) - lm) / 3)) / (4 * (ln(mean) - lm)) END AS k FROM m),
p AS (SELECT zone, date, scale, acc, list_sum(list_transform(range(0, 1500), lambda n: exp(-(acc * k / mean) + (k + n) * ln(acc * k / mean) - lgamma(k + n + 1)))) AS p FROM s)
SELECT zone, date, scale, round(""" + ppf_sql("p") + ", 4) AS spi FROM p")
def _(spark, sf):
    out = N.spi(D.zone_months(spark, sf), ["zone"], "value", SCALES)
    return out.select("zone", "date", "scale", F.round("spi", 4).alias("spi"))


@query("x19b_spei", "WITH src AS (SELECT zone, date, value - 1000 AS value FROM zone_months), " + ACCUMULATED_SQL + """,
r AS (SELECT *, row_number() OVER (PARTITION BY zone, scale, month(date) ORDER BY acc, date) AS r, count(*) OVER (PARTITION BY zone, scale, month(date)) AS n
  FROM a WHERE acc IS NOT NULL),
w AS (SELECT *, avg(acc) OVER g AS w0, avg(CAST(n - r AS DOUBLE) / nullif(n - 1, 0) * acc) OVER g AS w1,
  sum(CAST((n - r) * (n - r - 1) AS DOUBLE) / nullif((n - 1) * (n - 2), 0) * acc) OVER g / n AS w2 FROM r WINDOW g AS (PARTITION BY zone, scale, month(date))),
b AS (SELECT *, (2 * w1 - w0) / nullif(6 * w1 - w0 - 6 * w2, 0) AS b FROM w),
g AS (SELECT *, CASE WHEN b > 1 THEN gamma(1 + 1 / b) * gamma(1 - 1 / b) END AS gg FROM b),
o AS (SELECT *, (w0 - 2 * w1) * b / gg AS al, w0 - (w0 - 2 * w1) * b AS og FROM g),
p AS (SELECT zone, date, scale, CASE WHEN acc - og > 0 THEN 1 / (1 + pow(al / (acc - og), b)) WHEN acc - og <= 0 THEN 0.0 END AS p FROM o WHERE gg IS NOT NULL)
SELECT zone, date, scale, round(""" + ppf_sql("p") + ", 4) AS spei FROM p WHERE p > 0 AND p < 1")
def _(spark, sf):
    m = D.zone_months(spark, sf).withColumn("balance", F.col("value") - 1000)
    out = N.spei(m, ["zone"], "balance", SCALES).where("spei IS NOT NULL")
    return out.select("zone", "date", "scale", F.round("spei", 4).alias("spei"))


STATION_BM_SQL = "WITH bm AS (SELECT station, year(date) AS y, max(value) AS mx FROM station_days GROUP BY 1, 2),"


@query("x20_return_levels", STATION_BM_SQL + GEV_SQL + "SELECT station, period, round(level, 4) AS level FROM rl")
def _(spark, sf):
    maxima = Q.block_maxima(D.station_days(spark, sf), ["station"], "value", F.year("date"))
    lv = Q.return_levels(Q.gev_parameters(Q.l_moments(maxima, ["station"], "block_max")), ["station"], PERIODS)
    return lv.withColumn("level", F.round("level", 4))


@query("x20b_return_levels_mle")
def _(spark, sf):
    maxima = Q.block_maxima(D.station_days(spark, sf), ["station"], "value", S.half_year(F.col("date")))
    return Q.gev_likelihood_levels(maxima, ["station"], "block_max", [2, 5, 10])


@query("x21_event_labels", """
WITH a AS (SELECT DISTINCT zone, CAST(date_trunc('month', date) AS DATE) AS date FROM impact_reports WHERE severity > 400000),
b AS (SELECT DISTINCT zone, CAST(date_trunc('month', date) AS DATE) AS date FROM impact_reports WHERE severity < 60000)
SELECT m.zone, m.date, m.value, CASE WHEN a.zone IS NULL THEN 0 ELSE 1 END AS news, CASE WHEN b.zone IS NULL THEN 0 ELSE 1 END AS archive,
  CASE WHEN a.zone IS NULL AND b.zone IS NULL THEN 0 ELSE 1 END AS any_source
FROM zone_months m LEFT JOIN a USING (zone, date) LEFT JOIN b USING (zone, date)""")
def _(spark, sf):
    e = D.events(spark, sf)
    out = I.label_months(D.zone_months(spark, sf), {"news": e.where("severity > 400000"), "archive": e.where("severity < 60000")})
    return out.drop("rain")


@query("x22_harmonise_sources", """
WITH s AS (SELECT 'sheet' AS data_source, location, y, m, d, people_dead, people_affected FROM (
  SELECT o_orderkey, 'Z' || (o_custkey % 25) AS location, year(o_orderdate) AS y, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE month(o_orderdate) END AS m,
  CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE day(o_orderdate) END AS d, CAST(o_orderkey % 7 AS DOUBLE) AS people_dead, o_totalprice AS people_affected
  FROM orders WHERE o_orderpriority <= '2-HIGH')),
st AS (SELECT *, make_date(y, coalesce(m, 1), coalesce(CASE WHEN m IS NULL AND d > 28 THEN 28 ELSE d END, 1)) AS start_date, last_day(make_date(y, coalesce(m, 12), 1)) AS end_date FROM s)
SELECT data_source, location, start_date + CAST(floor((end_date - start_date) / 2) AS INTEGER) AS event_date, start_date, end_date, people_dead, people_affected FROM st
UNION ALL
SELECT 'records', 'Z' || (o_custkey % 25), CAST(o_orderdate AS DATE), CAST(o_orderdate AS DATE), CAST(o_orderdate AS DATE),
  CAST(o_orderkey % 3 AS DOUBLE) + CASE WHEN o_orderkey % 2 = 0 THEN 1.0 ELSE 0.0 END, o_totalprice + 10.0
FROM orders WHERE o_orderpriority > '2-HIGH'""")
def _(spark, sf):
    # the two highest classes come as a sheet, all others as records
    o = D.table(spark, sf, "orders")
    k, day = F.col("o_orderkey"), F.dayofmonth("o_orderdate")
    none = F.lit(None).cast("int")
    place = F.concat(F.lit("Z"), (F.col("o_custkey") % 25).cast("string"))
    m = F.when(k % 4 != 0, F.month("o_orderdate"))
    d = F.when(k % 2 != 0, F.when(m.isNull() & (day > 28), 28).otherwise(day))
    sheet = o.where("o_orderpriority <= '2-HIGH'").select(
        F.lit("UGA").alias("iso"), F.lit("Flood").alias("disaster_type"), place.alias("location"),
        F.year("o_orderdate").alias("start_year"), m.alias("start_month"), d.alias("start_day"),
        none.alias("end_year"), none.alias("end_month"), none.alias("end_day"), (k % 7).alias("total_deaths"),
        none.alias("no_injured"), F.col("o_totalprice").alias("no_affected"))
    records = o.where("o_orderpriority > '2-HIGH'").select(
        F.lit("inundacion").alias("event"), place.alias("place"), F.year("o_orderdate").alias("year"),
        F.month("o_orderdate").alias("month"), day.alias("day"), (k % 3).alias("dead"), F.when(k % 2 == 0, 1).alias("missing"),
        none.alias("injured"), F.col("o_totalprice").alias("affected"), F.lit(10).alias("evacuated"))
    out = I.merge_sources("UGA", "flood", I.harmonise_sheet(sheet, "sheet"),
                          I.harmonise_records(records, "records", "UGA", {"INUNDACION": "flood", "SEQUIA": "drought"}))
    return out.select("data_source", "location", "event_date", "start_date", "end_date", "people_dead", "people_affected")


@query("x23_event_clusters", """
WITH g AS (SELECT zone, date, severity, report, date - lag(date) OVER (PARTITION BY zone ORDER BY date, report) AS gap FROM impact_reports),
c AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap >= 7 THEN 1 ELSE 0 END) OVER (PARTITION BY zone ORDER BY date, report) AS no FROM g)
SELECT zone, CAST(no AS BIGINT) AS event_no, min(date) AS start_date, max(date) AS end_date, count(*) AS reports,
  round(avg(severity), 4) AS severity, round(avg(nullif(report % 3, 0)), 6) AS deaths FROM c GROUP BY 1, 2""")
def _(spark, sf):
    ev = D.events(spark, sf).withColumn("deaths", F.col("report") % 3)
    out = I.cluster_events(ev, ["zone"], ["severity", "deaths"], 7)
    return out.withColumns({"severity": F.round("severity", 4), "deaths": F.round("deaths", 6)})


@query("x24_fill_event_day", """
WITH w AS (SELECT zone, month, date FROM (SELECT zone, CAST(date_trunc('month', date) AS DATE) AS month, date,
  row_number() OVER (PARTITION BY zone, date_trunc('month', date) ORDER BY rain DESC, date) AS rn FROM zone_days) WHERE rn = 1)
SELECT report, e.zone, CASE WHEN report % 2 = 0 THEN e.date ELSE w.date END AS date FROM impact_reports e
LEFT JOIN w ON e.zone = w.zone AND w.month = date_trunc('month', e.date)""")
def _(spark, sf):
    ev = D.events(spark, sf).select("report", "zone", F.trunc("date", "month").alias("month"),
                                    F.when(F.col("report") % 2 == 0, F.dayofmonth("date")).alias("day"))
    return I.fill_event_day(ev, D.zone_days(spark, sf), ["zone"], "rain").select("report", "zone", "date")


@query("x25_impact_catalogue", """
SELECT zone, date, station, value, reports, affected FROM (SELECT s_nationkey AS zone, f.date, f.station, f.value FROM station_filled f
  JOIN supplier ON f.station = s_suppkey) h FULL JOIN (SELECT zone, date, count(*) AS reports, round(sum(severity), 2) AS affected
  FROM impact_reports GROUP BY 1, 2) e USING (zone, date)""")
def _(spark, sf):
    hazard = D.station_filled(spark, sf).select("station", "date", "value")
    return I.catalogue(hazard, D.mapping(spark, sf), D.events(spark, sf), {
        "reports": F.count("*"), "affected": F.round(F.sum("severity"), 2)})


@query("x26_drought_catalogue", """
WITH y AS (SELECT zone, year(date) AS year, sum(value) AS harvest FROM zone_days GROUP BY 1, 2),
s AS (SELECT y.zone, y.year, m.month, make_date(CAST(y.year + m.off AS BIGINT), CAST(m.month AS BIGINT), 1) AS date, y.harvest FROM y
  JOIN (VALUES (9,0),(10,0),(11,0),(12,0),(1,1),(2,1),(3,1)) m(month, off) ON TRUE),
c AS (SELECT CAST(date_trunc('month', date) AS DATE) AS date, round(avg(value), 6) AS climate FROM zone_months GROUP BY 1)
SELECT s.zone, s.year AS season_year, s.month, s.date, CASE WHEN s.month <= 3 THEN NULL ELSE c.climate END AS predictor,
  z.value, n.harvest AS next_harvest FROM s LEFT JOIN c USING (date) LEFT JOIN zone_months z ON z.zone = s.zone AND z.date = s.date
LEFT JOIN y n ON n.zone = s.zone AND n.year = s.year + 1""")
def _(spark, sf):
    # months, climate and harvest come from one table of zone months, a few rows a zone and year, that is written once
    z = cut_lineage(D.zone_months(spark, sf).select("zone", "date", "value"))
    y = z.groupBy("zone", F.year("date").alias("year")).agg(F.sum("value").alias("harvest"))
    months = [(9, 0), (10, 0), (11, 0), (12, 0), (1, 1), (2, 1), (3, 1)]
    s = R.repeat_months(y.select("zone", "year"), "year", months).withColumnRenamed("month_date", "date")
    climate = z.groupBy("date").agg(F.round(F.avg("value"), 6).alias("climate"))
    # the harvest belongs to the season one year earlier: the key moves, not the rows
    nxt = y.select("zone", (F.col("year") - 1).alias("year"), F.col("harvest").alias("next_harvest"))
    out = s.join(climate, "date", "left").join(z, ["zone", "date"], "left").join(nxt, ["zone", "year"], "left")
    return out.select("zone", F.col("year").alias("season_year"), "month", "date",
                      F.when(F.col("month") > 3, F.col("climate")).alias("predictor"), "value", "next_harvest")


@query("x27_forecast_metrics", """
WITH b AS (SELECT zone, date, value AS a, value - p AS e, abs(value - p) AS ae, (value - p) / (value + 1e-10) AS pe, p,
  2 * abs(value - p) / (abs(value) + abs(p) + 1e-10) AS sp, value - lag(value) OVER w AS nd, sign(value - lag(value) OVER w) = sign(p - lag(p) OVER w) AS same,
  avg(value) OVER (PARTITION BY zone) AS am FROM (SELECT zone, date, rain / 1000.0 AS value, value * 1.5 AS p FROM zone_months) WINDOW w AS (PARTITION BY zone ORDER BY date)),
c AS (SELECT *, e / (nd + 1e-10) AS re, ae / (ae + abs(nd) + 1e-10) AS bre, avg(ae) OVER (PARTITION BY zone) AS mae0, avg(abs(pe)) OVER (PARTITION BY zone) AS mape0 FROM b)
SELECT zone, round(avg(e * e), 4) AS mse, round(sqrt(avg(e * e)), 4) AS rmse, round(sqrt(avg(e * e)) / (max(a) - min(a)), 4) AS nrmse, round(avg(e), 4) AS me,
  round(avg(ae), 4) AS mae, round(avg(ae), 4) AS mad, round(exp(avg(ln(ae))), 4) AS gmae, round(quantile_cont(ae, 0.5), 4) AS mdae, round(avg(pe), 4) AS mpe,
  round(avg(abs(pe)), 4) AS mape, round(quantile_cont(abs(pe), 0.5), 4) AS mdape, round(avg(sp), 4) AS smape, round(quantile_cont(sp, 0.5), 4) AS smdape,
  round(avg(atan(abs(pe))), 4) AS maape, round(avg(ae) / avg(abs(nd)), 4) AS mase, round(sqrt(sum(pow(e - mae0, 2)) / (count(*) - 1)), 4) AS std_ae,
  round(sqrt(sum(pow(pe - mape0, 2)) / (count(*) - 1)), 4) AS std_ape, round(sqrt(avg(pe * pe)), 4) AS rmspe, round(sqrt(quantile_cont(pe * pe, 0.5)), 4) AS rmdspe,
  round(sqrt(avg(e * e)) / avg(abs(nd)), 4) AS rmsse, round(sqrt(sum(e * e) / sum(pow(a - am, 2))), 4) AS inrse, round(sqrt(sum(e * e) / sum(pow(a - am, 2))), 4) AS rrse,
  round(avg(re), 4) AS mre, round(sum(ae) / (sum(abs(a - am)) + 1e-10), 4) AS rae, round(avg(abs(re)), 4) AS mrae,
  round(quantile_cont(abs(re), 0.5), 4) AS mdrae, round(exp(avg(ln(abs(re)))), 4) AS gmrae, round(avg(bre), 4) AS mbrae,
  round(avg(bre) / (1 - avg(bre)), 4) AS umbrae, round(avg(CASE WHEN same THEN 1.0 WHEN NOT same THEN 0.0 END), 4) AS mda FROM c GROUP BY zone""")
def _(spark, sf):
    m = D.zone_months(spark, sf).select("zone", "date", (F.col("rain") / 1000.0).alias("actual"),
                                        (F.col("value") * 1.5).alias("forecast"))
    return M.forecast_metrics(m, ["zone"], "actual", "forecast", places=4)


CLASS_SQL = """round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall,
  round(2.0 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1, round(CAST(tp + tn AS DOUBLE) / (tp + fp + tn + fn), 6) AS accuracy"""


@query("x28_classification_metrics", f"""
WITH p AS (SELECT f.zone, date, event, value, CASE WHEN value >= thr THEN 1 ELSE 0 END AS x FROM zone_flagged f JOIN {Q90} t ON f.zone = t.zone),
c AS (SELECT zone, {COUNTS_SQL} FROM p GROUP BY zone),
r AS (SELECT zone, event, rank() OVER (PARTITION BY zone ORDER BY value) + (count(*) OVER (PARTITION BY zone, value) - 1) / 2.0 AS r FROM p),
a AS (SELECT zone, count(*) FILTER (event = 1) AS n_pos, count(*) FILTER (event = 0) AS n_neg, sum(r) FILTER (event = 1) AS rs FROM r GROUP BY zone)
SELECT c.*, {CLASS_SQL}, round((rs - n_pos * (n_pos + 1) / 2.0) / (CAST(n_pos AS DOUBLE) * n_neg), 6) AS auc FROM c JOIN a USING (zone)""")
def _(spark, sf):
    return K.class_scores(K.confusion_with_auc(predicted(spark, sf), ["zone"], "event", "pred", "value"))


@query("x29_weighted_scores", f"""
WITH p AS (SELECT f.zone, event, CASE WHEN value >= thr THEN 1 ELSE 0 END AS x FROM zone_flagged f JOIN {Q90} t ON f.zone = t.zone),
c AS (SELECT zone, {COUNTS_SQL} FROM p GROUP BY zone),
r AS (SELECT *, CAST(tp AS DOUBLE) / (tp + fn) AS hr, CAST(fp AS DOUBLE) / (fp + tn) AS fa FROM c WHERE tp + fn > 0),
k AS (SELECT *, CASE WHEN hr = 0 THEN 0.5 / (tp + fn) WHEN hr = 1 THEN (tp + fn - 0.5) / (tp + fn) ELSE hr END AS h,
  CASE WHEN fa = 0 THEN 0.5 / (fp + tn) WHEN fa = 1 THEN (fp + tn - 0.5) / (fp + tn) ELSE fa END AS f FROM r)
SELECT zone, tp, fp, tn, fn, round(CAST(fp + tn AS DOUBLE) / (tp + fn + fp + tn), 6) AS weight_pos, round(CAST(tp + fn AS DOUBLE) / (tp + fn + fp + tn), 6) AS weight_neg,
  round(CAST(fp + tn AS DOUBLE) / (tp + fn + fp + tn) * (2.0 * tp / (2 * tp + fp + fn)) + CAST(tp + fn AS DOUBLE) / (tp + fn + fp + tn) * (2.0 * tn / (2 * tn + fp + fn)), 6) AS weighted_f,
  round(0.75 * hr + 0.25 * (1 - fa), 6) AS wacc, round((""" + ppf_sql("h") + ") - (" + ppf_sql("f") + "), 6) AS dprime FROM k")
def _(spark, sf):
    counts = K.confusion(predicted(spark, sf), ["zone"], "event", "pred").where("tp + fn > 0")
    return K.weighted_scores(counts)


@query("x30_roc_points", """
WITH s AS (SELECT zone, value AS score, CAST(sum(event) AS BIGINT) AS pos, count(*) - CAST(sum(event) AS BIGINT) AS neg FROM zone_flagged GROUP BY 1, 2),
c AS (SELECT *, CAST(sum(pos) OVER w AS BIGINT) AS tp, CAST(sum(neg) OVER w AS BIGINT) AS fp, sum(pos) OVER g AS p, sum(neg) OVER g AS n FROM s
  WINDOW w AS (PARTITION BY zone ORDER BY score DESC), g AS (PARTITION BY zone))
SELECT zone, score, tp, fp, round(tp / nullif(p, 0), 6) AS tpr, round(fp / nullif(n, 0), 6) AS fpr, round(tp / nullif(tp + fp, 0), 6) AS precision FROM c""")
def _(spark, sf):
    days = D.zone_flagged(spark, sf).withColumnRenamed("value", "score")
    return K.roc_points(days, ["zone"], "event", "score", pieces=1).drop("pos", "neg")


@query("x30b_roc_of_rows", """
WITH s AS (SELECT o_orderstatus AS status, o_totalprice AS score, count(*) FILTER (o_orderpriority = '1-URGENT') AS pos, count(*) FILTER (o_orderpriority <> '1-URGENT') AS neg FROM orders GROUP BY 1, 2),
c AS (SELECT *, CAST(sum(pos) OVER w AS BIGINT) AS tp, CAST(sum(neg) OVER w AS BIGINT) AS fp, sum(pos) OVER g AS p, sum(neg) OVER g AS n FROM s
  WINDOW w AS (PARTITION BY status ORDER BY score DESC), g AS (PARTITION BY status))
SELECT status, score, tp, fp, round(tp / nullif(p, 0), 6) AS tpr, round(fp / nullif(n, 0), 6) AS fpr, round(tp / nullif(tp + fp, 0), 6) AS precision FROM c""")
def _(spark, sf):
    # raw reports: one status holds a third of them
    rows = D.table(spark, sf, "orders").select(
        F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("score"),
        (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("urgent"))
    return K.roc_points(rows, ["status"], "urgent", "score").drop("pos", "neg")


@query("x32_linear_monitor", """
WITH r AS (SELECT zone, date, CASE WHEN count(*) OVER w >= 3 THEN avg(value) OVER w END AS v, CASE WHEN count(*) OVER w >= 3 THEN avg(rain) OVER w END AS r
  FROM zone_months WINDOW w AS (PARTITION BY zone ORDER BY date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
z AS (SELECT zone, date, CASE WHEN stddev_pop(v) OVER g = 0 THEN 0.0 ELSE (v - avg(v) OVER g) / stddev_pop(v) OVER g END AS v,
  CASE WHEN stddev_pop(r) OVER g = 0 THEN 0.0 ELSE (r - avg(r) OVER g) / stddev_pop(r) OVER g END AS r FROM r WHERE v IS NOT NULL WINDOW g AS (PARTITION BY zone, month(date))),
s AS (SELECT zone, CAST(date + INTERVAL 1 MONTH AS DATE) AS date, round(0.1 - 0.8 * v - 0.3 * r, 6) AS score FROM z),
o AS (SELECT zone, CAST(date_trunc('month', date) AS DATE) AS date, max(severity) AS observed FROM impact_reports GROUP BY 1, 2)
SELECT zone, date, score, CASE WHEN score > 0 THEN 1 WHEN score IS NULL THEN -1 ELSE 0 END AS drought_predicted, observed FROM s FULL JOIN o USING (zone, date)""")
def _(spark, sf):
    m = D.zone_months(spark, sf)
    for c in ("value", "rain"):
        m = W.rolling_trailing(m, ["zone"], c, f"{c}_3", 3, "mean")
    m = m.where("value_3 IS NOT NULL").withColumn("month", F.month("date"))
    for c in ("value", "rain"):
        m = N.z_score(m, ["zone", "month"], f"{c}_3", f"{c}_z", sd="population")
    out = L.linear_monitor(m, {"value_z": -0.8, "rain_z": -0.3}, 0.1).select(
        "zone", "date", F.round("score", 6).alias("score"))
    observed = D.events(spark, sf).groupBy("zone", F.trunc("date", "month").alias("date")).agg(F.max("severity").alias("observed"))
    out = out.join(observed, ["zone", "date"], "full_outer")
    return out.withColumn("drought_predicted", F.when(F.col("score") > 0, 1).when(F.col("score").isNull(), -1).otherwise(0))


def forecast_sql(train: int = 48) -> str:
    """The normal equations of every origin by a self join, solved by Gauss-Jordan steps."""
    x = ["1.0", "CAST(w.k - t.k AS DOUBLE)", "sin(pi() * month(w.date) / 6)", "cos(pi() * month(w.date) / 6)",
         "sin(pi() * month(w.date) / 3)", "cos(pi() * month(w.date) / 3)", "w.value"]
    parts = [f"m0 AS (SELECT t.zone, t.date, t.value, " + ", ".join(
        f"sum({x[i]} * {x[j]}) AS a{i}{j}" for i in range(6) for j in range(7)) +
        f" FROM s t JOIN s w ON w.zone = t.zone AND w.k BETWEEN t.k - {train} AND t.k - 1 WHERE t.k > {train} GROUP BY 1, 2, 3)"]
    for p in range(6):
        parts.append(f"m{p + 1} AS (SELECT zone, date, value, " + ", ".join(
            f"a{p}{j} / a{p}{p} AS a{p}{j}" if i == p else f"a{i}{j} - a{i}{p} * a{p}{j} / a{p}{p} AS a{i}{j}"
            for i in range(6) for j in range(7)) + f" FROM m{p})")
    told = x[2:6]
    return ("WITH s AS (SELECT zone, date, value, row_number() OVER (PARTITION BY zone ORDER BY date) AS k FROM zone_months), " + ", ".join(parts)
            + " SELECT zone, date, value AS actual, round(a06 + " + " + ".join(f"a{i + 2}6 * {c}" for i, c in enumerate(told)) + ", 2) AS forecast FROM m6 w")


@query("x38_seasonal_forecast", forecast_sql())
def _(spark, sf):
    return L.seasonal_forecast(D.zone_months(spark, sf), ["zone"], "value", 48).withColumn("forecast", F.round("forecast", 2))


@query("x39_leave_one_out_cue", """
WITH ev AS (SELECT DISTINCT zone, CAST(date_trunc('month', date) AS DATE) AS date FROM impact_reports WHERE severity > 300000),
m AS (SELECT z.zone, z.date, z.value, round(z.rain / 1000, 0) AS rain, CASE WHEN ev.zone IS NULL THEN 0 ELSE 1 END AS y FROM zone_months z LEFT JOIN ev USING (zone, date)),
l AS (SELECT zone, date, y, 'value' AS cue, value AS v FROM m UNION ALL SELECT zone, date, y, 'rain', rain FROM m),
cuts AS (SELECT DISTINCT zone, cue, v AS cut FROM l),
f AS (SELECT h.zone, h.date, h.y, h.cue, h.v, c.cut,
  count(*) FILTER (t.y = 1 AND t.v <= c.cut) AS tp, count(*) FILTER (t.y = 1) AS p, count(*) FILTER (t.y = 0 AND t.v > c.cut) AS tn, count(*) FILTER (t.y = 0) AS n
  FROM l h JOIN cuts c ON h.zone = c.zone AND h.cue = c.cue JOIN l t ON t.zone = h.zone AND t.cue = h.cue AND t.date <> h.date GROUP BY 1, 2, 3, 4, 5, 6),
b AS (SELECT *, row_number() OVER (PARTITION BY zone, date ORDER BY 0.75 * coalesce(CAST(tp AS DOUBLE) / nullif(p, 0), 0.0) + 0.25 * coalesce(CAST(tn AS DOUBLE) / nullif(n, 0), 0.0) DESC, cue, cut) AS rn FROM f),
o AS (SELECT zone, y AS event, CASE WHEN v <= cut THEN 1 ELSE 0 END AS x FROM b WHERE rn = 1),
c AS (SELECT zone, """ + COUNTS_SQL + """ FROM o GROUP BY zone)
SELECT *, round(fp / nullif(fp + tn, 0), 6) AS far, round(fn / nullif(tp + fn, 0), 6) AS ms, round(tn / nullif(fp + tn, 0), 6) AS cr, round(tp / nullif(tp + fn, 0), 6) AS hr,
  round(tn / nullif(tn + fn, 0), 6) AS npv, round(tp / nullif(tp + fp, 0), 6) AS ppv, round(0.75 * tp / nullif(tp + fn, 0) + 0.25 * tn / nullif(fp + tn, 0), 6) AS wacc FROM c""")
def _(spark, sf):
    ev = D.events(spark, sf).where("severity > 300000").select("zone", F.trunc("date", "month").alias("date"))
    m = T.attach_flag(D.zone_months(spark, sf), ev, ["zone"], "y")
    m = m.withColumn("rain", F.round(F.col("rain") / 1000, 0))
    long = m.unpivot(["zone", "date", "y"], ["value", "rain"], "cue", "v")
    return K.leave_one_out_cue(long, ["zone"], "date", "cue", "v", "y")


#: Cues that are known a lead time before the month they speak of.
FRUGAL_CUES = ["value_then", "rain_then", "mean3", "trend", "year_before", "season"]


@query("x39b_frugal_trees", """
WITH s AS (SELECT zone, date, value, round(rain / 1000, 0) AS rain, row_number() OVER (PARTITION BY zone ORDER BY date) AS k FROM zone_months),
r AS (SELECT t.zone, g.lead, p.percent, t.date, t.value AS target, a.value AS value_then, a.rain AS rain_then, (a.value + b.value + c.value) / 3 AS mean3,
  a.value - b.value AS trend, d.value AS year_before, CAST(month(t.date) AS DOUBLE) AS season
  FROM s t CROSS JOIN (VALUES (1), (2), (3)) g(lead) CROSS JOIN (VALUES (20), (40), (50)) p(percent)
  LEFT JOIN s a ON a.zone = t.zone AND a.k = t.k - g.lead LEFT JOIN s b ON b.zone = t.zone AND b.k = t.k - g.lead - 1
  LEFT JOIN s c ON c.zone = t.zone AND c.k = t.k - g.lead - 2 LEFT JOIN s d ON d.zone = t.zone AND d.k = t.k - 12),
q AS (SELECT zone, lead, unnest([20, 40, 50]) AS percent, unnest(quantile_cont(target, [0.2, 0.4, 0.5])) AS level FROM (SELECT DISTINCT zone, lead, date, target FROM r) GROUP BY 1, 2),
x AS (SELECT r.*, CASE WHEN target <= level THEN 1 ELSE 0 END AS y FROM r JOIN q USING (zone, lead, percent)),
l AS (SELECT zone, lead, percent, y, cue, cut FROM x UNPIVOT (cut FOR cue IN (value_then, rain_then, mean3, trend, year_before, season))),
n AS (SELECT zone, lead, percent, count(*) FILTER (y = 1) AS p, count(*) FILTER (y = 0) AS n FROM x GROUP BY 1, 2, 3),
f AS (SELECT c.zone, c.lead, c.percent, c.cue, c.cut, dir, any_value(n.p) AS p, any_value(n.n) AS n,
  count(*) FILTER (l.y = 1 AND CASE dir WHEN 0 THEN l.cut <= c.cut ELSE l.cut > c.cut END) AS tp,
  count(*) FILTER (l.y = 0 AND CASE dir WHEN 0 THEN l.cut <= c.cut ELSE l.cut > c.cut END) AS fp
  FROM (SELECT DISTINCT zone, lead, percent, cue, cut FROM l) c CROSS JOIN (VALUES (0), (1)) d(dir)
  JOIN l USING (zone, lead, percent, cue) JOIN n USING (zone, lead, percent) GROUP BY 1, 2, 3, 4, 5, 6),
w AS (SELECT *, 0.75::DOUBLE * coalesce(tp::DOUBLE / nullif(p, 0), 0.0) + 0.25::DOUBLE * coalesce((n - fp)::DOUBLE / nullif(n, 0), 0.0) AS score FROM f),
b AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY zone, lead, percent, cue ORDER BY score DESC, dir, cut) = 1),
k AS (SELECT *, row_number() OVER (PARTITION BY zone, lead, percent ORDER BY score DESC, cue) - 1 AS place FROM b QUALIFY place < 5),
v AS (SELECT zone, lead, percent, date, y, cue, val FROM x UNPIVOT INCLUDE NULLS (val FOR cue IN (value_then, rain_then, mean3, trend, year_before, season))),
h AS (SELECT zone, lead, percent, date, any_value(y) AS y, count(*) AS cues,
  sum(CASE WHEN CASE dir WHEN 0 THEN val <= cut ELSE val > cut END THEN 1 << place ELSE 0 END)::INT AS bits
  FROM v JOIN k USING (zone, lead, percent, cue) GROUP BY 1, 2, 3, 4),
t AS (SELECT m, e, b AS bits, CASE WHEN m > 1 AND b & 1 = e & 1 THEN b & 1 WHEN m > 2 AND (b >> 1) & 1 = (e >> 1) & 1 THEN (b >> 1) & 1
  WHEN m > 3 AND (b >> 2) & 1 = (e >> 2) & 1 THEN (b >> 2) & 1 WHEN m > 4 AND (b >> 3) & 1 = (e >> 3) & 1 THEN (b >> 3) & 1 ELSE (b >> (m - 1)) & 1 END AS pred
  FROM (SELECT unnest(range(1, 6))::INT AS m) CROSS JOIN (SELECT unnest(range(0, 16))::INT AS e) CROSS JOIN (SELECT unnest(range(0, 32))::INT AS b) WHERE e < 1 << (m - 1)),
z AS MATERIALIZED (SELECT h.*, t.m, t.e, t.pred FROM h JOIN t ON t.bits = h.bits AND t.m <= h.cues),
o AS (SELECT a.zone, a.lead, a.percent, a.date, a.m, a.e, any_value(a.y) AS y, any_value(a.pred) AS pred,
  0.75::DOUBLE * coalesce((count(*) FILTER (b.y = 1 AND b.pred = 1))::DOUBLE / nullif(count(*) FILTER (b.y = 1), 0), 0.0)
  + 0.25::DOUBLE * coalesce((count(*) FILTER (b.y = 0 AND b.pred = 0))::DOUBLE / nullif(count(*) FILTER (b.y = 0), 0), 0.0) AS score
  FROM z a JOIN z b ON b.zone = a.zone AND b.lead = a.lead AND b.percent = a.percent AND b.m = a.m AND b.e = a.e
  WHERE b.date <> a.date GROUP BY 1, 2, 3, 4, 5, 6),
c AS (SELECT zone, lead, percent, levels, y AS event, pred AS x FROM o CROSS JOIN (SELECT unnest(range(1, 6)) AS levels) WHERE m <= levels
  QUALIFY row_number() OVER (PARTITION BY zone, lead, percent, date, levels ORDER BY score DESC, m, e) = 1),
s2 AS (SELECT zone, lead, percent, levels, """ + COUNTS_SQL + """ FROM c GROUP BY 1, 2, 3, 4)
SELECT zone, CAST(lead AS BIGINT) AS lead, CAST(percent AS BIGINT) AS percent, levels, tp, fp, tn, fn, round(fp / nullif(fp + tn, 0), 6) AS far, round(fn / nullif(tp + fn, 0), 6) AS ms,
  round(tn / nullif(fp + tn, 0), 6) AS cr, round(tp / nullif(tp + fn, 0), 6) AS hr, round(tn / nullif(tn + fn, 0), 6) AS npv, round(tp / nullif(tp + fp, 0), 6) AS ppv,
  round(0.75 * tp / nullif(tp + fn, 0) + 0.25 * tn / nullif(fp + tn, 0), 6) AS wacc FROM s2""")
def _(spark, sf):
    m = D.zone_months(spark, sf).withColumn("rain", F.round(F.col("rain") / 1000, 0))
    w = along(["zone"], "date")

    def known(lead: int):
        then, before = F.lag("value", lead).over(w), F.lag("value", lead + 1).over(w)
        return F.struct(
            F.lit(lead).alias("lead"), then.alias("value_then"), F.lag("rain", lead).over(w).alias("rain_then"),
            ((then + before + F.lag("value", lead + 2).over(w)) / 3).alias("mean3"), (then - before).alias("trend"))

    rows = m.withColumns({"k": F.array(*[known(lead) for lead in (1, 2, 3)]), "year_before": F.lag("value", 12).over(w),
                          "season": F.month("date").cast("double")})
    rows = rows.withColumn("k", F.explode("k")).select("zone", "k.*", F.col("value").alias("target"), "year_before", "season")
    labelled = frugal.below_quantiles(rows, ["zone", "lead"], "target", [20, 40, 50], "y")
    return frugal.frugal_trees(labelled, ["zone", "lead", "percent"], FRUGAL_CUES, "y")


@query("x40_median_difference", """
WITH ev AS (SELECT DISTINCT zone, CAST(date_trunc('month', date) AS DATE) AS date FROM impact_reports),
m AS (SELECT z.*, CASE WHEN ev.zone IS NULL THEN 0 ELSE 1 END AS y FROM zone_months z LEFT JOIN ev USING (zone, date)),
l AS (SELECT y, 'value' AS feature, value AS v FROM m UNION ALL SELECT y, 'rain', rain FROM m),
d AS (SELECT feature, quantile_cont(v, 0.5) FILTER (y = 1) AS m1, quantile_cont(v, 0.5) FILTER (y = 0) AS m0 FROM l GROUP BY 1)
SELECT feature, round(m1, 4) AS median_event, round(m0, 4) AS median_other, round(m1 - m0, 4) AS difference,
  rank() OVER (ORDER BY abs(m1 - m0) DESC) AS position FROM d""")
def _(spark, sf):
    m = T.attach_flag(D.zone_months(spark, sf), D.events(spark, sf).select("zone", F.trunc("date", "month").alias("date")), ["zone"], "y")
    long = m.unpivot(["y"], ["value", "rain"], "feature", "v")
    med = Q.quantiles_of_rows(long, ["feature", "y"], "v", [50], decimals=9)
    d = med.groupBy("feature").agg(F.max(F.when(F.col("y") == 1, F.col("threshold"))).alias("m1"),
                                   F.max(F.when(F.col("y") == 0, F.col("threshold"))).alias("m0"))
    diff = F.col("m1") - F.col("m0")
    # a handful of features: the rank runs over one row per feature
    pos = F.rank().over(along([F.lit(1)], [F.desc(F.abs(diff))]))
    return d.select("feature", F.round("m1", 4).alias("median_event"), F.round("m0", 4).alias("median_other"),
                    F.round(diff, 4).alias("difference"), pos.alias("position"))


@query("x41_period_correlation", """
WITH y AS (SELECT zone, year(date) AS year, sum(value) AS harvest FROM zone_days GROUP BY 1, 2),
c AS (SELECT m.zone, month(m.date) AS period, corr(m.rain, y.harvest) AS r, count(*) AS n FROM zone_months m
  JOIN y ON m.zone = y.zone AND year(m.date) = y.year GROUP BY 1, 2)
SELECT period, round(avg(r), 6) AS mean_r, round(max(r), 6) AS max_r, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY period""")
def _(spark, sf):
    y = D.zone_days(spark, sf).groupBy("zone", F.year("date").alias("year")).agg(F.sum("value").alias("harvest"))
    m = D.zone_months(spark, sf).withColumn("year", F.year("date")).join(y, ["zone", "year"])
    c = m.groupBy("zone", F.month("date").alias("period")).agg(F.corr("rain", "harvest").alias("r"), F.count("*").alias("n"))
    return c.groupBy("period").agg(F.round(F.avg("r"), 6).alias("mean_r"), F.round(F.max("r"), 6).alias("max_r"), F.sum("n").alias("n"))


@query("x42_horizon_comparison", """
WITH f AS (SELECT zone, date, k AS loop_num, lag(value, CAST(k AS INTEGER)) OVER (PARTITION BY zone, k ORDER BY date) + k AS forecast FROM zone_months, (VALUES (1), (2), (3)) x(k)),
g AS (SELECT zone, date, arg_min(forecast, loop_num) AS first_fc, arg_max(forecast, loop_num) AS last_fc FROM f WHERE forecast IS NOT NULL GROUP BY 1, 2)
SELECT zone, date, first_fc, last_fc, value AS observed FROM g JOIN zone_months USING (zone, date)""")
def _(spark, sf):
    m = D.zone_months(spark, sf)
    w = along(["zone"], "date")
    loops = F.array(*[F.struct(F.lit(k).alias("loop_num"), (F.lag("value", k).over(w) + k).alias("forecast")) for k in (1, 2, 3)])
    f = m.withColumn("_l", loops).select("zone", "date", F.col("value").alias("observed"), F.inline("_l")).where("forecast IS NOT NULL")
    return f.groupBy("zone", "date").agg(F.min_by("forecast", "loop_num").alias("first_fc"), F.max_by("forecast", "loop_num").alias("last_fc"),
                                         F.any_value("observed").alias("observed"))


@query("x43_masked_matrix", "SELECT zone, year(date) AS year, " + ", ".join(
    f"max(CASE WHEN month(date) = {m} AND value <= 1150 THEN value END) AS m{m}" for m in range(1, 13)) + " FROM zone_months GROUP BY 1, 2")
def _(spark, sf):
    m = D.zone_months(spark, sf).select("zone", F.year("date").alias("year"), F.month("date").alias("month"),
                                        F.when(F.col("value") <= 1150, F.col("value")).alias("v"))
    wide = R.to_wide(m, ["zone", "year"], "month", list(range(1, 13)), F.max("v"))
    return wide.select("zone", "year", *[F.col(str(i)).alias(f"m{i}") for i in range(1, 13)])


@query("x44_population_levels", """
WITH c AS (SELECT iy, ix, sum(s_acctbal) AS pop FROM station_places JOIN supplier ON station = s_suppkey GROUP BY 1, 2),
z AS (SELECT zone, sum(pop) AS pop FROM c JOIN cell_zone USING (iy, ix) GROUP BY zone)
SELECT 'zone' AS level, zone AS id, round(pop, 0) AS population FROM z
UNION ALL SELECT 'region', CAST(n_regionkey AS BIGINT), round(sum(pop), 0) FROM z JOIN nation ON zone = n_nationkey GROUP BY 2
UNION ALL SELECT 'all', 0, round(sum(pop), 0) FROM z""")
def _(spark, sf):
    pop = D.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("station"), "s_acctbal")
    c = D.station_places(spark, sf).join(pop, "station").groupBy("iy", "ix").agg(F.sum("s_acctbal").alias("pop"))
    z = G.zonal_stats(c, D.cell_zone(spark, sf), ["iy", "ix"], ["zone"], "pop").select("zone", F.col("sum").alias("pop"))
    region = D.table(spark, sf, "nation").select(F.col("n_nationkey").cast("bigint").alias("zone"), F.col("n_regionkey").cast("bigint").alias("region"))
    parts = [z.select(F.lit("zone").alias("level"), F.col("zone").alias("id"), F.round("pop", 0).alias("population")),
             z.join(region, "zone").groupBy(F.lit("region").alias("level"), F.col("region").alias("id")).agg(F.round(F.sum("pop"), 0).alias("population")),
             z.groupBy(F.lit("all").alias("level"), F.lit(0).cast("bigint").alias("id")).agg(F.round(F.sum("pop"), 0).alias("population"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("x45_best_score_view", sweep_sql("year(date)", [50, 80, 90]) + """,
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY zone, percent ORDER BY far NULLS LAST, station) AS rn FROM k) WHERE rn = 1)
SELECT CAST(n_nationkey AS BIGINT) AS zone, n_name AS name, percent, station, pod, far, csi FROM b RIGHT JOIN nation ON b.zone = n_nationkey""")
def _(spark, sf):
    scores = maxima_sweep(spark, sf, F.year("date"), [50, 80, 90])
    best = X.best_row(scores, ["zone", "percent"], F.col("far"), F.col("station"))
    shapes = D.table(spark, sf, "nation").select(F.col("n_nationkey").cast("bigint").alias("zone"), F.col("n_name").alias("name"))
    return best.join(shapes, "zone", "right").select("zone", "name", "percent", "station", "pod", "far", "csi")


@query("x00_best_warning", TABLE_SQL + """
SELECT zone, station, lead, percent, floods, floods_correct, floods_incorrect, protocol_triggered, triggered_in_vain, detection_ratio, false_alarm_ratio
FROM (SELECT *, row_number() OVER (PARTITION BY zone ORDER BY 0.5 * false_alarm_ratio + 0.5 * (1 - detection_ratio) NULLS LAST, lead DESC, station, percent) AS rn
  FROM tt WHERE detection_ratio > 0) WHERE rn = 1""")
def best_warning(spark, sf):
    """Which station, lead time and threshold warns each zone best?"""
    return P.best_warnings(best_triggers(spark, sf))


@query("x46_indicator_refresh", """
WITH z AS (SELECT zone, date, avg(value) AS value FROM cell_days JOIN cell_zone USING (iy, ix) GROUP BY 1, 2)
SELECT zone, date, round(CASE WHEN stddev_pop(value) OVER w = 0 THEN 0.0 ELSE (value - avg(value) OVER w) / stddev_pop(value) OVER w END, 6) AS normal
FROM z WINDOW w AS (PARTITION BY zone, month(date))""")
def _(spark, sf):
    days, bridge = D.cell_days(spark, sf), D.cell_zone(spark, sf)
    table = work_path(spark, "indicator-store")
    # two refreshes that overlap by a year
    P.refresh_indicator(days.where("date < DATE '1999-01-01'"), bridge, table, "flow")
    P.refresh_indicator(days.where("date >= DATE '1998-01-01'"), bridge, table, "flow")
    out = P.standardised_indicator(spark.read.parquet(table))
    return out.select("zone", "date", F.round("normal", 6).alias("normal"))
