"""Aggregation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import impacts as I
from ..operators import indices as N
from ..operators import quantiles as Q
from ..operators import reshape as R
from ..operators import skill as K
from ..operators import spatial as G
from ..operators import triggers as T
from ..session import cut_lineage
from . import domain as D
from .q_scalars import ppf_sql
from .registry import query


@query("a01_group_aggregates", """
SELECT zone, sum(value) AS total, round(avg(value), 6) AS mean, min(value) AS low, max(value) AS high,
  count(*) AS days, arg_min(value, date) AS first_value FROM zone_days GROUP BY zone""")
def _(spark, sf):
    return D.zone_days(spark, sf).groupBy("zone").agg(
        F.sum("value").alias("total"), F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("low"),
        F.max("value").alias("high"), F.count("*").alias("days"), F.min_by("value", "date").alias("first_value"))


@query("a02_grouping_sets", """
SELECT coalesce(r_name, '-') AS region, coalesce(n_name, '-') AS zone, coalesce(c_mktsegment, '-') AS segment,
  round(sum(severity), 2) AS affected FROM all_reports JOIN orders ON report = o_orderkey
JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey GROUP BY GROUPING SETS ((r_name), (n_name), (c_mktsegment))""")
def _(spark, sf):
    cust = D.table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    orders = D.table(spark, sf, "orders").select(F.col("o_orderkey").alias("report"), "o_custkey")
    nation = D.table(spark, sf, "nation").select(F.col("n_nationkey").cast("bigint").alias("zone"), "n_name",
                                                 F.col("n_regionkey").alias("r_regionkey"))
    base = (D.reports(spark, sf).join(orders, "report").join(cust, F.col("o_custkey") == F.col("c_custkey"))
            .join(nation, "zone").join(D.table(spark, sf, "region"), "r_regionkey"))
    sets = [[F.col("r_name")], [F.col("n_name")], [F.col("c_mktsegment")]]
    out = base.groupingSets(sets, "r_name", "n_name", "c_mktsegment").agg(F.round(F.sum("severity"), 2).alias("affected"))
    return out.select(F.coalesce("r_name", F.lit("-")).alias("region"), F.coalesce("n_name", F.lit("-")).alias("zone"),
                      F.coalesce("c_mktsegment", F.lit("-")).alias("segment"), "affected")


@query("a03_event_counts", """
SELECT zone, count(*) AS reports, count(DISTINCT date) AS event_days FROM all_reports GROUP BY zone ORDER BY reports DESC, zone""")
def _(spark, sf):
    daily = D.reports(spark, sf).groupBy("zone", "date").agg(F.count("*").alias("n"))
    return daily.groupBy("zone").agg(F.sum("n").alias("reports"), F.count("*").alias("event_days")).orderBy(
        F.desc("reports"), "zone")


@query("a04_monthly_rain", """
SELECT zone, date, rain, round(sum(rain) OVER (PARTITION BY zone, season_year ORDER BY date), 2) AS rain_cum FROM (
  SELECT *, year(date) + CASE WHEN month(date) >= 9 THEN 1 ELSE 0 END AS season_year
  FROM zone_months WHERE month(date) IN (9, 10, 11, 12, 1, 2, 3))""")
def _(spark, sf):
    from ..operators.windows import past
    m = D.zone_months(spark, sf).where(F.month("date").isin(9, 10, 11, 12, 1, 2, 3))
    m = m.withColumn("season_year", S.crop_year(F.col("date"), 9))
    return m.select("zone", "date", "rain",
                    F.round(F.sum("rain").over(past(["zone", "season_year"], "date")), 2).alias("rain_cum"))


@query("a05_season_aggregates", """
SELECT m.zone, m.year, m.season, round(avg(m.value), 6) AS value_mean, min(m.value) AS value_min,
  round(sum(m.rain), 2) AS rain_sum, max(CASE WHEN e.zone IS NULL THEN 0 ELSE 1 END) AS any_event FROM (
  SELECT *, year(date) AS year, CASE WHEN month(date) IN (3,4,5) THEN 1 WHEN month(date) IN (7,8,9) THEN 2
    ELSE 3 END AS season FROM zone_months) m
LEFT JOIN (SELECT DISTINCT zone, CAST(date_trunc('month', date) AS DATE) AS date FROM impact_reports) e USING (zone, date)
GROUP BY 1, 2, 3""")
def _(spark, sf):
    ev = D.event_days(spark, sf).select("zone", F.trunc("date", "month").alias("date"))
    m = I.label_months(D.zone_months(spark, sf), {"reported": ev})
    return m.groupBy("zone", F.year("date").alias("year"), S.season_code(F.col("date")).alias("season")).agg(
        F.round(F.avg("value"), 6).alias("value_mean"), F.min("value").alias("value_min"),
        F.round(F.sum("rain"), 2).alias("rain_sum"), F.max("reported").alias("any_event"))


@query("a06_block_maxima", """
SELECT station, 'half' AS kind, year(date) * 2 + CASE WHEN month(date) > 6 THEN 1 ELSE 0 END AS block,
  max(value) AS block_max FROM station_days GROUP BY 1, 2, 3
UNION ALL SELECT station, 'year', year(date), max(value) FROM station_days GROUP BY 1, 2, 3""")
def _(spark, sf):
    half = Q.block_maxima(D.station_days(spark, sf), ["station"], "value", S.half_year(F.col("date")))
    year = half.groupBy("station", F.floor(F.col("block") / 2).alias("block")).agg(
        F.max("block_max").alias("block_max"))
    return half.withColumn("kind", F.lit("half")).unionByName(year.withColumn("kind", F.lit("year")))


PERCENTS = [5, 10, 20, 30, 50, 75, 80, 85, 90, 95]
_QC = ", ".join(str(p) for p in PERCENTS)


@query("a07_quantiles", f"""
SELECT station, p AS percent, round(quantile_cont(value, p / 100.0), 6) AS threshold
FROM station_days, (SELECT unnest([{_QC}]) AS p) GROUP BY station, p""".replace(
    "quantile_cont(value, p / 100.0)", "list_extract(quantile_cont(value, [" + ", ".join(
        str(p / 100) for p in PERCENTS) + "]), CAST(list_position([" + _QC + "], p) AS INTEGER))"))
def _(spark, sf):
    return Q.thresholds(D.station_days(spark, sf), ["station"], "value", PERCENTS)


@query("a07b_quantiles_of_rows", """
SELECT l_returnflag AS code, unnest([50, 90, 95, 99]) AS percent,
  round(unnest(quantile_cont(l_extendedprice, [0.5, 0.9, 0.95, 0.99])), 6) AS threshold
FROM lineitem GROUP BY l_returnflag""")
def _(spark, sf):
    li = D.table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("code"), "l_extendedprice")
    return Q.quantiles_of_rows(li, ["code"], "l_extendedprice", [50, 90, 95, 99])


@query("a08_ensemble_median", """
SELECT vec_id, label, round(median(CAST(m AS DOUBLE)), 6) AS median FROM (
  SELECT vec_id, label, unnest(embedding) AS m FROM embeddings) GROUP BY 1, 2""")
def _(spark, sf):
    return D.table(spark, sf, "embeddings").select(
        "vec_id", "label", F.round(S.array_median(F.col("embedding").cast("array<double>")), 6).alias("median"))


@query("a09_members_over", """
SELECT vec_id, round(avg(CAST(m AS DOUBLE)), 6) AS mean,
  round(100.0 * sum(CASE WHEN m > 0.1 THEN 1 ELSE 0 END) / count(*), 6) AS pct_over FROM (
  SELECT vec_id, unnest(embedding) AS m FROM embeddings) GROUP BY 1""")
def _(spark, sf):
    e = F.col("embedding").cast("array<double>")
    return D.table(spark, sf, "embeddings").select(
        "vec_id", F.round(S.array_mean(e), 6).alias("mean"),
        F.round(S.members_over(F.col("embedding"), F.lit(0.1).cast("float")), 6).alias("pct_over"))


@query("a10_best_row", """
SELECT zone, station, percent, threshold FROM (SELECT s.zone, t.*, row_number() OVER (PARTITION BY s.zone
  ORDER BY threshold DESC, t.station) AS rn FROM (SELECT station, 95 AS percent,
  round(quantile_cont(value, 0.95), 6) AS threshold FROM station_days GROUP BY station) t
  JOIN station_places s USING (station)) WHERE rn = 1""")
def _(spark, sf):
    t = Q.thresholds(D.station_days(spark, sf), ["station"], "value", [95]).join(D.mapping(spark, sf), "station")
    return T.best_row(t, ["zone"], -F.col("threshold"), F.col("station"))


@query("a11_group_z_score", """
SELECT zone, date, round((value - avg(value) OVER w) / stddev_samp(value) OVER w, 6) AS z FROM zone_months
WINDOW w AS (PARTITION BY zone)""")
def _(spark, sf):
    return N.z_score(D.zone_months(spark, sf), ["zone"], "value", "z").select(
        "zone", "date", F.round("z", 6).alias("z"))


Q90 = "(SELECT zone, round(quantile_cont(value, 0.9), 6) AS thr FROM zone_filled GROUP BY zone)"


def predicted(spark, sf, percent: int = 90):
    """Flagged zone series with the exceedance of its own quantile."""
    days = Q.with_levels(D.zone_flagged(spark, sf), ["zone"], "value", [percent])
    return days.withColumn("pred", T.exceedance(F.col("value"), F.col("levels")[0]))


@query("a12_confusion_counts", f"""
SELECT f.zone, count(*) FILTER (event = 1 AND value >= thr) AS tp, count(*) FILTER (event = 0 AND value >= thr) AS fp,
  count(*) FILTER (event = 0 AND value < thr) AS tn, count(*) FILTER (event = 1 AND value < thr) AS fn
FROM zone_flagged f JOIN {Q90} t ON f.zone = t.zone GROUP BY f.zone""")
def _(spark, sf):
    return K.confusion(predicted(spark, sf), ["zone"], "event", "pred")


@query("a13_rollup_counts", f"""
WITH c AS (SELECT f.zone, count(*) FILTER (event = 1 AND value >= thr) AS tp, count(*) FILTER (event = 0 AND value >= thr) AS fp,
  count(*) FILTER (event = 0 AND value < thr) AS tn, count(*) FILTER (event = 1 AND value < thr) AS fn
  FROM zone_flagged f JOIN {Q90} t ON f.zone = t.zone GROUP BY f.zone),
r AS (SELECT CAST(n_regionkey AS BIGINT) AS region, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp,
  CAST(sum(tn) AS BIGINT) AS tn, CAST(sum(fn) AS BIGINT) AS fn FROM c JOIN nation ON zone = n_nationkey GROUP BY 1)
SELECT *, round(tp / nullif(tp + fn, 0), 6) AS pod, round(fp / nullif(tp + fp, 0), 6) AS far,
  round(fp / nullif(fp + tn, 0), 6) AS pofd, round(tp / nullif(tp + fp + fn, 0), 6) AS csi FROM r""")
def _(spark, sf):
    counts = K.confusion(predicted(spark, sf), ["zone"], "event", "pred")
    region = D.table(spark, sf, "nation").select(F.col("n_nationkey").cast("bigint").alias("zone"),
                                                 F.col("n_regionkey").alias("region"))
    sums = counts.join(region, "zone").groupBy("region").agg(
        *[F.sum(c).alias(c) for c in ("tp", "fp", "tn", "fn")])
    return K.skill_ratios(sums)


@query("a14_correlation", """
SELECT zone, 'value' AS a, 'rain' AS b, round(corr(value, rain), 6) AS r FROM zone_months GROUP BY zone
UNION ALL SELECT zone, 'value', 'month', round(corr(value, month(date)), 6) FROM zone_months GROUP BY zone
UNION ALL SELECT zone, 'rain', 'month', round(corr(rain, month(date)), 6) FROM zone_months GROUP BY zone
UNION ALL SELECT zone, n, n, 1.0 FROM (SELECT DISTINCT zone FROM zone_months), (VALUES ('value'), ('rain'), ('month')) v(n)""".replace("n, n, 1.0", "n, n, CAST(1 AS DOUBLE)"))
def _(spark, sf):
    m = D.zone_months(spark, sf).withColumn("month", F.month("date").cast("double"))
    return R.correlation_matrix(m, ["zone"], ["value", "rain", "month"]).withColumn("r", F.round("r", 6))


@query("a15_first_per_key", """
SELECT zone, date, severity FROM (SELECT *, row_number() OVER (PARTITION BY zone, date
  ORDER BY severity DESC, report) AS rn FROM all_reports) WHERE rn = 1""")
def _(spark, sf):
    return T.best_row(D.reports(spark, sf), ["zone", "date"], -F.col("severity"), F.col("report")).select(
        "zone", "date", "severity")


@query("a16_both_classes", """
SELECT zone FROM zone_flagged GROUP BY zone HAVING count(DISTINCT event) >= 2""")
def _(spark, sf):
    g = D.zone_flagged(spark, sf).groupBy("zone").agg(F.min("event").alias("a"), F.max("event").alias("b"))
    return g.where("a <> b").select("zone")


@query("a17_zonal_stats", """
SELECT zone, date, round(avg(value), 6) AS mean, max(value) AS max, sum(value) AS sum,
  round(quantile_cont(value, 0.95), 6) AS q95, count(*) AS cells FROM cell_days JOIN cell_zone USING (iy, ix)
WHERE value BETWEEN 0 AND 100 GROUP BY 1, 2""")
def _(spark, sf):
    out = G.zonal_stats(D.cell_days(spark, sf), D.cell_zone(spark, sf), ["iy", "ix"], ["zone", "date"],
                        "value", 0.0, 100.0)
    return out.withColumns({"mean": F.round("mean", 6), "q95": F.round("q95", 6)})


@query("a18_masked_zonal_mean", """
SELECT zone, CAST(date_trunc('month', date) AS DATE) AS date, round(avg(value), 6) AS mean
FROM cell_days JOIN cell_zone USING (iy, ix) WHERE (iy * 31 + ix * 17) % 10 / 10.0 > 0.2 GROUP BY 1, 2""")
def _(spark, sf):
    # crop share of the cell is a property of the place: mask the bridge, not the observations
    share = ((F.col("iy") * 31 + F.col("ix") * 17) % 10) / 10.0
    masked = D.cell_zone(spark, sf).where(share > 0.2)
    days = D.cell_days(spark, sf).withColumn("date", F.trunc("date", "month"))
    return (days.join(masked, ["iy", "ix"]).groupBy("zone", "date").agg(F.round(F.avg("value"), 6).alias("mean")))


@query("a19_climatology", """
SELECT zone, date, round(value - c, 6) AS anomaly, round((value - c) / s, 6) AS anomaly_scaled FROM (
  SELECT *, avg(value) OVER w AS c, stddev_samp(value) OVER w AS s FROM zone_months
  WINDOW w AS (PARTITION BY zone, month(date)))""")
def _(spark, sf):
    out = N.climatology_anomaly(D.zone_months(spark, sf), ["zone"], "value", F.month("date"))
    return out.select("zone", "date", F.round("anomaly", 6).alias("anomaly"),
                      F.round("anomaly_scaled", 6).alias("anomaly_scaled"))


@query("a20_max_composite", """
SELECT iy, ix, max(value) AS peak FROM cell_days WHERE date BETWEEN DATE '1998-01-01' AND DATE '1998-06-30'
GROUP BY 1, 2 HAVING max(value) > 40""")
def _(spark, sf):
    days = D.cell_days(spark, sf).where("date BETWEEN DATE '1998-01-01' AND DATE '1998-06-30'")
    return days.groupBy("iy", "ix").agg(F.max("value").alias("peak")).where("peak > 40")


@query("a21_exposed_population", """
WITH phase AS (SELECT zone, phase FROM (SELECT zone, iy % 5 + 1 AS phase, row_number() OVER (PARTITION BY zone
    ORDER BY count(*) DESC, iy % 5) AS rn FROM cell_zone GROUP BY zone, iy % 5) WHERE rn = 1),
pop AS (SELECT CAST(c_nationkey AS BIGINT) AS zone, round(sum(c_acctbal), 2) AS people FROM customer GROUP BY 1)
SELECT phase, count(*) AS zones, round(sum(people), 2) AS people FROM phase JOIN pop USING (zone)
WHERE phase > 2 GROUP BY phase""")
def _(spark, sf):
    classes = D.cells(spark, sf).select("iy", "ix", (F.col("iy") % 5 + 1).alias("phase"))
    phase = G.largest_overlap(D.cell_zone(spark, sf), classes, "zone", "phase", ["iy", "ix"])
    pop = D.table(spark, sf, "customer").groupBy(F.col("c_nationkey").cast("bigint").alias("zone")).agg(
        F.round(F.sum("c_acctbal"), 2).alias("people"))
    return phase.where("phase > 2").join(pop, "zone").groupBy("phase").agg(
        F.count("*").alias("zones"), F.round(F.sum("people"), 2).alias("people"))


@query("a22_neighbour_overlap", """
WITH x AS (SELECT DISTINCT iy // 10 AS cy, ix // 10 AS cx, date FROM cell_days WHERE value > 45),
n AS (SELECT cy, cx, count(*) AS days FROM x GROUP BY 1, 2)
SELECT a.cy, a.cx, b.cy AS ny, b.cx AS nx, count(*) AS both_days, round(100.0 * count(*) / n.days, 6) AS percentage
FROM x a JOIN x b ON a.date = b.date AND abs(a.cy - b.cy) <= 1 AND abs(a.cx - b.cx) <= 1
JOIN n ON n.cy = a.cy AND n.cx = a.cx GROUP BY 1, 2, 3, 4, n.days""")
def _(spark, sf):
    return overlap(spark, sf).withColumn("percentage", F.round("percentage", 6))


@query("a22b_wide_overlap", """
WITH x AS (SELECT DISTINCT iy // 10 AS cy, ix // 10 AS cx, date FROM cell_days WHERE value > 45),
n AS (SELECT cy, cx, count(*) AS days FROM x GROUP BY 1, 2)
SELECT a.cy, a.cx, b.cy AS ny, b.cx AS nx, count(*) AS both_days, round(100.0 * count(*) / n.days, 6) AS percentage
FROM x a JOIN x b ON a.date = b.date AND abs(a.cy - b.cy) <= 2 AND abs(a.cx - b.cx) <= 2
JOIN n ON n.cy = a.cy AND n.cx = a.cx GROUP BY 1, 2, 3, 4, n.days""")
def _(spark, sf):
    return overlap(spark, sf, 2).withColumn("percentage", F.round("percentage", 6))


def overlap(spark, sf, rounds=1):
    """Overlap of extreme days between neighbouring one-degree cells."""
    hot = D.cell_days(spark, sf).where("value > 45").select(
        F.floor(F.col("iy") / 10).alias("cy"), F.floor(F.col("ix") / 10).alias("cx"), "date")
    return G.neighbour_overlap(hot, "cx", "cy", "date", rounds)


@query("a23_min_max_scale", """
SELECT station, date, round((value - min(value) OVER w) / nullif(max(value) OVER w - min(value) OVER w, 0), 6) AS scaled
FROM station_days WINDOW w AS (PARTITION BY station)""")
def _(spark, sf):
    return N.min_max(D.station_days(spark, sf), ["station"], "value", "scaled").select(
        "station", "date", F.round("scaled", 6).alias("scaled"))


@query("a24_population_z", """
SELECT zone, date, round(CASE WHEN stddev_pop(value) OVER w = 0 THEN 0.0
  ELSE (value - avg(value) OVER w) / stddev_pop(value) OVER w END, 6) AS z
FROM zone_months WINDOW w AS (PARTITION BY zone, month(date))""")
def _(spark, sf):
    m = D.zone_months(spark, sf).withColumn("month", F.month("date"))
    return N.z_score(m, ["zone", "month"], "value", "z", sd="population").select(
        "zone", "date", F.round("z", 6).alias("z"))


CONFUSION_SQL = f"""SELECT f.zone, count(*) FILTER (event = 1 AND value >= thr) AS tp, count(*) FILTER (event = 0 AND value >= thr) AS fp,
  count(*) FILTER (event = 0 AND value < thr) AS tn, count(*) FILTER (event = 1 AND value < thr) AS fn
  FROM zone_flagged f JOIN {Q90} t ON f.zone = t.zone GROUP BY f.zone"""


def uniform_sql(*parts: str, seed: int = 7) -> str:
    text = " || '|' || ".join(f"({p})" for p in parts)
    return f"((('0x' || substr(md5('{seed}|' || {text}), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)"


def binomial_sql(name: str, source: str, keys: str, n: str, p: str, u: str, out: str) -> str:
    """Tables that add the binomial quantile of ``u`` to the rows of ``source`` as ``out``: the distribution is added up from logarithms."""
    return f"""
{name}_a AS (SELECT *, ({n})::BIGINT AS bn, coalesce({p}, 0.0)::DOUBLE AS bp, {u} AS bu FROM {source}),
{name}_b AS (SELECT *, least(bp, 1 - bp) AS bq, bn * least(bp, 1 - bp) AS bm FROM {name}_a),
{name}_c AS (SELECT {keys}, bu, sum(CASE WHEN bq = 0 THEN CASE WHEN j = 0 THEN 1.0 ELSE 0.0 END ELSE
    exp(lgamma(bn + 1) - lgamma(j + 1) - lgamma(bn - j + 1) + j * ln(bq) + (bn - j) * ln(1 - bq)) END)
    OVER (PARTITION BY {keys} ORDER BY j ROWS UNBOUNDED PRECEDING) AS cdf
  FROM (SELECT *, unnest(range(0, least(bn, floor(bm + 12 * sqrt(bm + 1))::BIGINT + 10) + 1)) AS j FROM {name}_b WHERE bm * (1 - bq) < 25)),
{name}_d AS (SELECT {keys}, count(*) FILTER (cdf < bu) AS kk FROM {name}_c GROUP BY {keys}),
{name} AS (SELECT b.* EXCLUDE (bn, bp, bu, bq, bm, drawn), CASE WHEN bp > 0.5 THEN bn - drawn ELSE drawn END AS {out} FROM (
  SELECT b.*, CASE WHEN bm * (1 - bq) >= 25 THEN greatest(0, least(bn, floor(bm + {ppf_sql('bu')} * sqrt(bm * (1 - bq)) + 0.5)))::BIGINT ELSE kk END AS drawn
  FROM {name}_b b LEFT JOIN {name}_d d USING ({keys})) b)"""


@query("a25_bootstrap_wacc", f"""
WITH c AS ({CONFUSION_SQL}),
r AS (SELECT *, tp + fp + tn + fn AS n, unnest(range(1, 1001)) AS rep FROM c),
{binomial_sql("e", "r", "zone, rep", "n", "(tp + fn) / nullif(n, 0)", uniform_sql("zone", "rep", "'events'"), "pos")},
{binomial_sql("h", "e", "zone, rep", "pos", "tp / nullif(tp + fn, 0)", uniform_sql("zone", "rep", "'hits'"), "hits")},
{binomial_sql("j", "h", "zone, rep", "n - pos", "tn / nullif(tn + fp, 0)", uniform_sql("zone", "rep", "'rejections'"), "rejections")},
w AS (SELECT zone, 0.75 * hits / nullif(pos, 0) + 0.25 * rejections / nullif(n - pos, 0) AS w FROM j),
m AS (SELECT zone, avg(w) AS mean, stddev_samp(w) AS sd FROM w GROUP BY 1)
SELECT zone, round(mean, 6) AS mean, round(sd, 6) AS sd, round(mean - 1.962 * sd / sqrt(1000), 6) AS ci_low, round(mean + 1.962 * sd / sqrt(1000), 6) AS ci_high FROM m""")
def _(spark, sf):
    out = K.bootstrap_wacc(K.confusion(predicted(spark, sf), ["zone"], "event", "pred"), ["zone"])
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "sd", "ci_low", "ci_high")})


@query("a26_random_baseline", f"""
WITH c AS (SELECT zone, count(*) FILTER (event = 1) AS n_pos, count(*) FILTER (event = 0) AS n_neg FROM zone_flagged GROUP BY 1),
r AS (SELECT *, unnest(range(1, 1001)) AS rep FROM c),
{binomial_sql("e", "r", "zone, rep", "n_pos", "0.5", uniform_sql("zone", "rep", "'tp'"), "tp")},
{binomial_sql("h", "e", "zone, rep", "n_neg", "0.5", uniform_sql("zone", "rep", "'fp'"), "fp")},
k AS (SELECT *, n_pos - tp AS fn, n_neg - fp AS tn FROM h),
s AS (SELECT zone, 'positive' AS class, tp / nullif(tp + fp, 0) AS p, tp / nullif(n_pos, 0) AS r, 2 * tp / nullif(2 * tp + fp + fn, 0) AS f FROM k
  UNION ALL SELECT zone, 'negative', tn / nullif(tn + fn, 0), tn / nullif(n_neg, 0), 2 * tn / nullif(2 * tn + fp + fn, 0) FROM k)
SELECT zone, class, round(avg(p), 2) AS precision, round(stddev_samp(p), 2) AS precision_sd, round(avg(r), 2) AS recall,
  round(stddev_samp(r), 2) AS recall_sd, round(avg(f), 2) AS f1, round(stddev_samp(f), 2) AS f1_sd FROM s GROUP BY 1, 2""")
def _(spark, sf):
    return K.random_baseline(D.zone_flagged(spark, sf), ["zone"], "event")


@query("a27_station_description", """
SELECT station, count(*) AS days, sum(value) AS amount, round(avg(value), 6) AS mean FROM station_days GROUP BY 1""")
def _(spark, sf):
    return D.station_days(spark, sf).groupBy("station").agg(
        F.count("*").alias("days"), F.sum("value").alias("amount"), F.round(F.avg("value"), 6).alias("mean"))


@query("a28_anomaly_frequency", """
SELECT zone, year(date) AS year, count(*) FILTER (z < -1) AS below_1, count(*) FILTER (z < -1.5) AS below_15,
  count(*) FILTER (z < -2) AS below_2, round(avg(CASE WHEN z < -1 THEN 1.0 ELSE 0.0 END), 6) AS share_below_1 FROM (
  SELECT zone, date, round((value - avg(value) OVER w) / stddev_samp(value) OVER w, 6) AS z FROM zone_months
  WINDOW w AS (PARTITION BY zone)) GROUP BY 1, 2""")
def _(spark, sf):
    z = N.z_score(D.zone_months(spark, sf), ["zone"], "value", "z").withColumn("z", F.round("z", 6))
    c = F.col("z")
    return z.groupBy("zone", F.year("date").alias("year")).agg(
        F.count(F.when(c < -1, 1)).alias("below_1"), F.count(F.when(c < -1.5, 1)).alias("below_15"),
        F.count(F.when(c < -2, 1)).alias("below_2"),
        F.round(F.avg(F.when(c < -1, 1.0).otherwise(0.0)), 6).alias("share_below_1"))


#: Durations, here in days.
DURATIONS = [1, 2, 3, 4, 6, 9, 12, 18, 24, 36, 48, 72]
#: Return periods in years.
PERIODS = [2, 5, 10, 20, 50, 100]


@query("a29_duration_frequency", """
WITH z AS (SELECT zone, date, date - DATE '1970-01-01' AS d, rain AS v FROM zone_days),
r AS (SELECT zone, year(date) AS year, """ + ", ".join(f"sum(v) OVER w{n} AS d{n}" for n in DURATIONS) + """
  FROM z WINDOW """ + ", ".join(
    f"w{n} AS (PARTITION BY zone ORDER BY d RANGE BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in DURATIONS) + """),
l AS (UNPIVOT r ON """ + ", ".join(f"d{n}" for n in DURATIONS) + """ INTO NAME d VALUE v),
m AS (SELECT zone, CAST(substr(d, 2) AS BIGINT) AS duration, year, round(max(v), 6) AS mx FROM l GROUP BY 1, 2, 3),
k AS (SELECT *, row_number() OVER (PARTITION BY zone, duration ORDER BY mx) AS r, count(*) OVER (PARTITION BY zone, duration) AS n FROM m),
b AS (SELECT zone, duration, avg(mx) AS b0, sum((r - 1) / (n - 1) * mx) / count(*) AS b1 FROM k WHERE n >= 2 GROUP BY 1, 2)
SELECT zone, duration, CAST(period AS BIGINT) AS period, round(round(b0 - (2 * b1 - b0) / ln(2) * 0.5772156649015329
  - (2 * b1 - b0) / ln(2) * ln(-ln(1 - 1.0 / period)), 6) / duration, 4) AS intensity
FROM b, (VALUES (2), (5), (10), (20), (50), (100)) p(period)""")
def _(spark, sf):
    """Largest sum of each duration in each year, and from these the intensity per day of each return period in years."""
    from ..operators.windows import along
    # a day without rows adds nothing, so the largest sum of a year ends at a day with rows
    days = D.zone_days(spark, sf).withColumn("d", F.unix_date("date"))
    w = along(["zone"], "d")
    sums = {f"d{n}": F.sum("rain").over(w.rangeBetween(-(n - 1), 0)) for n in DURATIONS}
    wide = days.withColumns(sums).groupBy("zone", F.year("date").alias("year")).agg(*[F.round(F.max(c), 6).alias(c) for c in sums])
    long = wide.unpivot(["zone", "year"], list(sums), "c", "mx").withColumn("duration", F.substring("c", 2, 5).cast("int"))
    lv = Q.gumbel_levels(long, ["zone", "duration"], "mx", PERIODS)
    return lv.select("zone", "duration", "period", F.round(F.col("level") / F.col("duration"), 4).alias("intensity"))


@query("a30_yearly_labels", """
WITH m AS (SELECT zone AS admin, (zone * 7) % 6 AS lz FROM zone_shapes),
y AS (SELECT zone AS admin, year(date) AS year, max(severity) AS affected FROM impact_reports GROUP BY 1, 2)
SELECT 'admin' AS level, admin AS zone, year, affected FROM y
UNION ALL SELECT 'livelihood', lz, year, max(affected) FROM y JOIN m USING (admin) GROUP BY 2, 3""")
def _(spark, sf):
    worst = D.events(spark, sf).groupBy(F.col("zone").alias("admin"), F.year("date").alias("year")).agg(
        F.max("severity").alias("severity"))
    lz = D.zone_shapes(spark, sf).select(F.col("zone").alias("admin"), ((F.col("zone") * 7) % 6).alias("lz"))
    return I.yearly_labels(worst, lz, "admin", "lz", "year", "severity")


@query("a31_yearly_totals", """
WITH y AS (SELECT unnest(generate_series(min(year(date)) - 1, max(year(date)) + 1)) AS year FROM zone_days),
e AS (SELECT year(date) AS year, count(*) AS events, count(*) FILTER (severity > 250000) AS severe FROM impact_reports GROUP BY 1)
SELECT y.year, CASE WHEN y.year < 1998 THEN 'train' ELSE 'test' END AS split, coalesce(events, 0) AS events,
  coalesce(severe, 0) AS severe FROM y LEFT JOIN e USING (year)""")
def _(spark, sf):
    b = D.zone_days(spark, sf).agg(F.min(F.year("date")).alias("lo"), F.max(F.year("date")).alias("hi"))
    years = b.select(F.explode(F.sequence(F.col("lo") - 1, F.col("hi") + 1)).alias("year"))
    e = D.events(spark, sf).groupBy(F.year("date").alias("year")).agg(
        F.count("*").alias("events"), F.count(F.when(F.col("severity") > 250000, 1)).alias("severe"))
    return years.join(e, "year", "left").select(
        "year", F.when(F.col("year") < 1998, "train").otherwise("test").alias("split"),
        F.coalesce("events", F.lit(0)).alias("events"), F.coalesce("severe", F.lit(0)).alias("severe"))


@query("o01_multi_key_sort", "SELECT zone, date, value FROM zone_months ORDER BY zone, date")
def _(spark, sf):
    return D.zone_months(spark, sf).select("zone", "date", "value").orderBy("zone", "date")


@query("o02_top_zones", """
SELECT zone, affected FROM (SELECT *, rank() OVER (ORDER BY affected DESC) AS r FROM (
  SELECT zone, round(sum(severity), 2) AS affected FROM impact_reports GROUP BY zone)) WHERE r <= 20""")
def _(spark, sf):
    a = D.events(spark, sf).groupBy("zone").agg(F.round(F.sum("severity"), 2).alias("affected"))
    # rows tied with the 20th are kept: compare with the smallest of the 20 largest
    cut = a.orderBy(F.desc("affected")).limit(20).agg(F.min("affected")).scalar()
    return a.where(F.col("affected") >= cut)


@query("o03_best_cues", """
SELECT cue, round(abs(r), 6) AS strength FROM (
  SELECT 'rain' AS cue, corr(rain, value) AS r FROM zone_months UNION ALL
  SELECT 'month', corr(month(date), value) FROM zone_months UNION ALL
  SELECT 'year', corr(year(date), value) FROM zone_months UNION ALL
  SELECT 'zone', corr(zone, value) FROM zone_months UNION ALL
  SELECT 'quarter', corr(ceil(month(date) / 3), value) FROM zone_months UNION ALL
  SELECT 'day', corr(day(last_day(date)), value) FROM zone_months) ORDER BY strength DESC LIMIT 5""")
def _(spark, sf):
    m = D.zone_months(spark, sf)
    cues = {"rain": F.col("rain"), "month": F.month("date"), "year": F.year("date"), "zone": F.col("zone"),
            "quarter": F.ceil(F.month("date") / 3), "day": F.dayofmonth(F.last_day("date"))}
    wide = m.agg(F.array(*[F.struct(F.lit(n).alias("cue"), F.round(F.abs(F.corr(c.cast("double"), "value")), 6)
                                    .alias("strength")) for n, c in cues.items()]).alias("c"))
    return wide.select(F.inline("c")).orderBy(F.desc("strength")).limit(5)


def greedy_sql(steps: int, limit: float) -> str:
    return f"""
WITH RECURSIVE x AS (SELECT DISTINCT iy // 10 AS cy, ix // 10 AS cx, date FROM cell_days WHERE value > 45),
n AS (SELECT cy, cx, count(*) AS days FROM x GROUP BY 1, 2),
o AS (SELECT a.cy * 10000 + a.cx AS cell, b.cy * 10000 + b.cx AS neighbour, round(100.0 * count(*) / n.days, 6) AS p
  FROM x a JOIN x b ON a.date = b.date AND abs(a.cy - b.cy) <= 1 AND abs(a.cx - b.cx) <= 1 JOIN n ON n.cy = a.cy AND n.cx = a.cx
  WHERE a.cy <> b.cy OR a.cx <> b.cx GROUP BY 1, 2, n.days),
g AS (SELECT cell, list(struct_pack(p := p, o := -neighbour)) AS nbrs FROM o GROUP BY 1),
path(step, pool, visited) AS (
  SELECT 0, list_transform(nbrs, lambda e: struct_pack(p := e.p, o := e.o, poi := cell, step := 0)), [cell]
  FROM g WHERE cell = (SELECT cell FROM o ORDER BY p DESC, cell LIMIT 1)
  UNION ALL
  SELECT s.step + 1, list_concat(s.pool, list_transform(list_filter(g.nbrs,
      lambda e: NOT list_contains(s.visited, -e.o) AND NOT list_contains(list_transform(s.pool, lambda q: q.o), e.o)),
      lambda e: struct_pack(p := e.p, o := e.o, poi := g.cell, step := s.step + 1))), list_append(s.visited, g.cell)
  FROM (SELECT *, list_reverse_sort(list_filter(pool, lambda q: NOT list_contains(visited, -q.o)))[1] AS best FROM path) s
  JOIN g ON g.cell = -s.best.o WHERE s.best.p > {limit} AND s.step < {steps}),
e AS (SELECT *, list_reverse_sort(list_filter(pool, lambda q: NOT list_contains(visited, -q.o)))[1] AS best FROM path ORDER BY step DESC LIMIT 1),
r AS (SELECT unnest(pool) AS q, visited, step, best FROM e)
SELECT -q.o AS neighbour, q.p AS percentage, q.poi AS poi, CAST(q.step AS BIGINT) AS step,
  CAST(CASE WHEN list_contains(visited, -q.o) OR (r.step = {steps} AND best.p > {limit} AND best.o = q.o) THEN 1 ELSE 0 END AS BIGINT) AS selected FROM r"""


def greedy(spark, sf, steps: int, limit: float):
    cell = F.col("cy") * 10000 + F.col("cx")
    table = cut_lineage(overlap(spark, sf).select(
        cell.alias("cell"), (F.col("ny") * 10000 + F.col("nx")).alias("neighbour"), F.round("percentage", 6).alias("percentage")))
    # the click: the cell with the strongest neighbour
    click = table.where("cell <> neighbour").orderBy(F.desc("percentage"), "cell").limit(1).select("cell")
    return G.greedy_path(table, "cell", "neighbour", click, steps, limit)


@query("o04_greedy_path", greedy_sql(10, 60.0))
def _(spark, sf):
    return greedy(spark, sf, 10, 60.0)


@query("o04b_long_path", greedy_sql(8, 5.0))
def _(spark, sf):
    return greedy(spark, sf, 8, 5.0)


@query("u01_union_by_name", """
SELECT zone, date, severity AS people, NULL::DOUBLE AS value FROM all_reports
UNION ALL SELECT zone, date, NULL, value FROM zone_months""")
def _(spark, sf):
    a = D.reports(spark, sf).select("zone", "date", F.col("severity").alias("people"))
    return a.unionByName(D.zone_months(spark, sf).select("zone", "date", "value"), allowMissingColumns=True)


@query("u02_append", """
SELECT zone, date, value FROM zone_months WHERE year(date) <= 1998
UNION ALL SELECT zone, date, value FROM zone_months WHERE year(date) >= 1998""")
def _(spark, sf):
    m = D.zone_months(spark, sf).select("zone", "date", "value")
    return m.where(F.year("date") <= 1998).unionByName(m.where(F.year("date") >= 1998))


@query("u03_distinct", "SELECT DISTINCT p_brand, p_type, p_size FROM part")
def _(spark, sf):
    return D.table(spark, sf, "part").select("p_brand", "p_type", "p_size").distinct()


@query("u04_set_operations", """
SELECT 'either' AS kind, zone, date FROM (SELECT zone, date FROM impact_reports UNION SELECT zone, date FROM zone_days)
UNION ALL SELECT 'only_event', zone, date FROM (SELECT zone, date FROM event_days EXCEPT SELECT zone, date FROM zone_days)""")
def _(spark, sf):
    e, z = D.event_days(spark, sf), D.zone_days(spark, sf).select("zone", "date")
    either = e.unionByName(z).distinct().withColumn("kind", F.lit("either"))
    only = e.join(z, ["zone", "date"], "left_anti").withColumn("kind", F.lit("only_event"))
    return either.unionByName(only)
