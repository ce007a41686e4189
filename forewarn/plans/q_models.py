"""Model queries. Scores depend on iterative solvers, so they are compared by shape and by tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import models as L
from ..operators import series as T
from ..operators import skill as K
from ..operators import tuning as U
from ..operators.windows import along
from ..session import cut_lineage
from . import domain as D
from .registry import query

#: Inverse strengths of the L1 penalty that are tried, in steps of about three.
STRENGTHS = [0.1, 0.3, 1.0, 3.0, 12.0, 30.0]
FEATURES = ["value", "rain", "value_lag1", "rain_lag1", "month"]


def training(spark, sf):
    """Monthly features per zone with the event label; written once, read by every fit."""
    ev = D.events(spark, sf).where("severity > 200000").select("zone", F.trunc("date", "month").alias("date"))
    m = T.attach_flag(D.zone_months(spark, sf), ev, ["zone"], "label")
    w = along(["zone"], "date")
    m = m.select("zone", "date", "label", "value", (F.col("rain") / 1000).alias("rain"),
                 F.lag("value").over(w).alias("value_lag1"), (F.lag("rain").over(w) / 1000).alias("rain_lag1"),
                 F.month("date").cast("double").alias("month"), F.year("date").alias("year"))
    return cut_lineage(m.dropna())


def scores(pred, by=("split",)):
    return K.class_scores(K.confusion(pred, list(by), "label", "predicted"))


@query("x31_sparse_logistic")
def _(spark, sf):
    data = training(spark, sf)
    train, valid = L.year_window(data, "year", 1995, 1999), L.year_window(data, "year", 1999, 2000)
    model, _c, _t = L.sparse_logistic(train, valid, FEATURES, "label", STRENGTHS)
    test = L.predict(model, L.assemble(L.year_window(data, "year", 2000, 2002), FEATURES))
    return scores(test.withColumn("split", F.lit("test")))


@query("x31b_coefficients")
def _(spark, sf):
    data = training(spark, sf)
    model, _c, _t = L.sparse_logistic(L.year_window(data, "year", 1995, 1999), L.year_window(data, "year", 1999, 2002),
                                      FEATURES, "label", STRENGTHS)
    return L.coefficient_table(data, model, FEATURES, 0.0)


@query("x31c_strength_path")
def _(spark, sf):
    data = training(spark, sf)
    return L.sparse_logistic(L.year_window(data, "year", 1995, 1999), L.year_window(data, "year", 1999, 2000),
                             FEATURES, "label", STRENGTHS)[2]


def stations(spark, sf):
    return U.station_matrix(D.station_flagged(spark, sf), "zone", "station", "date", "value", "event", D.mapping(spark, sf).count())


@query("x33_boosted_trees")
def _(spark, sf):
    """One model for each district on the days' values of its stations, scored on the rows it was fitted to."""
    return U.trees_by_zone(stations(spark, sf), "zone")[0]


@query("x33b_station_importances")
def _(spark, sf):
    return U.trees_by_zone(stations(spark, sf), "zone")[1]


@query("x33c_station_matrix", """
WITH s AS (SELECT zone, date, station, max(value) AS v, max(event) AS e FROM station_flagged GROUP BY 1, 2, 3),
i AS (SELECT zone, station, row_number() OVER (PARTITION BY zone ORDER BY station) AS k, count(*) OVER (PARTITION BY zone) AS n FROM (SELECT DISTINCT zone, station FROM s)),
d AS (SELECT zone, date, max(e) AS label FROM s GROUP BY 1, 2),
w AS (SELECT zone, label, sum(count(*)) OVER (PARTITION BY zone) / count(*) AS weight FROM d GROUP BY 1, 2)
SELECT d.zone, d.date, CAST(d.label AS BIGINT) AS label, any_value(i.n) AS n_stations, round(any_value(w.weight), 6) AS weight,
  sum(coalesce(s.v, 0)) AS total, sum(i.k * coalesce(s.v, 0)) AS moment
FROM d JOIN i USING (zone) LEFT JOIN s ON s.zone = d.zone AND s.date = d.date AND s.station = i.station JOIN w ON w.zone = d.zone AND w.label = d.label GROUP BY 1, 2, 3""")
def _(spark, sf):
    m = stations(spark, sf)
    return m.select("zone", "date", "label", F.size("x").cast("bigint").alias("n_stations"), F.round("weight", 6).alias("weight"),
                    F.aggregate("x", F.lit(0.0), lambda s, v: s + v).alias("total"),
                    F.aggregate(F.transform("x", lambda v, k: v * (k + 1)), F.lit(0.0), lambda s, v: s + v).alias("moment"))


#: Lead times in months, and what is known then.
LEADS, LEAD_FEATURES, SETS, SEED = [1, 3], ["value_then", "rain_then", "mean3", "season"], 6, 123


def lead_training(spark, sf):
    """Months with what was known a lead time before, split and dealt to folds within lead and class."""
    ev = D.events(spark, sf).where("severity > 200000").select("zone", F.trunc("date", "month").alias("date"))
    m = T.attach_flag(D.zone_months(spark, sf), ev, ["zone"], "label")
    w = along(["zone"], "date")

    def known(k):
        then = F.lag("value", k).over(w)
        return F.struct(F.lit(k).alias("lead"), then.alias("value_then"), (F.lag("rain", k).over(w) / 1000).alias("rain_then"),
                        ((then + F.lag("value", k + 1).over(w) + F.lag("value", k + 2).over(w)) / 3).alias("mean3"))

    rows = m.withColumn("k", F.array(*[known(k) for k in LEADS])).withColumn("k", F.explode("k"))
    rows = rows.select("zone", "date", "label", "k.*", F.month("date").cast("double").alias("season")).dropna()
    region = D.table(spark, sf, "nation").select(F.col("n_nationkey").cast("bigint").alias("zone"), F.col("n_regionkey").cast("bigint").alias("region"))
    return U.split_and_folds(rows.join(region, "zone"), "lead", ["zone", "date"], "label", seed=SEED)


@query("x34_tuned_trees")
def _(spark, sf):
    """For each lead time the best of the drawn parameter sets by recall over five stratified folds, and its scores."""
    return U.tuned_by_key(cut_lineage(lead_training(spark, sf)), "lead", LEADS, LEAD_FEATURES, "label", "region", sets=SETS, rounds=5, seed=SEED)


@query("x34b_search_design", f"""
WITH ev AS (SELECT DISTINCT zone, CAST(date_trunc('month', date) AS DATE) AS date FROM impact_reports WHERE severity > 200000),
s AS (SELECT z.*, CASE WHEN ev.zone IS NULL THEN 0 ELSE 1 END AS label, row_number() OVER (PARTITION BY z.zone ORDER BY z.date) AS k FROM zone_months z LEFT JOIN ev USING (zone, date)),
r AS (SELECT t.zone, t.date, t.label, g.lead FROM s t CROSS JOIN (VALUES (1), (3)) g(lead) WHERE t.k > g.lead + 2),
p AS (SELECT *, CASE WHEN (row_number() OVER (PARTITION BY lead, label ORDER BY md5('{SEED}|' || zone || '|' || date), zone, date) - 1) % 10 < 3 THEN 'test' ELSE 'train' END AS part FROM r),
f AS (SELECT *, (row_number() OVER (PARTITION BY lead, part, label ORDER BY md5('{SEED + 1}|' || zone || '|' || date), zone, date) - 1) % 5 AS fold FROM p),
u AS (SELECT i AS set, n AS name, (('0x' || substr(md5('{SEED}|' || i || '|' || n), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE AS u
  FROM range({SETS}) s(i) CROSS JOIN (VALUES ('depth'), ('child_weight'), ('eta'), ('gamma')) p(n)),
d AS (SELECT set, max(floor(u * 6) + 1) FILTER (name = 'depth') AS depth, max(floor(u * 20) + 1) FILTER (name = 'child_weight') AS child_weight,
  max(floor(u * 8) * 0.1::DOUBLE + 0.3::DOUBLE) FILTER (name = 'eta') AS eta, max(floor(u * 21) * 0.1::DOUBLE) FILTER (name = 'gamma') AS gamma FROM u GROUP BY 1)
SELECT CAST(lead AS BIGINT) AS lead, part, fold, set, CAST(depth AS BIGINT) AS depth, CAST(child_weight AS BIGINT) AS child_weight, round(eta, 6) AS eta, round(gamma, 6) AS gamma,
  count(*) AS months, CAST(sum(label) AS BIGINT) AS events FROM f CROSS JOIN d GROUP BY 1, 2, 3, 4, 5, 6, 7, 8""")
def _(spark, sf):
    """What the search of x34 tries: each drawn set on each fold, whose classes are as balanced as their numbers allow."""
    folds = lead_training(spark, sf).groupBy("lead", "part", "fold").agg(F.count("*").alias("months"), F.sum("label").alias("events"))
    sets = U.drawn_sets(spark, SETS, SEED).select("set", *[F.round(n, 6).alias(n) for n in U.GRID])
    drawn = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SETS - 1).cast("bigint")))
    return folds.withColumn("set", drawn).join(sets, "set").select("lead", "part", "fold", "set", *U.GRID, "months", "events")


@query("x35_loss_tree")
def _(spark, sf):
    data = training(spark, sf)
    out = None
    for cost in (1.0, 8.0):
        part = L.predict(L.loss_tree(data, FEATURES, "label", cost), L.assemble(data, FEATURES))
        part = part.select(F.lit(cost).alias("miss_cost"), "label", "predicted")
        out = part if out is None else out.unionByName(part)
    return scores(out, ["miss_cost"])


@query("x36_importances")
def _(spark, sf):
    data = training(spark, sf)
    return L.importance_table(data, L.boosted_trees(data, FEATURES, "label", rounds=10), FEATURES)


@query("x37_classifier_comparison")
def _(spark, sf):
    return L.compare_classifiers(training(spark, sf), FEATURES, "label", ["zone", "date"], folds=5)
