import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from forewarn.functions import scalar as S
from forewarn.functions.fits import gamma_cdf
from forewarn.operators import forecast_metrics as M
from forewarn.operators import indices as N
from forewarn.operators import models as L
from forewarn.operators import quantiles as Q
from forewarn.operators import skill as K
from forewarn.operators import triggers as X

D0 = dt.date(2020, 1, 1)


def test_published_ratios_follow_from_counts(spark):
    # Published scores of a drought quantile model, POD 0.724, FAR 0.398, CSI 0.490, n = 98.
    c = spark.createDataFrame([(71, 47, 0, 27)], "tp long, fp long, tn long, fn long")
    r = K.skill_ratios(c).first()
    assert (round(r["pod"], 3), round(r["far"], 3), round(r["csi"], 2)) == (0.724, 0.398, 0.49)
    assert r["pofd"] == 1.0


def test_published_trigger_rows(spark):
    # Published trigger rows (floods, correct, triggered, in vain, ratios).
    rows = [(11, 8, 15, 7, 0.73, 0.47), (6, 4, 9, 5, 0.67, 0.56)]
    df = spark.createDataFrame(rows, "f long, c long, t long, v long, dr double, fa double")
    out = df.select("dr", "fa", *X.score_columns(F.col("f"), F.col("c"), F.col("t"), F.col("v"))).collect()
    assert all(r["detection_ratio"] == r["dr"] and r["false_alarm_ratio"] == r["fa"] for r in out)


def test_published_confusion_scores(spark):
    # Published logit confusion, TP 14 FN 7 FP 44 TN 55.
    c = spark.createDataFrame([(14, 44, 55, 7)], "tp long, fp long, tn long, fn long")
    r = K.class_scores(c, 2).first()
    assert (r["precision"], r["recall"], r["f1"]) == (0.24, 0.67, 0.35)


def test_zero_denominators_are_null(spark):
    c = spark.createDataFrame([(0, 0, 5, 0)], "tp long, fp long, tn long, fn long")
    r = K.skill_ratios(c).first()
    assert r["pod"] is None and r["far"] is None and r["csi"] is None


def random_days(spark, seed, n=400, keys=2):
    rng = np.random.default_rng(seed)
    rows = [(k, D0 + dt.timedelta(i), float(v), int(e)) for k in range(keys)
            for i, (v, e) in enumerate(zip(rng.integers(0, 40, n), rng.random(n) < 0.1))]
    return spark.createDataFrame(rows, "k int, date date, value double, event int").cache()


@pytest.mark.parametrize("hits", ["per_period", "per_day"])
def test_sweep_equals_each_threshold(spark, hits):
    df = random_days(spark, 5)
    percents = list(range(50, 100, 3))
    days = Q.with_levels(df, ["k"], "value", percents)
    got = {(r["k"], r["percent"]): r.asDict() for r in
           K.threshold_sweep(days, ["k"], "value", "event", "levels", percents, hits).collect()}
    for i, p in enumerate(percents[::4]):
        one = days.withColumn("pred", X.exceedance(F.col("value"), F.col("levels")[i * 4]))
        for r in K.period_skill(one, ["k"], "event", "pred", hits).collect():
            want = r.asDict()
            mine = dict(got[(r["k"], p)])
            mine.pop("percent")
            assert mine == want


def test_confusion_adds_up(spark):
    df = random_days(spark, 6).withColumn("pred", (F.col("value") > 20).cast("int"))
    for r in K.confusion(df, ["k"], "event", "pred").collect():
        assert r["tp"] + r["fp"] + r["tn"] + r["fn"] == 400


def test_exact_quantiles_with_one_hot_key(spark):
    rng = np.random.default_rng(9)
    hot, cold = rng.normal(size=4000).round(2), rng.normal(size=50).round(2)
    rows = [("hot", float(v)) for v in hot] + [("cold", float(v)) for v in cold]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {(r["k"], r["percent"]): r["threshold"] for r in Q.quantiles_of_rows(df, ["k"], "v", [1, 50, 95, 99]).collect()}
    for name, arr in (("hot", hot), ("cold", cold)):
        for p in (1, 50, 95, 99):
            assert got[(name, p)] == pytest.approx(np.quantile(arr, p / 100), abs=2e-6)


@pytest.mark.parametrize("n", [1, 2, 3, 699, 702, 5000, 60_000])
def test_exact_quantiles_of_any_size(spark, n):
    """Ties, few rows and sketches that have thrown rows away."""
    rng = np.random.default_rng(n)
    values = np.concatenate([rng.normal(size=n - n // 3).round(3), np.full(n // 3, 0.125)])
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double").repartition(5).withColumn("k", F.lit(1))
    got = {r["percent"]: r["threshold"] for r in Q.quantiles_of_rows(df, ["k"], "v", [0, 5, 50, 90, 100]).collect()}
    assert got == pytest.approx({p: np.quantile(values, p / 100) for p in (0, 5, 50, 90, 100)}, abs=2e-6)


@pytest.mark.parametrize("n", [1, 5, 12, 13, 50, 63])
def test_levels_reached(spark, n):
    levels = [float(i) for i in range(n)]
    df = spark.createDataFrame([(float(v),) for v in (-1, 0, 0.5, n - 1, n + 3)] + [(None,)], "v double")
    out = [r[0] for r in df.select(Q.levels_reached(F.col("v"), F.array(*[F.lit(x) for x in levels]), n)).collect()]
    assert out == [0, 1, 1, n, n, 0]


@pytest.mark.parametrize("pieces", [1, 8])
@pytest.mark.parametrize("descending", [False, True])
def test_running_totals(spark, pieces, descending):
    rng = np.random.default_rng(2)
    rows = [("a" if i % 5 else "b", float(v)) for i, v in enumerate(rng.integers(0, 200, 1500))]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {(r["k"], r["v"]): r["cum_n"] for r in Q.running_totals(df, ["k"], "v", {"n": F.count("*")}, pieces, descending).collect()}
    for (k, v), c in got.items():
        assert c == sum(1 for a, b in rows if a == k and (b >= v if descending else b <= v))


def test_auc_counts_ties_half(spark):
    rng = np.random.default_rng(4)
    rows = [(1, int(y), float(s)) for y, s in zip(rng.integers(0, 2, 300), rng.integers(0, 9, 300))]
    df = spark.createDataFrame(rows, "k int, y int, s double")
    pos, neg = [s for _, y, s in rows if y], [s for _, y, s in rows if not y]
    want = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))
    assert K.auc(K.roc_points(df, ["k"], "y", "s", pieces=4), ["k"]).first()["auc"] == pytest.approx(want, abs=1e-6)


def test_bootstrap_centres_on_the_score(spark):
    c = spark.createDataFrame([(1, 60, 20, 100, 20)], "k int, tp long, fp long, tn long, fn long")
    r = K.bootstrap_wacc(c, ["k"]).first()
    point = 0.75 * 60 / 80 + 0.25 * 100 / 120
    assert abs(r["mean"] - point) < 0.01 and 0.01 < r["sd"] < 0.08
    assert r["ci_high"] - r["mean"] == pytest.approx(1.962 * r["sd"] / math.sqrt(1000))
    assert K.bootstrap_wacc(c, ["k"]).first() == r


def test_random_baseline_matches_prevalence(spark):
    df = spark.createDataFrame([(1, int(i % 5 == 0)) for i in range(500)], "k int, y int")
    rows = {r["class"]: r for r in K.random_baseline(df, ["k"], "y").collect()}
    assert rows["positive"]["precision"] == pytest.approx(0.2, abs=0.02)
    assert rows["negative"]["recall"] == pytest.approx(0.5, abs=0.02)


def test_inverse_normal_and_gamma(spark):
    ps = [0.001, 0.02, 0.3, 0.5, 0.9, 0.99, 0.9999]
    z = {0.5: 0.0, 0.9: 1.2815515655, 0.99: 2.3263478740, 0.001: -3.0902323062}
    df = spark.createDataFrame([(p,) for p in ps + [0.0, 1.0]], "p double")
    got = {r["p"]: r["z"] for r in df.select("p", S.norm_ppf(F.col("p")).alias("z")).collect()}
    assert all(got[p] == pytest.approx(v, abs=1e-8) for p, v in z.items())
    assert got[0.0] is None and got[1.0] is None
    g = spark.createDataFrame([(x,) for x in (0.1, 0.5, 1.0, 3.5, 9.0)], "x double")
    for r in g.select("x", S.gamma_fn(F.col("x")).alias("g")).collect():
        assert r["g"] == pytest.approx(math.gamma(r["x"]), rel=1e-10)


def test_gamma_cdf_is_exponential_for_shape_one():
    x = np.array([0.0, 0.5, 2.0, 60.0])
    got = gamma_cdf(np.ones(4), x, np.array([math.lgamma(2.0)] * 4))
    assert np.allclose(got, 1 - np.exp(-x), atol=1e-12)


def test_return_levels_by_likelihood(spark):
    rng = np.random.default_rng(8)
    x = 100 - 20 * np.log(-np.log(rng.random(400)))
    df = spark.createDataFrame([(1, float(v)) for v in x], "k int, m double")
    ml = {r["period"]: r for r in Q.gev_likelihood_levels(df, ["k"], "m", [2, 10]).collect()}
    lm = {r["period"]: r["level"] for r in Q.return_levels(Q.gev_parameters(Q.l_moments(df, ["k"], "m")), ["k"], [2, 10]).collect()}
    gu = {r["period"]: r["level"] for r in Q.gumbel_levels(df, ["k"], "m", [2, 10]).collect()}
    for t in (2, 10):
        true = 100 - 20 * math.log(-math.log(1 - 1 / t))
        assert ml[t]["low"] < ml[t]["estimate"] < ml[t]["high"]
        assert ml[t]["estimate"] == pytest.approx(true, abs=6)
        assert lm[t] == pytest.approx(ml[t]["estimate"], abs=4) and gu[t] == pytest.approx(true, abs=6)


def test_likelihood_fits_take_their_steps_together(spark):
    from forewarn.functions import fits
    rng = np.random.default_rng(12)
    x = np.round(np.sort(40 - 9 * np.log(-np.log(rng.random((40, 14)))), axis=1))
    levels, met = fits.gev_levels(x, [2, 10])
    assert 30 <= met.sum()
    for i in range(len(x)):  # a fit does not depend on what it is fitted beside
        one, own = fits.gev_levels(x[i:i + 1], [2, 10])
        assert own[0] == met[i] and np.allclose(one[0], levels[i], rtol=1e-9, equal_nan=True)
    rows = [(i, float(v)) for i in range(40) for v in x[i]] + [(40, 1.0), (41, None), (None, 1.0)] + [(42, 3.0)] * 8 + [(0, None), (1, float("nan"))]
    df = spark.createDataFrame(rows, "k long, m double")
    out = Q.gev_likelihood_levels(df, ["k"], "m", [2, 10])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroups" not in plan and "REPARTITION_BY_NUM" in plan
    got = {(r["k"], r["period"]): r for r in out.collect()}
    assert len(got) == 2 * 44
    for i in range(40):
        r = got[i, 10]
        assert r["converged"] == met[i] and r["estimate"] == pytest.approx(levels[i, 1, 1]) and (r["low"] is None) == np.isnan(levels[i, 1, 0])
    assert all(got[k, 2]["estimate"] is None and not got[k, 2]["converged"] for k in (40, 41, 42, None))


def test_spi_is_standardised(spark):
    rng = np.random.default_rng(1)
    rows = [(1, dt.date(1950 + i // 12, i % 12 + 1, 1), float(v)) for i, v in enumerate(rng.gamma(3.0, 20.0, 720))]
    df = spark.createDataFrame(rows, "k int, date date, v double")
    for out in (N.spi(df, ["k"], "v", [1]).select(F.col("spi").alias("x")), N.spei(df, ["k"], "v", [1]).select(F.col("spei").alias("x"))):
        r = out.agg(F.avg("x").alias("m"), F.stddev("x").alias("s")).first()
        assert abs(r["m"]) < 0.05 and abs(r["s"] - 1) < 0.08


def test_constant_series_scores(spark):
    df = spark.createDataFrame([(1, 5.0), (1, 5.0)], "k int, v double")
    assert [r["z"] for r in N.z_score(df, ["k"], "v", "z", sd="population").collect()] == [0.0, 0.0]
    assert [r["z"] for r in N.z_score(df, ["k"], "v", "z").collect()] == [None, None]
    assert [r["s"] for r in N.min_max(df, ["k"], "v", "s").collect()] == [None, None]


def test_forecast_metric_choice(spark):
    rows = [(1, D0 + dt.timedelta(i), float(a), float(p)) for i, (a, p) in enumerate([(1, 2), (3, 3), (2, 5)])]
    df = spark.createDataFrame(rows, "k int, date date, a double, p double")
    r = M.forecast_metrics(df, ["k"], "a", "p").first()
    assert r["mae"] == pytest.approx(4 / 3) and r["gmae"] == 0.0 and r["mda"] == pytest.approx(0.5)
    assert M.forecast_metrics(df, ["k"], "a", "p", metrics=["mse"]).columns == ["k", "mse"]
    with pytest.raises(ValueError):
        M.forecast_metrics(df, ["k"], "a", "p", metrics=["nope"])


def test_seasonal_forecast_recovers_a_cycle(spark):
    rows = [(1, dt.date(2000 + i // 12, i % 12 + 1, 1), 10 + 0.1 * i + 3 * math.sin(2 * math.pi * (i % 12 + 1) / 12)) for i in range(60)]
    df = spark.createDataFrame(rows, "k int, date date, v double")
    out = L.seasonal_forecast(df, ["k"], "v", 48).collect()
    assert len(out) == 12 and all(r["forecast"] == pytest.approx(r["actual"], abs=1e-6) for r in out)


def test_models_learn_a_separable_label(spark):
    rng = np.random.default_rng(0)
    rows = [(i, 2000 + i % 10, float(a), float(b), int(a > 0.3)) for i, (a, b) in enumerate(rng.normal(size=(400, 2)))]
    df = spark.createDataFrame(rows, "id int, year int, a double, b double, label int").cache()
    train, valid = L.year_window(df, "year", 2000, 2007), L.year_window(df, "year", 2007, 2010)
    model, c, table = L.sparse_logistic(train, valid, ["a", "b"], "label", [1.0, 50.0])
    assert table.count() == 2 and c in (1.0, 50.0)
    coefs = {r["feature"]: r["coefficient"] for r in L.coefficient_table(df, model, ["a", "b"], 0.01).collect()}
    assert coefs["a"] > 0 and abs(coefs.get("b", 0.0)) < coefs["a"]
    gbt = L.boosted_trees(train, ["a", "b"], "label", rounds=3)
    imp = {r["feature"]: r["importance"] for r in L.importance_table(df, gbt, ["a", "b"]).collect()}
    assert imp["a"] > imp["b"] and sum(imp.values()) == pytest.approx(1.0)
    cautious = L.predict(L.loss_tree(train, ["a", "b"], "label", 8.0), L.assemble(valid, ["a", "b"]))
    assert K.confusion(cautious, [], "label", "predicted").first()["fn"] <= 2


def test_gamma_cdf_on_both_sides_of_its_mean():
    import math

    from forewarn.functions.fits import gamma_cdf
    a = np.array([1.0, 1.0, 3.0, 3.0, 200.0, 200.0, 2.0])
    x = np.array([0.5, 40.0, 1.0, 9.0, 150.0, 260.0, -1.0])
    got = gamma_cdf(a, x, np.array([math.lgamma(v + 1) for v in a]))
    exact = lambda k, v: 1 - math.exp(-v) * sum(math.exp(n * math.log(v) - math.lgamma(n + 1)) for n in range(int(k)))
    assert np.allclose(got, [exact(k, v) if v > 0 else 0.0 for k, v in zip(a, x)], atol=1e-12)


def test_log_gamma(spark):
    import math

    from forewarn.functions.scalar import log_gamma
    x = [0.01, 0.5, 1.0, 2.0, 3.7, 50.0, 1e4]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in x], "x double").select(log_gamma(F.col("x"))).collect()]
    assert np.allclose(got, [math.lgamma(v) for v in x], rtol=1e-12, atol=1e-12)
