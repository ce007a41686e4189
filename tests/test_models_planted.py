"""Models on planted data: what is planted is found, and is not found once the labels are shuffled."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from forewarn.operators import models as L
from forewarn.operators import skill as K

COLS = ["strong", "weak", "noise", "other"]


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(900, 4))
    y = (2.5 * x[:, 0] - 1.0 * x[:, 1] + rng.normal(scale=0.5, size=900) > 1.5).astype(int)
    rows = [(i, 2000 + i % 3, int(a), int(b), *map(float, v)) for i, (a, b, v) in enumerate(zip(y, rng.permutation(y), x))]
    return spark.createDataFrame(rows, "id long, year int, label int, shuffled int, " + ", ".join(f"{c} double" for c in COLS)).cache()


def f1(model, data, label):
    counts = K.confusion(L.predict(model, L.assemble(data, COLS)), [], label, "predicted")
    return K.class_scores(counts).first()["f1"] or 0.0


def test_sparse_logistic(planted):
    train, valid, test = (L.year_window(planted, "year", y, y + 1) for y in (2000, 2001, 2002))
    model, c, table = L.sparse_logistic(train, valid, COLS, "label", [0.03, 0.3, 3.0])
    assert f1(model, test, "label") > 0.7 and c in (0.03, 0.3, 3.0) and table.count() == 3
    weights = {r["feature"]: r["coefficient"] for r in L.coefficient_table(planted, model, COLS, 0.0).collect()}
    assert weights["strong"] > 3 * max(abs(weights["noise"]), abs(weights["other"])) and weights["weak"] < 0 < weights["strong"]
    path = {r["strength"]: r["f1_positive"] for r in table.collect()}
    assert path[c] == max(path.values())
    chance, _, _ = L.sparse_logistic(train, valid, COLS, "shuffled", [0.3])
    assert f1(chance, test, "shuffled") < 0.6


def test_loss_tree_trades_false_alarms_for_misses(planted):
    """A dear miss makes the tree predict the event more often: misses fall, false alarms rise."""
    counts = {}
    for cost in (0.1, 1.0, 10.0):
        pred = L.predict(L.loss_tree(planted, COLS, "label", cost, depth=3), L.assemble(planted, COLS))
        counts[cost] = K.confusion(pred, [], "label", "predicted").first()
    assert counts[0.1]["fn"] > counts[1.0]["fn"] > counts[10.0]["fn"]
    assert counts[0.1]["fp"] < counts[1.0]["fp"] < counts[10.0]["fp"]
    assert f1(L.loss_tree(planted, COLS, "label", 1.0), planted, "label") > 0.85 > f1(L.loss_tree(planted, COLS, "shuffled", 1.0, depth=3), planted, "shuffled")


def test_importances(planted):
    def shares(label):
        model = L.boosted_trees(planted, COLS, label, rounds=5, depth=2)
        return {r["feature"]: r["importance"] for r in L.importance_table(planted, model, COLS).collect()}
    own = shares("label")
    assert own["strong"] > 0.6 and own["strong"] > own["weak"] > max(own["noise"], own["other"])
    assert shares("shuffled")["strong"] < 0.6


def test_balance_weights(planted):
    sums = L.balance_weights(planted, "label").groupBy("label").agg(F.sum("weight").alias("w")).collect()
    assert all(abs(r["w"] - 1) < 1e-9 for r in sums) and len(sums) == 2


def test_seasonal_forecast_by_least_squares(spark):
    """The column solution is that of a least-squares fit of each window; a key with a short series has no forecast."""
    import datetime as dt
    rng = np.random.default_rng(4)
    dates = [dt.date(2000 + k // 12, k % 12 + 1, 1) for k in range(70)]
    y = 50 + 0.3 * np.arange(70) + 9 * np.sin(2 * np.pi * np.arange(1, 71) / 12) + rng.normal(size=70)
    rows = [("a", d, float(v)) for d, v in zip(dates, y)] + [("b", d, 1.0) for d in dates[:20]]
    got = {r["date"]: r["forecast"] for r in L.seasonal_forecast(spark.createDataFrame(rows, "k string, date date, v double"), ["k"], "v", 48).collect()}
    assert set(got) == set(dates[48:])
    angle = np.array([2 * np.pi * d.month / 12 for d in dates])
    x = np.column_stack([np.ones(70), np.arange(70.0), np.sin(angle), np.cos(angle), np.sin(2 * angle), np.cos(2 * angle)])
    for i in range(48, 70):
        beta, *_ = np.linalg.lstsq(x[i - 48:i], y[i - 48:i], rcond=None)
        assert got[dates[i]] == pytest.approx(x[i] @ beta, abs=1e-6)
