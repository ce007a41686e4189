"""Impact models on ``pyspark.ml`` and per-zone baseline forecasts."""

from __future__ import annotations

import math

from pyspark.ml import Pipeline
from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassifier, LinearSVC,
                                       LogisticRegression, RandomForestClassifier)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .skill import class_scores, confusion
from .windows import along


def assemble(df: DataFrame, cols: list[str]) -> DataFrame:
    """Feature vector column; rows with a missing feature are left out."""
    return VectorAssembler(inputCols=cols, outputCol="features", handleInvalid="skip").transform(df)


def balance_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """Weight 1/n of the own class, from one two-row aggregate joined back."""
    sizes = df.groupBy(label).agg((F.lit(1.0) / F.count("*")).alias(out))
    return df.join(sizes, label)


def hash_folds(df: DataFrame, keys: list[str], folds: int, out: str = "fold", salt: int | None = None) -> DataFrame:
    """Reproducible fold number from the row keys, independent of partitioning; another ``salt`` gives folds that have
    nothing to do with a split made before."""
    head = [] if salt is None else [F.lit(salt)]
    h = F.pmod(F.xxhash64(*head, *[F.col(k) for k in keys]), F.lit(folds))
    return df.withColumn(out, h.cast("int"))


def year_window(df: DataFrame, year: str, first: int, last: int) -> DataFrame:
    """Rows with ``first <= year < last``."""
    return df.where((F.col(year) >= first) & (F.col(year) < last))


def sparse_logistic(train: DataFrame, valid: DataFrame, cols: list[str], label: str,
                    strengths: list[float]):
    """L1 logistic regression with class weights; the inverse strength is chosen by positive F1.

    Weights add up to 2, so an inverse strength ``C`` is the penalty ``1 / (2 C)``. Returns the fitted
    model, the chosen ``C`` and the validation table.
    """
    fit_on = balance_weights(assemble(train, cols), label)
    check = assemble(valid, cols)
    best, scores = None, []
    for c in strengths:
        model = LogisticRegression(featuresCol="features", labelCol=label, weightCol="weight",
                                   elasticNetParam=1.0, regParam=1.0 / (2.0 * c), maxIter=100).fit(fit_on)
        row = class_scores(confusion(predict(model, check), [], label, "predicted")).first()
        f1 = row["f1"] if row["f1"] is not None else 0.0
        scores.append((float(c), float(f1)))
        if best is None or f1 > best[2]:
            best = (model, c, f1)
    table = train.sparkSession.createDataFrame(scores, "strength double, f1_positive double")
    return best[0], best[1], table


def predict(model, data: DataFrame) -> DataFrame:
    """Predictions with an integer class and, where the model has one, the positive score."""
    out = model.transform(data).withColumn("predicted", F.col("prediction").cast("int"))
    if "probability" in out.columns:
        from pyspark.ml.functions import vector_to_array
        out = out.withColumn("score", vector_to_array("probability")[1])
    return out


def coefficient_table(df: DataFrame, model, cols: list[str], least: float = 0.01) -> DataFrame:
    """Coefficients of at least ``least`` in size; one row per model feature."""
    rows = [(c, float(v)) for c, v in zip(cols, model.coefficients) if abs(v) >= least]
    return df.sparkSession.createDataFrame(rows, "feature string, coefficient double")


def importance_table(df: DataFrame, model, cols: list[str]) -> DataFrame:
    """Feature importances of a tree model; one row per model feature."""
    rows = [(c, float(v)) for c, v in zip(cols, model.featureImportances.toArray())]
    return df.sparkSession.createDataFrame(rows, "feature string, importance double")


def boosted_trees(train: DataFrame, cols: list[str], label: str, rounds: int = 10, depth: int = 3):
    """Boosted trees with inverse-frequency weights."""
    data = balance_weights(assemble(train, cols), label)
    return GBTClassifier(featuresCol="features", labelCol=label, weightCol="weight", maxIter=rounds,
                         maxDepth=depth, seed=11).fit(data)


def tuned_trees(train: DataFrame, cols: list[str], label: str, keys: list[str],
                depths=(2, 3), step_sizes=(0.1,), least_rows=(3,), gains=(0.0,), rounds: int = 5,
                folds: int = 3):
    """Boosted trees tuned on true, held-out folds by the recall of the events."""
    data = hash_folds(balance_weights(assemble(train, cols), label), keys, folds, salt=1)
    gbt = GBTClassifier(featuresCol="features", labelCol=label, weightCol="weight", maxIter=rounds,
                        seed=11)
    grid = (ParamGridBuilder().addGrid(gbt.maxDepth, list(depths)).addGrid(gbt.stepSize, list(step_sizes))
            .addGrid(gbt.minInstancesPerNode, list(least_rows)).addGrid(gbt.minInfoGain, list(gains)).build())
    judge = MulticlassClassificationEvaluator(labelCol=label, metricName="recallByLabel", metricLabel=1.0)
    return CrossValidator(estimator=gbt, estimatorParamMaps=grid, evaluator=judge, numFolds=folds,
                          foldCol="fold", parallelism=2).fit(data).bestModel


def loss_tree(train: DataFrame, cols: list[str], label: str, miss_cost: float = 1.0, depth: int = 5):
    """Classification tree in which a miss costs ``miss_cost`` false alarms."""
    data = assemble(train, cols).withColumn(
        "weight", F.when(F.col(label) == 1, F.lit(float(miss_cost))).otherwise(F.lit(1.0)))
    return DecisionTreeClassifier(featuresCol="features", labelCol=label, weightCol="weight",
                                  maxDepth=depth, minInstancesPerNode=3, seed=11).fit(data)


def compare_classifiers(df: DataFrame, cols: list[str], label: str, keys: list[str],
                        folds: int = 5) -> DataFrame:
    """Cross-validated scores of the L1 logistic, linear SVM and random forest classifiers."""
    data = hash_folds(assemble(df, cols), keys, folds)
    kinds = {
        "lasso": LogisticRegression(featuresCol="features", labelCol=label, elasticNetParam=1.0,
                                    regParam=0.01, maxIter=30),
        "linear_svm": LinearSVC(featuresCol="features", labelCol=label, maxIter=50),
        "random_forest": RandomForestClassifier(featuresCol="features", labelCol=label, numTrees=20,
                                                maxDepth=4, seed=11),
    }
    scored = None
    for name, est in kinds.items():
        for f in range(folds):
            model = est.fit(data.where(F.col("fold") != f))
            part = predict(model, data.where(F.col("fold") == f)).select(
                F.lit(name).alias("model"), F.col(label), "predicted")
            scored = part if scored is None else scored.unionByName(part)
    return class_scores(confusion(scored, ["model"], label, "predicted"))


def linear_monitor(df: DataFrame, coefs: dict[str, float], intercept: float) -> DataFrame:
    """Linear score of standardised features; a positive score predicts drought next month."""
    score = F.lit(float(intercept))
    for c, v in coefs.items():
        score = score + F.col(c) * F.lit(float(v))
    return df.withColumn("score", score).withColumn(
        "drought_predicted", (F.col("score") > 0).cast("int")).withColumn(
        "date", F.add_months("date", 1))


def seasonal_forecast(monthly: DataFrame, keys: list[str], value: str, train: int = 48,
                      date: str = "date") -> DataFrame:
    """Rolling-origin one-month forecasts of a level, a trend and two yearly harmonics for every key.

    Each origin is a least-squares fit to the ``train`` rows before it. Sums of the products of its terms over that
    window are all a fit needs, so all origins of a key come from one sort; time is counted from the forecast row, which shifts
    the sums, and the normal equations are solved row by row by a Cholesky factor in column expressions. Rows with fewer than
    ``train`` rows before them have no forecast and are left out.
    """
    order = along(keys, date)
    angle = F.month(date) * F.lit(2 * math.pi / 12)
    terms = {"0": F.lit(1.0), "1": F.row_number().over(order).cast("double"), "2": F.sin(angle), "3": F.cos(angle),
             "4": F.sin(2 * angle), "5": F.cos(2 * angle), "y": F.col(value).cast("double")}
    rows = monthly.select(*keys, date, F.col(value).cast("double").alias("actual"), *[c.alias(f"_x{n}") for n, c in terms.items()])
    names = list(terms)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:] if (a, b) != ("y", "y")]
    window = order.rowsBetween(-train, -1)
    sums = rows.withColumns({f"_s{a}{b}": F.sum(F.col(f"_x{a}") * F.col(f"_x{b}")).over(window) for a, b in pairs}).where(F.col("_x1") > train)

    def raw(a: str, b: str) -> Column:
        return F.col(f"_s{min(a, b)}{max(a, b)}")

    now = F.col("_x1")

    def moved(a: str, b: str) -> Column:
        """Sum of products with time counted from the forecast row."""
        if a == b == "1":
            return raw("1", "1") - 2 * now * raw("0", "1") + now * now * raw("0", "0")
        if "1" in (a, b):
            other = b if a == "1" else a
            return raw("1", other) - now * raw("0", other)
        return raw(a, b)

    six = names[:6]
    work = sums.withColumns({f"_a{a}{b}": moved(a, b) for a, b in pairs})
    # L and L^-1 X'y, a column of the factor at a time
    for j in range(6):
        square = F.col(f"_a{j}{j}") - sum((F.col(f"_l{j}{k}") ** 2 for k in range(j)), F.lit(0.0))
        work = work.withColumn(f"_l{j}{j}", F.sqrt(square))
        below = {f"_l{i}{j}": (F.col(f"_a{j}{i}") - sum((F.col(f"_l{i}{k}") * F.col(f"_l{j}{k}") for k in range(j)), F.lit(0.0))) / F.col(f"_l{j}{j}")
                 for i in range(j + 1, 6)}
        z = (F.col(f"_a{j}y") - sum((F.col(f"_l{j}{k}") * F.col(f"_z{k}") for k in range(j)), F.lit(0.0))) / F.col(f"_l{j}{j}")
        work = work.withColumns({**below, f"_z{j}": z})
    for j in reversed(range(6)):
        work = work.withColumn(f"_b{j}", (F.col(f"_z{j}") - sum((F.col(f"_l{k}{j}") * F.col(f"_b{k}") for k in range(j + 1, 6)), F.lit(0.0))) / F.col(f"_l{j}{j}"))
    forecast = sum((F.col(f"_b{n}") * F.col(f"_x{n}") for n in six if n != "1"), F.lit(0.0))
    return work.select(*keys, date, "actual", forecast.alias("forecast"))
