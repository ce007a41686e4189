"""Stratified folds, drawn parameter sets, and boosted trees searched or fitted for each key as parallel jobs."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.draws import hash_text, uniform
from ..session import cut_lineage, work_path
from .models import predict
from .series import spread
from .skill import class_scores, confusion
from .windows import along, past

#: What a set is drawn from: number of values, first value, step.
GRID = {"depth": (6, 1, 1), "child_weight": (20, 1, 1), "eta": (8, 0.3, 0.1), "gamma": (21, 0.0, 0.1)}


def stratified_rank(df: DataFrame, strata: list[str], rows: list[str], seed: int, out: str) -> DataFrame:
    """Place of each row, from 0, in the order of a seeded hash within its stratum.

    A stratum is cut into 256 ranges of the hash: rows are ranked within their range and the ranges' counts, a few rows, are added
    up in front, so no stratum is sorted by one task.
    """
    h = hash_text(seed, *[F.col(c) for c in rows])
    keyed = df.withColumns({"_h": h, "_part": F.substring(h, 1, 2)})
    counts = keyed.groupBy(*strata, "_part").agg(F.count("*").alias("_c"))
    before = counts.select(*strata, "_part", (F.sum("_c").over(past(strata, "_part")) - F.col("_c")).alias("_before"))
    place = F.row_number().over(along([*strata, "_part"], ["_h", *rows])) - 1
    return keyed.withColumn("_place", place).join(before, [*strata, "_part"]).withColumn(
        out, F.col("_before") + F.col("_place")).drop("_h", "_part", "_place", "_before")


def drawn_sets(spark: SparkSession, count: int, seed: int) -> DataFrame:
    """``count`` parameter sets, each value drawn by itself from its grid."""
    ids = spark.range(count).withColumnRenamed("id", "set")
    return ids.select("set", *[
        (F.floor(uniform(seed, F.col("set"), F.lit(name)) * n) * F.lit(step) + F.lit(first)).alias(name)
        for name, (n, first, step) in GRID.items()])


def classifier(p: dict, label: str, rounds: int, rows: int) -> GBTClassifier:
    """Child weight is the least number of rows of a leaf; gamma the least gain of a split, which the search counts over all rows
    and Spark for one."""
    return GBTClassifier(featuresCol="features", labelCol=label, maxIter=rounds, maxDepth=int(p["depth"]), stepSize=min(1.0, float(p["eta"])),
                         minInstancesPerNode=int(p["child_weight"]), minInfoGain=float(p["gamma"]) / max(1, rows), seed=123)


def in_parallel(task: Callable, items: Iterable, width: int = 8) -> list:
    """Results of driver-side jobs that do not depend on each other; Spark's scheduler shares the executors among them."""
    with ThreadPoolExecutor(width) as pool:
        return list(pool.map(task, items))


def search(train: DataFrame, sets: list[dict], label: str, fold: str, folds: int, rounds: int, rows: int) -> list[float]:
    """Mean recall over the held-out folds of each set, in order; a fold without events counts as zero."""
    def recall(work: tuple[dict, int]) -> float:
        p, f = work
        model = classifier(p, label, rounds, rows).fit(train.where(F.col(fold) != f))
        c = confusion(predict(model, train.where(F.col(fold) == f)), [], label, "predicted").first()
        return c["tp"] / (c["tp"] + c["fn"]) if c["tp"] + c["fn"] else 0.0

    found = in_parallel(recall, [(p, f) for p in sets for f in range(folds)])
    return [sum(found[i * folds:(i + 1) * folds]) / folds for i in range(len(sets))]


def split_and_folds(df: DataFrame, key: str, rows: list[str], label: str, test_share: float = 0.3, folds: int = 5, seed: int = 123) -> DataFrame:
    """``part`` (train or test) and ``fold``, both with the same share of each class within every key."""
    ranked = stratified_rank(df, [key, label], rows, seed, "_r")
    step = 10
    part = F.when(F.col("_r") % step < F.lit(round(test_share * step)), "test").otherwise("train")
    split = ranked.withColumn("part", part).drop("_r")
    again = stratified_rank(split, [key, "part", label], rows, seed + 1, "_r")
    return again.withColumn("fold", (F.col("_r") % folds).cast("int")).drop("_r")


def tuned_by_key(data: DataFrame, key: str, keys: list, cols: list[str], label: str, group: str, sets: int = 10,
                 rounds: int = 10, folds: int = 5, seed: int = 123) -> DataFrame:
    """Boosted trees for each of ``keys`` with the drawn set of best mean recall; scores on the training rows and, for each
    ``group``, on the test rows.

    ``data`` has ``part`` and ``fold``. All sets of all keys are fitted as jobs in parallel, every key reads its own rows of a table
    that is partitioned by key, and one row comes back from each fit.
    """
    spark = data.sparkSession
    path = work_path(spark, "tuning")
    data.select(key, group, "part", "fold", label, F.array(*[F.col(c).cast("double") for c in cols]).alias("_x")).write.partitionBy(key).parquet(path)
    table = spark.read.parquet(path).withColumn("features", array_to_vector("_x")).drop("_x")
    drawn = [r.asDict() for r in drawn_sets(spark, sets, seed).orderBy("set").collect()]

    def one(k) -> DataFrame:
        rows = table.where(F.col(key) == F.lit(k))
        train = rows.where("part = 'train'")
        size = train.count()
        recalls = search(train, drawn, label, "fold", folds, rounds, size)
        best = max(range(len(drawn)), key=lambda i: (recalls[i], -i))
        p = drawn[best]
        model = classifier(p, label, rounds, size).fit(train)
        told = predict(model, rows).select("part", label, "predicted", F.when(F.col("part") == "test", F.col(group)).alias(group))
        scores = class_scores(confusion(told, ["part", group], label, "predicted"))
        return scores.select(F.lit(k).alias(key), "part", group, *[F.lit(p[n]).cast("double").alias(n) for n in ("set", *GRID)],
                             F.lit(round(recalls[best], 6)).alias("cv_recall"), "tp", "fp", "tn", "fn", "precision", "recall", "f1", "accuracy")

    parts = in_parallel(one, keys, 4)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


#: Stations whose ids may be sent to every task.
MAX_STATIONS = 2_000_000


def station_matrix(days: DataFrame, zone: str, station: str, date: str, value: str, event: str, n_series: int = 0) -> DataFrame:
    """One row for each zone and day: the values of all the zone's stations in the order of their ids, 0 where one has none.

    Returns ``zone``, ``date``, ``label``, ``stations`` (ids), ``x`` (values) and ``weight``, which is n / n of the own class within
    the zone. Rows of a zone and day are as many as it has stations, several rows of a station count by their largest value.

    ``days`` are read once: the rows of a zone and day meet in one shuffle (to tasks for about ``n_series`` stations) and are written as sorted
    arrays. Ids and class sizes come from these, and a day that lacks stations is completed by one sort.
    """
    spark = days.sparkSession
    path = work_path(spark, "station-days")
    cells = spread(days, [zone, date], n_series).groupBy(zone, date, station).agg(F.max(value).alias("v"), F.max(event).alias("e"))
    pair = F.when(F.col(station).isNotNull(), F.struct(F.col(station).alias("s"), F.coalesce(F.col("v").cast("double"), F.lit(0.0)).alias("v")))
    met = cells.groupBy(zone, date).agg(F.max("e").cast("int").alias("label"), F.sort_array(F.collect_list(pair)).alias("_p"))
    met.select(zone, F.col(date).alias("date"), "label", F.col("_p.s").alias("_s"), F.col("_p.v").alias("_v")).write.parquet(path)
    wide = spark.read.parquet(path)
    known = cut_lineage(wide.select(zone, F.explode("_s").alias("_id")).distinct())
    few = known.limit(MAX_STATIONS + 1).count() <= MAX_STATIONS
    ids = known.groupBy(zone).agg(F.sort_array(F.collect_list("_id")).alias("stations"))
    sizes = wide.groupBy(zone, "label").agg(F.count("*").alias("_own"))
    weight = sizes.withColumn("weight", F.sum("_own").over(Window.partitionBy(zone)) / F.col("_own")).drop("_own")
    missing = F.transform(F.array_except("stations", "_s"), lambda s: F.struct(s.alias("s"), F.lit(0.0).alias("v")))
    whole = F.concat(F.arrays_zip(F.col("_s").alias("s"), F.col("_v").alias("v")), missing)
    x = F.when(F.size("_s") == F.size("stations"), F.col("_v")).otherwise(F.transform(F.sort_array(whole), lambda p: p["v"]))
    rows = wide.join(F.broadcast(ids) if few else ids, zone).join(F.broadcast(weight) if few else weight, [zone, "label"])
    return rows.select(zone, "label", "date", "stations", x.alias("x"), "weight")


#: Days of a zone that one task takes in a round of boosting. Every task adds a histogram of each station, so few days a task would make
#: more histograms than there are values.
DAYS_A_TASK = 2048


def trees_by_zone(matrix: DataFrame, zone: str, rounds: int = 10, depth: int = 3) -> tuple[DataFrame, DataFrame]:
    """Boosted trees of each zone on its station matrix: in-sample scores, and the importance of each station.

    Zones are a short list; each is fitted as a job of its own on its own partition, by as many tasks as its days ask for, and zones without
    both classes are left out.
    """
    spark = matrix.sparkSession
    path = work_path(spark, "matrix")
    known = matrix.groupBy(zone).agg(F.count_distinct("label").alias("n"), F.count("*").alias("days"), F.any_value("stations").alias("stations")).collect()
    tasks = max((-(-r["days"] // DAYS_A_TASK) for r in known), default=1)
    part = F.pmod(F.xxhash64("date"), F.lit(tasks))
    dealt = matrix.select(zone, "date", "label", "weight", "x", part.alias("_part")).repartition(max(1, len(known) * tasks), zone, "_part")
    # days in order: equal gains are told apart by rounding, which follows the order of the rows
    dealt.sortWithinPartitions(zone, "date").drop("_part", "date").write.partitionBy(zone).parquet(path)
    table = spark.read.schema(matrix.select("label", "weight", "x", zone).schema).parquet(path).withColumn("features", array_to_vector("x"))

    def one(r):
        z = r[zone]
        rows = table.where(F.col(zone) == F.lit(z)).coalesce(-(-r["days"] // DAYS_A_TASK))
        model = GBTClassifier(featuresCol="features", labelCol="label", weightCol="weight", maxIter=rounds, maxDepth=depth, seed=11).fit(rows)
        c = confusion(predict(model, rows), [], "label", "predicted").first()
        return (z, c["tp"], c["fp"], c["tn"], c["fn"]), [(z, s, float(v)) for s, v in zip(r["stations"], model.featureImportances.toArray())]

    found = in_parallel(one, sorted((r for r in known if r["n"] == 2 and r[zone] is not None), key=lambda r: r[zone]))
    kind = dict(matrix.dtypes)[zone]
    counts = spark.createDataFrame([c for c, _ in found], f"{zone} {kind}, tp bigint, fp bigint, tn bigint, fn bigint")
    station = matrix.schema["stations"].dataType.elementType.simpleString()
    weights = spark.createDataFrame([r for _, rows in found for r in rows], f"{zone} {kind}, station {station}, importance double")
    return class_scores(counts), weights
