"""Fast-and-frugal trees: a few ranked cues, one exit at each, tested by leaving rows out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import ratio
from .quantiles import running_totals
from .windows import along, whole

#: Share of the hit rate in the weighted accuracy; the rest is that of the correct rejections.
SENS_WEIGHT = 0.75


def wacc(tp: Column, pos: Column, tn: Column, neg: Column, weight: float = SENS_WEIGHT) -> Column:
    """Weighted accuracy; a class without rows adds nothing."""
    return (F.lit(weight) * F.coalesce(ratio(tp, pos), F.lit(0.0))
            + F.lit(1 - weight) * F.coalesce(ratio(tn, neg), F.lit(0.0)))


def below_quantiles(df: DataFrame, keys: list[str], target: str, percents: list[int], out: str = "label") -> DataFrame:
    """Rows once for each of ``percents``, with 1 where the target is at or below that quantile of its key.

    Quantiles are interpolated and belong to the key, so a key is a series bounded by the calendar. Rows without a
    target are left out.
    """
    rows = df.where(F.col(target).isNotNull())
    levels = rows.groupBy(*keys).agg(F.percentile(target, F.array(*[F.lit(p / 100.0) for p in percents])).alias("_t"))
    levels = levels.select(*keys, F.posexplode("_t").alias("_i", "_level")).withColumn(
        "percent", F.element_at(F.array(*[F.lit(p) for p in percents]), F.col("_i") + 1))
    flagged = (F.col(target) <= F.col("_level")).cast("int")
    return rows.join(levels, keys).withColumn(out, flagged).drop("_i", "_level")


def cue_rules(df: DataFrame, keys: list[str], cues: list[str], label: str, keep: int = 5,
              weight: float = SENS_WEIGHT, pieces: int = 1) -> DataFrame:
    """The best cut and direction of each cue by weighted accuracy, and the ``keep`` best cues of each key in order.

    A cue points to the event at or below its cut (direction 0) or above it (1); all distinct values are cuts. Both
    directions come from one running total. A missing value never points to the event. Ties go to direction 0, then to the
    smaller cut, then to the cue first in the alphabet. Returns ``rules``, an array of (place, cue, direction, cut, score).
    """
    y = F.col(label).cast("bigint")
    sizes = df.groupBy(*keys).agg(F.sum(y).alias("_p"), F.sum(1 - y).alias("_n"))
    long = df.select(*keys, label, *[F.col(c).cast("double").alias(c) for c in cues]).unpivot(
        [*keys, label], cues, "cue", "cut").where(F.col("cut").isNotNull())
    by = [*keys, "cue"]
    seen = long.groupBy(*by).agg(F.sum(y).alias("_sp"), F.sum(1 - y).alias("_sn"))
    cuts = running_totals(long, by, "cut", {"pos": F.sum(y), "neg": F.sum(1 - y)}, pieces=pieces)
    cuts = cuts.join(seen.join(sizes, keys), by)
    p, n = F.col("_p"), F.col("_n")
    low = wacc(F.col("cum_pos"), p, n - F.col("cum_neg"), n, weight)
    high = wacc(F.col("_sp") - F.col("cum_pos"), p, n - (F.col("_sn") - F.col("cum_neg")), n, weight)
    sides = F.array(*[F.struct(s.alias("score"), F.lit(-d).alias("d"), (-F.col("cut")).alias("c")) for d, s in ((0, low), (1, high))])
    best = cuts.groupBy(*by).agg(F.max(F.array_max(sides)).alias("b"))
    place = F.row_number().over(along(keys, [F.desc("b.score"), F.asc("cue")]))
    ranked = best.withColumn("place", place).where(F.col("place") <= keep)
    rule = F.struct("place", "cue", (-F.col("b.d")).alias("direction"), (-F.col("b.c")).alias("cut"), F.col("b.score").alias("score"))
    return ranked.groupBy(*keys).agg(F.sort_array(F.collect_list(rule)).alias("rules"))


def cue_bits(df: DataFrame, rules: DataFrame, keys: list[str], cues: list[str], keep: int = 5) -> DataFrame:
    """Bit k of ``bits`` is set where the cue in place k + 1 points to the event; ``n_rules`` cues take part."""
    met = df.join(rules, keys)
    bits = F.lit(0)
    for k in range(keep):
        rule = F.get(F.col("rules"), F.lit(k))
        value = F.coalesce(*[F.when(rule["cue"] == c, F.col(c).cast("double")) for c in cues])
        points = F.when(rule["direction"] == 0, value <= rule["cut"]).otherwise(value > rule["cut"])
        bits = bits + F.when(points, F.lit(1 << k)).otherwise(F.lit(0))
    return met.withColumns({"bits": bits, "n_rules": F.size("rules")}).drop("rules")


def exit_patterns(levels: int = 5) -> list[tuple[int, int, int]]:
    """All trees of up to ``levels`` cues as (cues, exits, prediction for each value of the bits as one whole number).

    Before the last cue a tree ends where the cue agrees with its exit bit, with the cue's answer; the last cue ends
    it either way.
    """
    trees = []
    for m in range(1, levels + 1):
        for exits in range(1 << (m - 1)):
            mask = 0
            for bits in range(1 << levels):
                ends = [k for k in range(m - 1) if (bits >> k & 1) == (exits >> k & 1)]
                mask |= (bits >> (ends[0] if ends else m - 1) & 1) << bits
            trees.append((m, exits, mask))
    return trees


def frugal_trees(df: DataFrame, keys: list[str], cues: list[str], label: str, levels: int = 5,
                 weight: float = SENS_WEIGHT, pieces: int = 1) -> DataFrame:
    """Leave-one-out scores of the best tree of at most 1 to ``levels`` cues, for each key.

    Cues, cuts and directions are ranked over the key's rows; then each row is left out, the tree with the best weighted
    accuracy over the others is chosen among all exit patterns, and the row is classified by it. A row is known by its
    cue bits and its label, so a key is a histogram of at most ``2 ** (levels + 1)`` counts, added up before the shuffle;
    every tree is scored from it, and a row is left out by taking one from its own count. Rows are never copied per tree or
    per row left out. Ties go to the tree with fewer cues, then to the smaller exit pattern.
    """
    rules = cue_rules(df, keys, cues, label, levels, weight, pieces)
    hist = cue_bits(df, rules, keys, cues, levels).groupBy(*keys, "bits", "n_rules", F.col(label).cast("int").alias("y")).agg(
        F.count("*").alias("n"))
    trees = F.explode(F.array(*[F.struct(F.lit(m).alias("m"), F.lit(e).alias("e"), F.lit(mask).cast("bigint").alias("mask"))
                                for m, e, mask in exit_patterns(levels)]))
    tried = hist.withColumn("t", trees).where(F.col("t.m") <= F.col("n_rules"))
    pred = F.call_function("shiftright", F.col("t.mask"), F.col("bits")).bitwiseAND(F.lit(1)).cast("int")
    tried = tried.select(*keys, "bits", "y", "n", "t.m", "t.e", pred.alias("pred"))
    w = whole([*keys, "m", "e"])
    y, n, hit = F.col("y"), F.col("n"), F.col("pred") == F.col("y")
    tried = tried.withColumns({"_p": F.sum(y * n).over(w), "_n": F.sum((1 - y) * n).over(w),
                               "_tp": F.sum(F.when(hit & (y == 1), n).otherwise(0)).over(w),
                               "_tn": F.sum(F.when(hit & (y == 0), n).otherwise(0)).over(w)})
    own = hit.cast("int")
    score = wacc(F.col("_tp") - y * own, F.col("_p") - y, F.col("_tn") - (1 - y) * own, F.col("_n") - (1 - y), weight)
    choice = F.struct(score.alias("score"), (-F.col("m")).alias("m"), (-F.col("e")).alias("e"), "pred")
    chosen = tried.groupBy(*keys, "bits", "y", "n").agg(*[
        F.max(F.when(F.col("m") <= a, choice)).alias(f"_{a}") for a in range(1, levels + 1)])
    flat = chosen.withColumn("c", F.explode(F.array(*[
        F.struct(F.lit(a).alias("levels"), F.col(f"_{a}.pred").alias("pred")) for a in range(1, levels + 1)])))
    flat = flat.select(*keys, "c.levels", "c.pred", "y", "n")

    def cell(a: int, b: int) -> Column:
        return F.sum(F.when((F.col("y") == a) & (F.col("pred") == b), F.col("n")).otherwise(0))

    return detection_scores(flat.groupBy(*keys, "levels").agg(
        cell(1, 1).alias("tp"), cell(0, 1).alias("fp"), cell(0, 0).alias("tn"), cell(1, 0).alias("fn")), weight)


def detection_scores(counts: DataFrame, weight: float = SENS_WEIGHT, places: int = 6) -> DataFrame:
    """False alarm, miss, correct rejection and hit rates, predictive values and weighted accuracy."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    scores = {"far": ratio(fp, fp + tn), "ms": ratio(fn, tp + fn), "cr": ratio(tn, fp + tn), "hr": ratio(tp, tp + fn),
              "npv": ratio(tn, tn + fn), "ppv": ratio(tp, tp + fp),
              "wacc": F.lit(weight) * ratio(tp, tp + fn) + F.lit(1 - weight) * ratio(tn, fp + tn)}
    return counts.withColumns({k: F.round(v, places) for k, v in scores.items()})
