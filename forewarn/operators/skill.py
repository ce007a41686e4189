"""Verification: confusion counts, skill ratios, threshold search, ROC, resampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.draws import binomial, uniform
from ..functions.scalar import norm_ppf, ratio
from .quantiles import levels_reached, running_totals
from .windows import along, earlier, past, whole


def confusion(df: DataFrame, keys: list[str], obs: str, pred: str) -> DataFrame:
    """TP, FP, TN, FN per key in one combinable aggregate."""
    o, p = F.col(obs), F.col(pred)

    def cell(a: int, b: int) -> Column:
        return F.count(F.when((o == a) & (p == b), 1))

    return df.groupBy(*keys).agg(cell(1, 1).alias("tp"), cell(0, 1).alias("fp"),
                                 cell(0, 0).alias("tn"), cell(1, 0).alias("fn"))


def skill_ratios(counts: DataFrame, places: int = 6) -> DataFrame:
    """POD, FAR, POFD and CSI; null where nothing can be said."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return counts.withColumns({
        "pod": F.round(ratio(tp, tp + fn), places), "far": F.round(ratio(fp, tp + fp), places),
        "pofd": F.round(ratio(fp, fp + tn), places),
        "csi": F.round(ratio(tp, tp + fp + fn), places)})


def class_scores(counts: DataFrame, places: int = 6) -> DataFrame:
    """Precision, recall, F1 and accuracy from confusion counts."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return counts.withColumns({
        "precision": F.round(ratio(tp, tp + fp), places),
        "recall": F.round(ratio(tp, tp + fn), places),
        "f1": F.round(ratio(2 * tp, 2 * tp + fp + fn), places),
        "accuracy": F.round(ratio(tp + tn, tp + fp + tn + fn), places)})


def weighted_scores(counts: DataFrame, places: int = 6) -> DataFrame:
    """Class-weighted F score, weighted accuracy (0.75 hit rate) and d-prime."""
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))
    n_pos, n_neg = tp + fn, tn + fp
    f_pos, f_neg = ratio(2 * tp, 2 * tp + fp + fn), ratio(2 * tn, 2 * tn + fp + fn)
    # (1/n_pos) / (1/n_pos + 1/n_neg) = n_neg / (n_pos + n_neg)
    w_pos, w_neg = ratio(n_neg, n_pos + n_neg), ratio(n_pos, n_pos + n_neg)
    hit, cr, fa = ratio(tp, n_pos), ratio(tn, n_neg), ratio(fp, n_neg)

    def inside(r: Column, n: Column) -> Column:
        return F.when(r == 0, F.lit(0.5) / n).when(r == 1, (n - 0.5) / n).otherwise(r)

    dprime = norm_ppf(inside(hit, n_pos)) - norm_ppf(inside(fa, n_neg))
    return counts.withColumns({
        "weight_pos": F.round(w_pos, places), "weight_neg": F.round(w_neg, places),
        "weighted_f": F.round(w_pos * f_pos + w_neg * f_neg, places),
        "wacc": F.round(F.lit(0.75) * hit + F.lit(0.25) * cr, places),
        "dprime": F.round(dprime, places)})


def _period_ratios(df: DataFrame, keep: list[str], places: int = 6) -> DataFrame:
    hits, starts, misses = F.col("hits"), F.col("starts"), F.col("misses")
    fa = starts - hits
    return df.select(
        *keep, hits.cast("bigint").alias("hits"), fa.cast("bigint").alias("false_alarms"),
        misses.cast("bigint").alias("misses"),
        F.round(ratio(hits, hits + misses), places).alias("pod"),
        F.round(ratio(fa, hits + fa), places).alias("far"),
        # correct negatives are forced to misses + hits
        F.round(ratio(fa, fa + misses + hits), places).alias("pofd"),
        F.round(ratio(hits, hits + fa + misses), places).alias("csi"))


def period_skill(df: DataFrame, keys: list[str], obs: str, pred: str, hits: str = "per_period",
                 date: str = "date") -> DataFrame:
    """Score stretches of predicted days as single warnings.

    ``per_period`` counts a stretch with events once, ``per_day`` every event day inside one; ``both`` gives a row for
    each, told apart by ``variant``, from one aggregate.
    """
    w = along(keys, date)
    prev = F.coalesce(F.lag(pred).over(w), F.lit(0))
    df = df.withColumn("_start", F.when((F.col(pred) == 1) & (prev == 0), 1).otherwise(0))
    df = df.withColumn("_no", F.sum("_start").over(past(keys, date)))
    both = (F.col(obs) == 1) & (F.col(pred) == 1)
    ways = {"per_period": F.count_distinct(F.when(both, F.col("_no"))), "per_day": F.count(F.when(both, 1))}
    chosen = list(ways) if hits == "both" else [hits]
    sums = df.groupBy(*keys).agg(
        *[ways[n].alias(f"_{n}") for n in chosen], F.sum("_start").alias("starts"),
        F.count(F.when((F.col(obs) == 1) & (F.col(pred) == 0), 1)).alias("misses"))
    if hits != "both":
        return _period_ratios(sums.withColumnRenamed(f"_{hits}", "hits"), keys)
    flat = sums.withColumn("_v", F.explode(F.array(*[
        F.struct(F.lit(n).alias("variant"), F.col(f"_{n}").alias("hits")) for n in chosen])))
    return _period_ratios(flat.select(*keys, "_v.variant", "_v.hits", "starts", "misses"), [*keys, "variant"])


def threshold_sweep(series: DataFrame, keys: list[str], value: str, event: str, levels: str,
                    percents: list[int], hits: str = "per_period", date: str = "date") -> DataFrame:
    """Period skill of every threshold without multiplying the days by the thresholds.

    A day reaches the lowest ``b`` of the ascending ``levels``. It starts a warning at the levels
    between yesterday's ``b`` and today's; an event is a hit of the levels up to ``b``, and the first
    one of its warning at those above the lowest day since the previous event. So days collapse to a
    small histogram per key, and only that is expanded to the thresholds.
    """
    w = along(keys, date)
    df = series.withColumn("_b", levels_reached(F.col(value), F.col(levels), len(percents)))
    df = df.withColumns({"_pb": F.coalesce(F.lag("_b").over(w), F.lit(0)),
                         "_seen": F.coalesce(F.sum(event).over(earlier(keys, date)),
                                             F.lit(0))})
    # "_low": lowest day from the previous event (included) up to today; -1 before the first event
    low = F.least(F.min("_b").over(past([*keys, "_seen"], date)),
                  F.first("_pb").over(past([*keys, "_seen"], date)))
    df = df.withColumn("_low", F.when(F.col("_seen") == 0, F.lit(-1)).otherwise(low))
    ev = F.col(event) == 1
    hist = df.groupBy(*keys, F.col("_pb"), F.col("_b"),
                      F.when(ev, F.col("_low")).alias("_low"), F.col(event).alias("_ev")
                      ).agg(F.count("*").alias("_n"))
    grid = F.array(*[F.struct(F.lit(i + 1).alias("k"), F.lit(p).alias("percent"))
                     for i, p in enumerate(sorted(percents))])
    flat = hist.withColumn("_g", F.explode(grid))
    k, n = F.col("_g.k"), F.col("_n")

    def total(cond: Column) -> Column:
        return F.sum(F.when(cond, n).otherwise(0))

    hit = (F.col("_ev") == 1) & (F.col("_b") >= k)
    if hits == "per_period":
        hit = hit & (F.col("_low") < k)
    sums = flat.groupBy(*keys, F.col("_g.percent").alias("percent")).agg(
        total(hit).alias("hits"), total((F.col("_pb") < k) & (F.col("_b") >= k)).alias("starts"),
        total((F.col("_ev") == 1) & (F.col("_b") < k)).alias("misses"))
    return _period_ratios(sums, [*keys, "percent"])


def roc_points(df: DataFrame, keys: list[str], label: str, score: str, pieces: int = 32) -> DataFrame:
    """Cumulative counts and rates after each distinct score, highest first."""
    pos = F.col(label).cast("bigint")
    cum = running_totals(df, keys, score, {"pos": F.sum(pos), "neg": F.sum(1 - pos)}, pieces, descending=True)
    totals = df.where(F.col(score).isNotNull()).groupBy(*keys).agg(F.sum(pos).alias("_p"), F.sum(1 - pos).alias("_n"))
    cum = cum.join(totals, keys)
    tp, fp = F.col("cum_pos"), F.col("cum_neg")
    return cum.select(
        *keys, score, F.col("pos"), F.col("neg"), tp.alias("tp"), fp.alias("fp"),
        F.round(ratio(tp, F.col("_p")), 6).alias("tpr"),
        F.round(ratio(fp, F.col("_n")), 6).alias("fpr"),
        F.round(ratio(tp, tp + fp), 6).alias("precision"))


def auc(points: DataFrame, keys: list[str]) -> DataFrame:
    """Area under the ROC curve; ties count half."""
    # the negatives tied with or above a score pair with the positives already above it
    above = F.col("tp") - F.col("pos")
    area = F.sum(F.col("neg") * (above + F.col("pos") / F.lit(2.0)))
    sums = points.groupBy(*keys).agg(area.alias("_a"), F.sum("pos").alias("n_pos"),
                                     F.sum("neg").alias("n_neg"))
    return sums.select(*keys, "n_pos", "n_neg",
                       F.round(ratio(F.col("_a"), F.col("n_pos") * F.col("n_neg")), 6).alias("auc"))


def confusion_with_auc(df: DataFrame, keys: list[str], label: str, pred: str, score: str) -> DataFrame:
    """Confusion counts and the area under the ROC curve from one histogram of the scores.

    ``pred`` must be the same for equal scores of a key, as a threshold on the score is. For series bounded by the
    calendar; raw rows take ``confusion`` and ``roc_points``.
    """
    event = F.col(label).cast("bigint")
    hist = df.groupBy(*keys, score).agg(F.sum(event).alias("_pos"), F.sum(1 - event).alias("_neg"),
                                        F.max(pred).alias("_hit"))
    above = F.sum("_pos").over(past(keys, [F.col(score).desc()])) - F.col("_pos")
    area = F.when(F.col(score).isNotNull(), F.col("_neg") * (above + F.col("_pos") / F.lit(2.0)))
    rows = hist.withColumn("_area", area)

    def total(column: str, hit: int) -> Column:
        return F.coalesce(F.sum(F.when(F.col("_hit") == hit, F.col(column))), F.lit(0))

    counts = rows.groupBy(*keys).agg(
        total("_pos", 1).alias("tp"), total("_neg", 1).alias("fp"), total("_neg", 0).alias("tn"),
        total("_pos", 0).alias("fn"), F.sum("_area").alias("_a"))
    pairs = (F.col("tp") + F.col("fn")) * (F.col("fp") + F.col("tn"))
    return counts.withColumn("auc", F.round(ratio(F.col("_a"), pairs), 6)).drop("_a")


def bootstrap_wacc(counts: DataFrame, keys: list[str], resamples: int = 1000,
                   seed: int = 7) -> DataFrame:
    """Bootstrap of the weighted accuracy.

    Resampling ``n`` confusion outcomes with replacement is a multinomial draw from the four counts: the events among
    them, the hits among the events, and the correct rejections among the rest. Each replicate costs three draws instead of ``n`` rows,
    and a draw depends on the seed, the key and its number alone.
    """
    reps = counts.withColumn("_rep", F.explode(F.sequence(F.lit(1), F.lit(resamples))))
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    n = tp + fp + tn + fn

    def u(name: str) -> Column:
        return uniform(seed, *[F.col(k) for k in keys], F.col("_rep"), F.lit(name))

    reps = reps.withColumn("_pos", binomial(n, ratio(tp + fn, n), u("events")))
    reps = reps.withColumns({"_tp": binomial(F.col("_pos"), ratio(tp, tp + fn), u("hits")),
                             "_tn": binomial(n - F.col("_pos"), ratio(tn, tn + fp), u("rejections"))})
    hit, cr = ratio(F.col("_tp"), F.col("_pos")), ratio(F.col("_tn"), n - F.col("_pos"))
    wacc = reps.select(*keys, (F.lit(0.75) * hit + F.lit(0.25) * cr).alias("w"))
    half = F.lit(1.962) * F.col("sd") / F.sqrt(F.lit(float(resamples)))
    return (wacc.groupBy(*keys).agg(F.avg("w").alias("mean"), F.stddev_samp("w").alias("sd"))
            .withColumns({"ci_low": F.col("mean") - half, "ci_high": F.col("mean") + half}))


def random_baseline(labels: DataFrame, keys: list[str], label: str, p: float = 0.5,
                    runs: int = 1000, seed: int = 7) -> DataFrame:
    """Scores of a coin-flipping classifier.

    Flipping a coin per row makes the true and false positives binomial in the class sizes; only
    those two counts per key are needed.
    """
    sizes = labels.groupBy(*keys).agg(F.count(F.when(F.col(label) == 1, 1)).alias("n_pos"),
                                      F.count(F.when(F.col(label) == 0, 1)).alias("n_neg"))
    reps = sizes.withColumn("_rep", F.explode(F.sequence(F.lit(1), F.lit(runs))))

    def flips(count: str, name: str) -> Column:
        return binomial(F.col(count), F.lit(p), uniform(seed, *[F.col(k) for k in keys], F.col("_rep"), F.lit(name)))

    drawn = reps.select(*keys, "n_pos", "n_neg", flips("n_pos", "tp").alias("_tp"), flips("n_neg", "fp").alias("_fp"))
    tp, fp = F.col("_tp"), F.col("_fp")
    fn, tn = F.col("n_pos") - tp, F.col("n_neg") - fp
    rows = F.array(
        F.struct(F.lit("positive").alias("class"), ratio(tp, tp + fp).alias("precision"),
                 ratio(tp, F.col("n_pos")).alias("recall"),
                 ratio(2 * tp, 2 * tp + fp + fn).alias("f1")),
        F.struct(F.lit("negative").alias("class"), ratio(tn, tn + fn).alias("precision"),
                 ratio(tn, F.col("n_neg")).alias("recall"),
                 ratio(2 * tn, 2 * tn + fp + fn).alias("f1")))
    flat = drawn.select(*keys, F.explode(rows).alias("r")).select(*keys, "r.*")
    aggs = []
    for m in ("precision", "recall", "f1"):
        aggs += [F.round(F.avg(m), 2).alias(m), F.round(F.stddev_samp(m), 2).alias(f"{m}_sd")]
    return flat.groupBy(*keys, "class").agg(*aggs)


def single_cue_counts(long: DataFrame, keys: list[str], cue: str, value: str,
                      label: str) -> DataFrame:
    """Confusion counts of every distinct cut of every cue: predict the event at or below it.

    For series bounded by the calendar.
    """
    by = [*keys, cue]
    pos = F.col(label).cast("bigint")
    cum = running_totals(long, by, value, {"pos": F.sum(pos), "neg": F.sum(1 - pos)}, pieces=1)
    g = whole(by, value)
    cum = cum.withColumns({"_p": F.sum("pos").over(g), "_n": F.sum("neg").over(g)})
    tp, fp = F.col("cum_pos"), F.col("cum_neg")
    return cum.select(*by, F.col(value).alias("cut"), tp.alias("tp"), fp.alias("fp"),
                      (F.col("_n") - fp).alias("tn"), (F.col("_p") - tp).alias("fn"))


def day_sweep(series: DataFrame, keys: list[str], value: str, event: str, levels: str,
              percents: list[int]) -> DataFrame:
    """Day-level confusion counts of every threshold from one histogram per key."""
    b = levels_reached(F.col(value), F.col(levels), len(percents))
    hist = series.groupBy(*keys, b.alias("_b"), F.col(event).alias("_ev")).agg(F.count("*").alias("_n"))
    grid = F.array(*[F.struct(F.lit(i + 1).alias("k"), F.lit(p).alias("percent"))
                     for i, p in enumerate(sorted(percents))])
    flat = hist.withColumn("_g", F.explode(grid))
    over = F.col("_b") >= F.col("_g.k")

    def total(cond: Column) -> Column:
        return F.sum(F.when(cond, F.col("_n")).otherwise(0)).cast("bigint")

    ev = F.col("_ev") == 1
    return flat.groupBy(*keys, F.col("_g.percent").alias("percent")).agg(
        total(ev & over).alias("tp"), total(~ev & over).alias("fp"),
        total(~ev & ~over).alias("tn"), total(ev & ~over).alias("fn"))


def leave_one_out_cue(long: DataFrame, keys: list[str], row: str, cue: str, value: str,
                      label: str) -> DataFrame:
    """Leave-one-out test of the best single cue and cut by weighted accuracy.

    Taking one row out changes the counts of a cut by one, on the side the row lies on. So the best cut
    below and the best at or above a value are running maxima over the cuts, computed once for each
    class; every held-out row looks its pair up instead of refitting. Ties go to the smaller cut, then
    to the cue first in the alphabet.
    """
    by = [*keys, cue]
    cuts = single_cue_counts(long, keys, cue, value, label)
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    pos, neg = tp + fn, tn + fp

    def wacc(t: Column, p: Column, c: Column, n: Column) -> Column:
        return (F.lit(0.75) * F.coalesce(ratio(t, p), F.lit(0.0))
                + F.lit(0.25) * F.coalesce(ratio(c, n), F.lit(0.0)))

    def best(score: Column, frame) -> Column:
        return F.max(F.struct(score.alias("w"), (-F.col("cut")).alias("c"))).over(frame)

    before = earlier(by, "cut")
    onward = past(by, [F.desc("cut")])
    sides = cuts.withColumns({
        "_lo1": best(wacc(tp, pos - 1, tn, neg), before),
        "_hi1": best(wacc(tp - 1, pos - 1, tn, neg), onward),
        "_lo0": best(wacc(tp, pos, tn - 1, neg - 1), before),
        "_hi0": best(wacc(tp, pos, tn, neg - 1), onward)})
    rows = long.where(F.col(value).isNotNull()).select(*by, row, F.col(value).alias("cut"), label)
    met = rows.join(sides, [*by, "cut"])
    lo = F.when(F.col(label) == 1, F.col("_lo1")).otherwise(F.col("_lo0"))
    hi = F.when(F.col(label) == 1, F.col("_hi1")).otherwise(F.col("_hi0"))
    met = met.withColumns({"_lo": lo, "_hi": hi})
    lower = F.col("_lo").isNotNull() & (F.col("_lo.w") >= F.col("_hi.w"))
    met = met.select(*keys, row, cue, label, F.when(lower, 0).otherwise(1).alias("pred"),
                     F.when(lower, F.col("_lo.w")).otherwise(F.col("_hi.w")).alias("w"))
    chosen = met.groupBy(*keys, row).agg(
        F.min_by(F.struct("pred", label), F.struct((-F.col("w")).alias("a"), F.col(cue).alias("b"))).alias("r"))
    counts = confusion(chosen.select(*keys, "r.*"), keys, label, "pred")
    p, n = tp + fn, tn + fp
    return counts.withColumns({
        "far": F.round(ratio(fp, n), 6), "ms": F.round(ratio(fn, p), 6), "cr": F.round(ratio(tn, n), 6),
        "hr": F.round(ratio(tp, p), 6), "npv": F.round(ratio(tn, tn + fn), 6),
        "ppv": F.round(ratio(tp, tp + fp), 6),
        "wacc": F.round(F.lit(0.75) * ratio(tp, p) + F.lit(0.25) * ratio(tn, n), 6)})
