"""Exact quantiles, running totals and block maxima."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import half_up, once
from ..session import cut_lineage
from .joining import join_dimension
from .windows import along, past, whole


def block_maxima(df: DataFrame, keys: list[str], value: str, block: Column, name: str = "block",
                 out: str = "block_max") -> DataFrame:
    """Maximum per key and block (year, half-year ...)."""
    return df.groupBy(*keys, block.alias(name)).agg(F.max(value).alias(out))


def thresholds(df: DataFrame, keys: list[str], value: str, percents: list[int],
               decimals: int = 6) -> DataFrame:
    """Long table ``(keys, percent, threshold)`` of linearly interpolated quantiles.

    Meant for series already collapsed to the calendar: ``percentile`` keeps the distinct values of
    one key in memory. For raw rows use :func:`quantiles_of_rows`.
    """
    probs = F.array(*[F.lit(p / 100.0) for p in percents])
    wide = df.groupBy(*keys).agg(F.percentile(value, probs).alias("_q"))
    pairs = F.arrays_zip(F.array(*[F.lit(p) for p in percents]).alias("percent"),
                         F.col("_q").alias("threshold"))
    return (wide.select(*keys, F.explode(pairs).alias("_p"))
            .select(*keys, F.col("_p.percent").alias("percent"),
                    F.round(F.col("_p.threshold"), decimals).alias("threshold")))


def with_levels(df: DataFrame, keys: list[str], value: str, percents: list[int],
                decimals: int = 6, out: str = "levels", date: str = "date") -> DataFrame:
    """The same thresholds as one ascending array on every row of the series.

    A whole-series window reuses the partitioning and sort of the series; nothing is read twice or
    joined.
    """
    probs = F.array(*[F.lit(p / 100.0) for p in sorted(percents)])
    df = df.withColumn(out, F.percentile(value, probs).over(whole(keys, date)))
    return df.withColumn(out, F.transform(out, lambda x: half_up(x, decimals)))


def levels_reached(value: Column, levels: Column, n: int) -> Column:
    """How many of ``n`` ascending levels a value reaches; 0 for a missing one.

    A few levels are a sum of comparisons, which is compiled; many are found by bisection, since a
    method with dozens of comparisons is too long for the JVM to compile.
    """
    if n <= 12:
        hits = F.lit(0)
        for i in range(n):
            hits = hits + F.when(value >= levels[i], 1).otherwise(0)
        return hits

    def half(step: int):
        return lambda p: p + F.when(value >= F.get(levels, p + (step - 1)), step).otherwise(0)

    found, step = F.lit(0), 1 << (n.bit_length() - 1)
    while step:
        found, step = once(found, half(step)), step // 2
    return found


def _pieces(df: DataFrame, keys: list[str], order: str, pieces: int) -> DataFrame:
    """Number contiguous pieces of every key along ``order``, cut at approximate quantiles.

    The cuts come from sketches combined before the shuffle and are kept as a small table, one short
    array per key; rows are not shuffled to get their number while that table is small.
    """
    cuts = [i / pieces for i in range(1, pieces)]
    bounds = cut_lineage(df.groupBy(*keys).agg(
        F.percentile_approx(order, cuts, 10 * pieces).alias("_cuts")))
    piece = levels_reached(F.col(order), F.col("_cuts"), pieces - 1)
    return join_dimension(df, bounds, keys, max_rows=20_000).withColumn("_piece", piece).drop("_cuts")


def running_totals(df: DataFrame, keys: list[str], order: str, sums: dict[str, Column],
                   pieces: int = 32, descending: bool = False) -> DataFrame:
    """Sums per distinct ``order`` value and their inclusive running totals ``cum_...``.

    No key is put into one task: each is cut into contiguous ``pieces``, the piece totals (a handful of
    rows per key) are accumulated first and added as an offset to the sums within the piece. Use
    ``pieces=1`` for series bounded by the calendar, where a plain window is cheaper.
    """
    step = F.col(order).desc() if descending else F.col(order).asc()
    named = [c.alias(n) for n, c in sums.items()]
    rows = df.where(F.col(order).isNotNull())
    if pieces == 1:
        inner = past(keys, [step])
        return rows.groupBy(*keys, order).agg(*named).withColumns(
            {f"cum_{n}": F.sum(n).over(inner) for n in sums})
    cut = _pieces(rows, keys, order, pieces)
    if descending:
        cut = cut.withColumn("_piece", -F.col("_piece"))
    counts = cut.groupBy(*keys, "_piece", order).agg(*named)
    totals = counts.groupBy(*keys, "_piece").agg(*[F.sum(n).alias(f"_t_{n}") for n in sums])
    w = past(keys, "_piece")
    offsets = totals.select(*keys, "_piece", *[
        (F.sum(f"_t_{n}").over(w) - F.col(f"_t_{n}")).alias(f"_o_{n}") for n in sums])
    inner = past([*keys, "_piece"], [step])
    joined = counts.join(offsets, [*keys, "_piece"])
    return (joined.withColumns({f"cum_{n}": F.col(f"_o_{n}") + F.sum(n).over(inner) for n in sums})
            .drop("_piece", *[f"_o_{n}" for n in sums]))


#: Size of a key's sketch; its rank error is then 0.14 %, and four times that is left on either side of a wanted rank.
SKETCH = 2000
MARGIN = 4 * 2.296 / SKETCH ** 0.9723


def quantiles_of_rows(df: DataFrame, keys: list[str], value: str, percents: list[int],
                      decimals: int = 6, max_keys: int = 100_000) -> DataFrame:
    """Exact interpolated quantiles of raw rows, safe for a key that holds most of the table.

    One scan builds a mergeable sketch per key, which says between which two values a wanted rank must lie. A second scan counts what lies
    outside (a few rows a task) and keeps only the values inside, about one in a hundred for each percent, so the ranking window sees a small part
    of a key. Should a rank lie outside its bounds, which the error of the sketch makes all but impossible, the query fails instead
    of giving a wrong value. Nothing runs while the plan is built. The bounds, two numbers for each key and percent, go to every task: the
    query fails beyond ``max_keys`` keys, for which :func:`thresholds` is meant.
    """
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    asked = sorted(percents)

    def ranks(sign: int) -> Column:
        return F.array(*[F.lit(min(1.0, max(0.0, p / 100.0 + sign * MARGIN))) for p in asked])

    sketches = rows.groupBy(*keys).agg(F.kll_sketch_agg_double("_v", SKETCH).alias("_s"), F.count("*").alias("_total"),
                                       F.min("_v").alias("_min"), F.max("_v").alias("_max"))
    # a margin that reaches beyond the first or last rank takes everything on that side; one of a few rows takes the whole key
    few = F.col("_total") * MARGIN < 4
    lo = F.transform(F.kll_sketch_get_quantile_double("_s", ranks(-1)), lambda x, i: F.when(few | (F.get(ranks(-1), i) <= 0), F.col("_min")).otherwise(x))
    hi = F.transform(F.kll_sketch_get_quantile_double("_s", ranks(1)), lambda x, i: F.when(few | (F.get(ranks(1), i) >= 1), F.col("_max")).otherwise(x))
    bounds = sketches.select(*keys, "_total", lo.alias("_lo"), hi.alias("_hi"))
    allowed = F.count("*").over(Window.partitionBy(F.lit(1))) <= max_keys
    bounds = bounds.withColumn("_ok", F.assert_true(allowed, F.lit(f"more than {max_keys} keys"))).where("_ok IS NULL").drop("_ok")
    met = rows.join(F.broadcast(bounds), keys)
    v = F.col("_v")
    inside = F.lit(False)
    below = F.lit(float("-inf"))
    for i in range(len(asked)):
        inside = inside | ((v >= F.get("_lo", F.lit(i))) & (v <= F.get("_hi", F.lit(i))))
        below = F.when(v > F.get("_hi", F.lit(i)), F.get("_hi", F.lit(i))).otherwise(below)
    # what lies outside stands right behind the largest bound below it
    kept = met.select(*keys, "_total", F.when(inside, v).otherwise(below).alias("_at"), F.when(inside, 0).otherwise(1).alias("_out"))
    counts = kept.groupBy(*keys, "_total", "_at", "_out").agg(F.count("*").alias("_n"))
    ranked = counts.withColumn("_cum", F.sum("_n").over(past(keys, ["_at", "_out"])))

    def position(p: int) -> Column:
        return (F.col("_total") - 1) * F.lit(p / 100.0)

    place = F.struct("_at", "_out")
    picks = []
    for p in asked:
        picks += [F.min(F.when(F.col("_cum") > F.floor(position(p)), place)).alias(f"_a{p}"),
                  F.min(F.when(F.col("_cum") > F.ceil(position(p)), place)).alias(f"_b{p}")]
    found = ranked.groupBy(*keys).agg(F.first("_total").alias("_total"), *picks)
    sure = F.lit(True)
    cells = []
    for p in asked:
        sure = sure & (F.col(f"_a{p}._out") == 0) & (F.col(f"_b{p}._out") == 0)
        share = position(p) - F.floor(position(p))
        level = F.col(f"_a{p}._at") + (F.col(f"_b{p}._at") - F.col(f"_a{p}._at")) * share
        cells.append(F.struct(F.lit(p).alias("percent"), F.round(level, decimals).alias("threshold")))
    found = found.withColumn("_ok", F.assert_true(sure, F.lit("a rank lies outside the bounds of its sketch"))).where("_ok IS NULL")
    return (found.select(*keys, F.explode(F.array(*cells)).alias("_r"))
            .select(*keys, "_r.percent", "_r.threshold"))


def l_moments(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """First three L-moments of each key's block maxima (bounded by the number of blocks)."""
    ranked = df.withColumns({"_r": F.row_number().over(along(keys, value)),
                             "_n": F.count(F.lit(1)).over(whole(keys))})
    r, n, x = F.col("_r"), F.col("_n"), F.col(value)
    b1 = F.sum(F.try_divide(r - 1, n - 1) * x) / F.count("*")
    b2 = F.sum(F.try_divide((r - 1) * (r - 2), (n - 1) * (n - 2)) * x) / F.count("*")
    sums = ranked.groupBy(*keys).agg(F.avg(x).alias("_b0"), b1.alias("_b1"), b2.alias("_b2"),
                                     F.count("*").alias("n"))
    return sums.select(*keys, "n", F.col("_b0").alias("l1"),
                       (2 * F.col("_b1") - F.col("_b0")).alias("l2"),
                       (6 * F.col("_b2") - 6 * F.col("_b1") + F.col("_b0")).alias("l3"))


def gev_parameters(moments: DataFrame) -> DataFrame:
    """Extreme-value parameters from L-moments (Hosking's approximation of the shape)."""
    from ..functions.scalar import gamma_fn
    c = F.lit(2.0) / (F.lit(3.0) + F.col("l3") / F.col("l2")) - F.lit(math.log(2) / math.log(3))
    m = moments.where((F.col("n") >= 3) & (F.col("l2") > 0))
    m = m.withColumn("shape", F.lit(7.8590) * c + F.lit(2.9554) * c * c)
    m = m.withColumn("_g", gamma_fn(F.lit(1.0) + F.col("shape")))
    m = m.withColumn("scale", F.col("l2") * F.col("shape")
                     / ((F.lit(1.0) - F.pow(F.lit(2.0), -F.col("shape"))) * F.col("_g")))
    loc = F.col("l1") - F.col("scale") * (F.lit(1.0) - F.col("_g")) / F.col("shape")
    return m.withColumn("location", loc).drop("_g")


def return_levels(params: DataFrame, keys: list[str], periods: list[int]) -> DataFrame:
    """Long table ``(keys, period, level)``."""
    rows = []
    for t in periods:
        y = -math.log(1 - 1 / t)
        lvl = F.col("location") + F.col("scale") * (
            F.lit(1.0) - F.pow(F.lit(y), F.col("shape"))) / F.col("shape")
        rows.append(F.struct(F.lit(t).alias("period"), F.round(lvl, 6).alias("level")))
    return (params.select(*keys, F.explode(F.array(*rows)).alias("_r"))
            .select(*keys, "_r.period", "_r.level"))


def gumbel_levels(maxima: DataFrame, keys: list[str], value: str, periods: list[int]) -> DataFrame:
    """Gumbel return levels from the first two L-moments."""
    m = l_moments(maxima, keys, value).where(F.col("n") >= 2)
    scale = F.col("l2") / F.lit(math.log(2))
    loc = F.col("l1") - scale * F.lit(0.5772156649015329)
    rows = [F.struct(F.lit(t).alias("period"),
                     F.round(loc - scale * F.lit(math.log(-math.log(1 - 1 / t))), 6).alias("level"))
            for t in periods]
    return (m.select(*keys, F.explode(F.array(*rows)).alias("_r"))
            .select(*keys, "_r.period", "_r.level"))


#: Keys whose fits take their steps together.
FITTED = 4096


def gev_likelihood_levels(maxima: DataFrame, keys: list[str], value: str,
                          periods: list[int]) -> DataFrame:
    """Return levels with a 95 % interval from a maximum-likelihood fit per key.

    A key's rows are its block maxima, one per year, so a key is a short vector, and a task fits many keys at a time. The vectors are
    few bytes for much work, so the number of tasks is that of the cores and not left to the size of the shuffle.
    """
    from ..functions.fits import gev_levels
    heads = maxima.select(*keys).schema.fields
    schema = T.StructType([*heads, T.StructField("period", T.IntegerType()), *(T.StructField(n, T.DoubleType()) for n in ("low", "estimate", "high")),
                           T.StructField("converged", T.BooleanType())])
    tasks = 2 * maxima.sparkSession.sparkContext.defaultParallelism
    vectors = maxima.repartition(tasks, *keys).groupBy(*keys).agg(F.sort_array(F.collect_list(F.col(value).cast("double"))).alias("_x"))

    def fit(batches):
        for whole_batch in batches:
            for a in range(0, whole_batch.num_rows, FITTED):
                b = whole_batch.slice(a, FITTED)
                x = [v[~np.isnan(v)] for v in (np.array(r, float) for r in b.column("_x").to_pylist())]
                levels, met = np.empty((len(x), len(periods), 3)), np.empty(len(x), bool)
                sizes = np.array([len(v) for v in x])
                for n in np.unique(sizes):
                    at = np.flatnonzero(sizes == n)
                    levels[at], met[at] = gev_levels(np.stack([x[i] for i in at]), periods)
                key = np.repeat(np.arange(len(x)), len(periods))
                flat = levels.reshape(-1, 3)
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(k).take(pa.array(key)) for k in keys), pa.array(np.tile(np.array(periods, np.int32), len(x))),
                     *(pa.array(flat[:, i], from_pandas=True) for i in range(3)), pa.array(met[key])], schema.names)

    return vectors.mapInArrow(fit, schema)
