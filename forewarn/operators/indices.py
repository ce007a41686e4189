"""Standardised values, climatologies and drought indices."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import gamma_fn, log_gamma, norm_ppf
from .rolling import rolling_trailing
from .windows import along, whole


def min_max(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Scale to [0, 1] within the key; null on a constant series."""
    g = whole(keys)
    lo, hi = F.min(value).over(g), F.max(value).over(g)
    return df.withColumn(out, F.try_divide(F.col(value) - lo, hi - lo))


def z_score(df: DataFrame, keys: list[str], value: str, out: str, sd: str = "sample") -> DataFrame:
    """Standardise within the key.

    ``sample`` is null for a constant series; ``population`` gives 0 there, as a scaler does.
    """
    g = whole(keys)
    centred = F.col(value) - F.avg(value).over(g)
    if sd == "sample":
        return df.withColumn(out, F.try_divide(centred, F.stddev_samp(value).over(g)))
    spread = F.stddev_pop(value).over(g)
    return df.withColumn(out, F.when(spread == 0, F.lit(0.0)).otherwise(F.try_divide(centred, spread)))


def climatology_anomaly(df: DataFrame, keys: list[str], value: str, period: Column) -> DataFrame:
    """Climatology over the years per key and calendar period, anomaly and scaled anomaly.

    The climatology is a small aggregate (keys x periods) joined back, not a window over raw rows.
    """
    df = df.withColumn("period", period)
    clim = df.groupBy(*keys, "period").agg(F.avg(value).alias("climatology"),
                                           F.stddev_samp(value).alias("clim_sd"))
    out = df.join(clim, [*keys, "period"])
    out = out.withColumn("anomaly", F.col(value) - F.col("climatology"))
    return out.withColumn("anomaly_scaled", F.try_divide(F.col("anomaly"), F.col("clim_sd")))


def accumulated(monthly: DataFrame, keys: list[str], value: str, scales: list[int], date: str = "date") -> DataFrame:
    """Sums over the last ``scale`` months for every scale: a row for each month and scale, all windows on one sort."""
    for n in scales:
        monthly = rolling_trailing(monthly, keys, value, f"_acc{n}", n, "sum", True, date)
    each = F.array(*[F.struct(F.lit(n).alias("scale"), F.col(f"_acc{n}").alias("acc")) for n in scales])
    return (monthly.withColumn("_s", F.explode(F.filter(each, lambda s: s["acc"].isNotNull())))
            .withColumns({"scale": F.col("_s.scale"), "acc": F.col("_s.acc"), "month": F.month(date)})
            .drop("_s", *[f"_acc{n}" for n in scales]))


def spi(monthly: DataFrame, keys: list[str], value: str, scales: list[int], date: str = "date") -> DataFrame:
    """Standardised precipitation index of every scale: gamma distribution per key, scale and calendar month.

    The sums over each scale's months are fitted by the closed-form maximum-likelihood approximation from two
    averages; zeros keep their own probability mass.
    """
    from ..functions.fits import gamma_cdf

    @F.pandas_udf("double")
    def cdf(a: pd.Series, x: pd.Series, lg: pd.Series) -> pd.Series:
        return pd.Series(gamma_cdf(*(c.to_numpy(float, na_value=np.nan) for c in (a, x, lg))))

    df = accumulated(monthly, keys, value, scales, date)
    g = whole([*keys, "scale", "month"])
    pos = F.when(F.col("acc") > 0, F.col("acc"))
    mean, log_mean = F.avg(pos).over(g), F.avg(F.ln(pos)).over(g)
    df = df.withColumns({"_a": F.ln(mean) - log_mean, "_m": mean,
                         "_q": F.avg((F.col("acc") <= 0).cast("double")).over(g)})
    shape = F.when(F.col("_a") > 0, (F.lit(1.0) + F.sqrt(F.lit(1.0) + F.lit(4.0) * F.col("_a") / 3.0))
                   / (F.lit(4.0) * F.col("_a")))
    df = df.withColumn("_shape", shape)
    x = F.try_divide(F.col("acc") * F.col("_shape"), F.col("_m"))
    df = df.withColumn("_g", cdf(F.col("_shape"), x, log_gamma(F.col("_shape") + 1)))
    p = F.col("_q") + (F.lit(1.0) - F.col("_q")) * F.col("_g")
    return df.withColumn("spi", norm_ppf(p)).drop("_a", "_m", "_q", "_shape", "_g")


def spei(monthly: DataFrame, keys: list[str], balance: str, scales: list[int],
         date: str = "date") -> DataFrame:
    """Standardised precipitation-evapotranspiration index of every scale: log-logistic by L-moments.

    Probability-weighted moments of each key, scale and calendar month are plain window averages, so the
    whole index is one native plan.
    """
    df = accumulated(monthly, keys, balance, scales, date)
    by = [*keys, "scale", "month"]
    g, x = whole(by), F.col("acc")
    df = df.withColumns({"_r": F.row_number().over(along(by, ["acc", date])),
                         "_n": F.count(F.lit(1)).over(g)})
    r, n = F.col("_r"), F.col("_n")
    down = F.try_divide((n - r).cast("double"), (n - 1).cast("double"))
    down2 = F.try_divide(((n - r) * (n - r - 1)).cast("double"), ((n - 1) * (n - 2)).cast("double"))
    df = df.withColumns({"_w0": F.avg(x).over(g), "_w1": F.avg(down * x).over(g),
                         "_w2": F.sum(down2 * x).over(g) / n})
    w0, w1, w2 = F.col("_w0"), F.col("_w1"), F.col("_w2")
    beta = F.try_divide(2 * w1 - w0, 6 * w1 - w0 - 6 * w2)
    df = df.withColumn("_beta", F.when(beta > 1, beta))
    b = F.col("_beta")
    df = df.withColumn("_gg", gamma_fn(1 + 1 / b) * gamma_fn(1 - 1 / b))
    df = df.withColumn("_alpha", (w0 - 2 * w1) * b / F.col("_gg"))
    df = df.withColumn("_origin", w0 - F.col("_alpha") * F.col("_gg"))
    above = x - F.col("_origin")
    p = F.when(above > 0, 1 / (1 + F.pow(F.try_divide(F.col("_alpha"), above), b))).when(
        above <= 0, F.lit(0.0))
    return df.withColumn("spei", norm_ppf(p)).drop(
        "_r", "_n", "_w0", "_w1", "_w2", "_beta", "_gg", "_alpha", "_origin")
