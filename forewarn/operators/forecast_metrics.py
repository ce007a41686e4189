"""Forecast accuracy measures of an actual and a predicted series, all in one aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .windows import along, whole

# The guard against division by zero and the names of the measures.
EPSILON = 1e-10

NAMES = ["mse", "rmse", "nrmse", "me", "mae", "mad", "gmae", "mdae", "mpe", "mape", "mdape", "smape",
         "smdape", "maape", "mase", "std_ae", "std_ape", "rmspe", "rmdspe", "rmsse", "inrse", "rrse",
         "mre", "rae", "mrae", "mdrae", "gmrae", "mbrae", "umbrae", "mda"]


def forecast_metrics(df: DataFrame, keys: list[str], actual: str, predicted: str,
                     date: str = "date", season: int = 1, metrics: list[str] | None = None,
                     places: int | None = None) -> DataFrame:
    """One row per key with the chosen measures (all thirty by default).

    Relative measures compare with the value ``season`` steps earlier and skip the first ones; a
    measure that is undefined for a key is null.
    """
    metrics = metrics or NAMES
    unknown = set(metrics) - set(NAMES)
    if unknown:
        raise ValueError(f"unknown metrics: {sorted(unknown)}")
    w, g = along(keys, date), whole(keys)
    a, p = F.col(actual).cast("double"), F.col(predicted).cast("double")
    e = a - p
    base = df.where(a.isNotNull() & p.isNotNull()).select(
        *keys, a.alias("_a"), e.alias("_e"), F.abs(e).alias("_ae"),
        F.try_divide(e, a + EPSILON).alias("_pe"),
        F.try_divide(2.0 * F.abs(e), F.abs(a) + F.abs(p) + EPSILON).alias("_sp"),
        (a - F.lag(a, season).over(w)).alias("_nd"),
        (F.signum(a - F.lag(a, 1).over(w)) == F.signum(p - F.lag(p, 1).over(w)))
        .cast("double").alias("_same"),
        F.avg(a).over(g).alias("_mean"))
    nd, ae, pe = F.col("_nd"), F.col("_ae"), F.col("_pe")
    base = base.withColumns({
        "_re": F.when(nd.isNotNull(), F.try_divide(F.col("_e"), nd + EPSILON)),
        "_bre": F.when(nd.isNotNull(), F.try_divide(ae, ae + F.abs(nd) + EPSILON))})
    ere = F.abs(F.col("_re"))

    def med(c: Column) -> Column:
        return F.percentile(c, F.lit(0.5))

    def geo(c: Column) -> Column:
        # one exact zero makes the geometric mean zero
        zero = F.max(F.when(c == 0, 1).otherwise(0)) == 1
        return F.when(zero, F.lit(0.0)).otherwise(F.exp(F.avg(F.ln(F.when(c > 0, c)))))

    n = F.count(F.lit(1))
    sq = F.sum(F.col("_e") * F.col("_e"))
    mae, mape = F.avg(ae), F.avg(F.abs(pe))
    naive = F.avg(F.abs(nd))
    dev = F.col("_a") - F.col("_mean")
    inrse = F.sqrt(F.try_divide(sq, F.sum(dev * dev)))
    mbrae = F.avg("_bre")
    # sum((e - m)^2) expanded, so that no second pass over the rows is needed
    var_ae = sq - 2 * mae * F.sum("_e") + n * mae * mae
    var_ape = F.sum(pe * pe) - 2 * mape * F.sum(pe) + n * mape * mape
    exprs = {
        "mse": sq / n, "rmse": F.sqrt(sq / n),
        "nrmse": F.try_divide(F.sqrt(sq / n), F.max("_a") - F.min("_a")),
        "me": F.avg("_e"), "mae": mae, "mad": mae, "gmae": geo(ae), "mdae": med(ae),
        "mpe": F.avg(pe), "mape": mape, "mdape": med(F.abs(pe)),
        "smape": F.avg("_sp"), "smdape": med(F.col("_sp")), "maape": F.avg(F.atan(F.abs(pe))),
        "mase": F.try_divide(mae, naive),
        "std_ae": F.sqrt(F.try_divide(F.greatest(var_ae, F.lit(0.0)), (n - 1).cast("double"))),
        "std_ape": F.sqrt(F.try_divide(F.greatest(var_ape, F.lit(0.0)), (n - 1).cast("double"))),
        "rmspe": F.sqrt(F.avg(pe * pe)), "rmdspe": F.sqrt(med(pe * pe)),
        "rmsse": F.try_divide(F.sqrt(sq / n), naive), "inrse": inrse, "rrse": inrse,
        "mre": F.avg("_re"), "rae": F.try_divide(F.sum(ae), F.sum(F.abs(dev)) + EPSILON),
        "mrae": F.avg(ere), "mdrae": med(ere), "gmrae": geo(ere), "mbrae": mbrae,
        "umbrae": F.try_divide(mbrae, 1 - mbrae), "mda": F.avg("_same"),
    }
    chosen = [(F.round(exprs[m], places) if places is not None else exprs[m]).alias(m)
              for m in metrics]
    return base.groupBy(*keys).agg(*chosen)
