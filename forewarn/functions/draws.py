"""Random numbers that depend only on a seed and the place they are drawn for, in plain column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalar import norm_ppf, once

#: From this variance on a binomial draw takes the rounded normal quantile; below it the distribution is added up.
NORMAL_FROM = 25.0


def hash_text(seed: int, *parts: Column) -> Column:
    """Hexadecimal MD5 of the seed and the parts: the same in every engine and for every partitioning."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]).cast("binary"))


def uniform(seed: int, *parts: Column) -> Column:
    """Random number inside (0, 1): the middle of one of 2**32 equal steps."""
    step = F.conv(F.substring(hash_text(seed, *parts), 1, 8), 16, 10).cast("bigint")
    return (step + F.lit(0.5)) / F.lit(float(1 << 32))


def binomial(n: Column, p: Column, u: Column) -> Column:
    """Binomial quantile of ``u``: successes of ``n`` trials with chance ``p`` (null counts as 0).

    The rarer outcome is counted. Its distribution is added up from zero, at most some twelve deviations beyond the mean; where
    its variance is 25 or more the normal quantile is rounded, which is off by less than one.
    """
    chance = F.coalesce(p, F.lit(0.0))

    def drawn(v: Column) -> Column:
        count, q, x = v["n"], F.least(v["p"], 1 - v["p"]), v["u"]
        mean = count * q
        wide = F.greatest(F.lit(0), F.least(count, F.floor(mean + norm_ppf(x) * F.sqrt(mean * (1 - q)) + 0.5)))
        most = F.least(count, F.floor(mean + 12 * F.sqrt(mean + 1)) + 10)
        steps = F.when(most >= 1, F.sequence(F.lit(1).cast("bigint"), most)).otherwise(F.array().cast("array<bigint>"))
        none = F.exp(count * F.ln(1 - q))
        start = F.struct(none.alias("pmf"), none.alias("cdf"), F.lit(0).cast("bigint").alias("k"))

        def add(s: Column, j: Column) -> Column:
            pmf = s["pmf"] * (count - j + 1) / j * q / (1 - q)
            return F.when(s["cdf"] >= x, s).otherwise(F.struct(pmf.alias("pmf"), (s["cdf"] + pmf).alias("cdf"), j.alias("k")))

        k = F.when(mean * (1 - q) >= NORMAL_FROM, wide).otherwise(F.aggregate(steps, start, add, lambda s: s["k"]))
        return F.when(v["p"] > 0.5, count - k).otherwise(k)

    return once(F.struct(n.cast("bigint").alias("n"), chance.alias("p"), u.alias("u")), drawn)
