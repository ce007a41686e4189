"""Column expressions shared by the operators. All stay in the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients of the rational approximation of the inverse normal distribution.
PPF_A = (-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02,
         1.383577518672690e+02, -3.066479806614716e+01, 2.506628277459239e+00)
PPF_B = (-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02,
         6.680131188771972e+01, -1.328068155288572e+01)
PPF_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00,
         -2.549732539343734e+00, 4.374664141464968e+00, 2.938163982698783e+00)
PPF_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00,
         3.754408661907416e+00)
PPF_LOW = 0.02425

# Lanczos coefficients of the gamma function (g = 7, nine terms).
LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313,
           -176.61502916214059, 12.507343278686905, -0.13857109526572012,
           9.9843695780195716e-6, 1.5056327351493116e-7)

EARTH_RADIUS_KM = 6371.0088


def nan_to_null(c: Column) -> Column:
    """NaN sorts above every number in Spark and would win ``max``; treat it as missing."""
    return F.when(~F.isnan(c), c)


def half_up(c: Column, places: int) -> Column:
    """Round half up on the scaled value, the same on every IEEE engine."""
    scale = float(10 ** places)
    return F.floor(c * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def ratio(num: Column, den: Column) -> Column:
    """Division that gives null, never an error or infinity, on a zero denominator."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def add_missing(a: Column, b: Column) -> Column:
    """``a + b`` where a missing ``b`` counts as nothing."""
    return a + F.coalesce(b, F.lit(0))


def once(c: Column, body) -> Column:
    """``body(c)`` with ``c`` evaluated once, however often the body mentions it.

    Without the binding the optimizer copies ``c`` into every mention, and nested formulas grow beyond
    what it can handle.
    """
    return F.transform(F.array(c), body)[0]


def _poly(coefs, x: Column) -> Column:
    out = F.lit(coefs[0])
    for c in coefs[1:]:
        out = out * x + F.lit(c)
    return out


def norm_ppf(p: Column) -> Column:
    """Inverse of the standard normal distribution; null outside (0, 1)."""
    return once(p.cast("double"), _norm_ppf)


def _norm_ppf(p: Column) -> Column:
    one = F.lit(1.0)

    def central(q: Column) -> Column:
        return once(q * q, lambda r: _poly(PPF_A, r) * q / (_poly(PPF_B, r) * r + one))

    def tail(x: Column) -> Column:
        return once(F.sqrt(F.lit(-2.0) * F.ln(x)),
                    lambda q: _poly(PPF_C, q) / (_poly(PPF_D, q) * q + one))

    return (F.when((p <= 0) | (p >= 1), F.lit(None).cast("double"))
            .when(p < PPF_LOW, tail(p))
            .when(p <= 1 - PPF_LOW, central(p - F.lit(0.5)))
            .otherwise(-tail(one - p)))


def _gamma_upper(x: Column) -> Column:
    y = x - F.lit(1.0)
    series = F.lit(LANCZOS[0])
    for i, c in enumerate(LANCZOS[1:], start=1):
        series = series + F.lit(c) / (y + F.lit(float(i)))
    t = y + F.lit(7.5)
    return F.lit(math.sqrt(2 * math.pi)) * F.pow(t, y + F.lit(0.5)) * F.exp(-t) * series


def gamma_fn(x: Column) -> Column:
    """Gamma function; the reflection formula covers arguments below one half."""
    def body(v: Column) -> Column:
        low = F.lit(math.pi) / (F.sin(F.lit(math.pi) * v) * _gamma_upper(F.lit(1.0) - v))
        return F.when(v < 0.5, low).otherwise(_gamma_upper(v))

    return once(x.cast("double"), body)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance."""
    dlat = F.radians(lat2 - lat1) / 2
    dlon = F.radians(lon2 - lon1) / 2
    a = (F.pow(F.sin(dlat), F.lit(2.0))
         + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon), F.lit(2.0)))
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def ring_edges(ring: Column) -> Column:
    """Edges (``a``, ``b``) of a closed ring (``ARRAY<STRUCT<x, y>>``); a ring of fewer than two points has none."""
    starts = F.slice(ring, F.lit(1), F.greatest(F.size(ring) - 1, F.lit(0)))
    return F.transform(starts, lambda p, i: F.struct(p.alias("a"), F.get(ring, i + 1).alias("b")))


def inside_edges(x: Column, y: Column, edges: Column) -> Column:
    """Ray casting: odd crossings are inside. The edges may come from several rings, so holes and separate parts need
    no rule of their own."""
    def crossing(e: Column) -> Column:
        a, b = e["a"], e["b"]
        spans = (a["y"] > y) != (b["y"] > y)
        at = F.try_divide((b["x"] - a["x"]) * (y - a["y"]), b["y"] - a["y"]) + a["x"]
        return F.when(spans & (x < at), F.lit(1)).otherwise(F.lit(0))

    return F.aggregate(edges, F.lit(0), lambda acc, e: acc + crossing(e)) % 2 == 1


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Whether a point lies inside a closed ring."""
    return inside_edges(x, y, ring_edges(ring))


def parse_date(c: Column, *formats: str) -> Column:
    """First format that fits; null when none does."""
    text = F.trim(c.cast("string"))
    return F.coalesce(*[F.try_to_date(text, f) for f in formats])


def build_date(y: Column, m: Column, d: Column) -> Column:
    """Date from parts; null for impossible ones such as 31 February."""
    parts = F.concat_ws("-", y.cast("string"), F.lpad(m.cast("string"), 2, "0"),
                        F.lpad(d.cast("string"), 2, "0"))
    complete = y.isNotNull() & m.isNotNull() & d.isNotNull()
    return F.when(complete, F.try_to_date(parts, "yyyy-MM-dd"))


def event_interval(sy: Column, sm: Column, sd: Column,
                   ey: Column, em: Column, ed: Column) -> tuple[Column, Column, Column]:
    """Start, end and middle of an event whose day or month may be missing.

    A missing start day is the first of the month, a missing end day the last; a missing end month
    takes the start month.
    """
    one = F.lit(1)
    start = F.coalesce(build_date(sy, F.coalesce(sm, one), F.coalesce(sd, one)),
                       build_date(sy, F.coalesce(sm, one), one))
    e_year = F.coalesce(ey, sy)
    e_month = F.coalesce(em, sm, F.lit(12))
    month_end = F.last_day(build_date(e_year, e_month, one))
    end = F.coalesce(build_date(e_year, e_month, ed), month_end)
    middle = F.date_add(start, F.floor(F.datediff(end, start) / 2).cast("int"))
    return start, end, middle


def crop_year(d: Column, first_month: int = 7) -> Column:
    """Season year: months from ``first_month`` on belong to the next harvest."""
    return F.year(d) + F.when(F.month(d) >= first_month, 1).otherwise(0)


def season_code(d: Column) -> Column:
    """1 for March to May, 2 for July to September, 3 otherwise."""
    m = F.month(d)
    return F.when(m.isin(3, 4, 5), 1).when(m.isin(7, 8, 9), 2).otherwise(3)


def overlap_band(pct: Column) -> Column:
    """Class of an overlap percentage."""
    return (F.when(pct > 80, "very high").when(pct > 60, "high").when(pct > 40, "medium")
            .when(pct > 20, "low").otherwise("very low"))


def log_gamma(x: Column) -> Column:
    """Log gamma for ``x > 0``: Stirling's series above 10, reached by the recurrence."""
    z = x + 10
    inv = 1 / z
    series = inv / 12 - F.pow(inv, 3) / 360 + F.pow(inv, 5) / 1260 - F.pow(inv, 7) / 1680 + F.pow(inv, 9) / 1188
    steps = sum((F.ln(x + k) for k in range(1, 10)), F.ln(x))
    return F.when(x > 0, (z - 0.5) * F.ln(z) - z + 0.9189385332046727 + series - steps)


def half_year(d: Column) -> Column:
    """Half-year block number ``2 * year + {0, 1}``."""
    return F.year(d) * 2 + F.when(F.month(d) > 6, 1).otherwise(0)


def members_over(members: Column, level: Column) -> Column:
    """Percentage of ensemble members above ``level``, by the actual member count."""
    over = F.size(F.filter(members, lambda x: x > level))
    return ratio(over * 100, F.size(members))


def array_mean(a: Column) -> Column:
    """Mean of an array."""
    total = F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    return ratio(total, F.size(a))


def array_median(a: Column) -> Column:
    """Median of an array without nulls."""
    s = F.array_sort(a)
    n = F.size(a)
    lo = F.element_at(s, F.floor((n + 1) / 2).cast("int")).cast("double")
    hi = F.element_at(s, F.floor(n / 2).cast("int") + 1).cast("double")
    return F.when(n > 0, (lo + hi) / 2)
