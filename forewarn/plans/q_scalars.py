"""Scalar function queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from . import domain as D
from .registry import query


def ppf_sql(p: str) -> str:
    """The rational approximation of the inverse normal distribution as SQL."""
    def poly(cs, x):
        out = f"({cs[0]!r})"
        for c in cs[1:]:
            out = f"({out} * {x} + ({c!r}))"
        return out

    r = f"(({p} - 0.5) * ({p} - 0.5))"
    central = f"({poly(S.PPF_A, r)} * ({p} - 0.5) / ({poly(S.PPF_B, r)} * {r} + 1.0))"

    def tail(q):
        return f"({poly(S.PPF_C, q)} / ({poly(S.PPF_D, q)} * {q} + 1.0))"

    lo, hi = f"sqrt(-2.0 * ln({p}))", f"sqrt(-2.0 * ln(1.0 - {p}))"
    return (f"CASE WHEN {p} <= 0 OR {p} >= 1 THEN NULL WHEN {p} < {S.PPF_LOW} THEN {tail(lo)} "
            f"WHEN {p} <= {1 - S.PPF_LOW} THEN {central} ELSE -{tail(hi)} END")


@query("f01_text_cleanup", """
SELECT p_partkey, lower(p_name) AS low, upper(p_name) AS up, replace(p_name, 'e', 'é') AS accented,
  substr(p_name, 1, 3) AS head, right(p_name, 3) AS tail, lpad(CAST(p_partkey AS VARCHAR), 6, '0') AS code,
  CASE WHEN p_size > 25 THEN 'ET0' || p_brand ELSE p_brand END AS prefixed FROM part""")
def _(spark, sf):
    n = F.col("p_name")
    return D.table(spark, sf, "part").select(
        "p_partkey", F.lower(n).alias("low"), F.upper(n).alias("up"), F.replace(n, F.lit("e"), F.lit("é")).alias("accented"),
        F.substring(n, 1, 3).alias("head"), F.right(n, F.lit(3)).alias("tail"),
        F.lpad(F.col("p_partkey").cast("string"), 6, "0").alias("code"),
        F.when(F.col("p_size") > 25, F.concat(F.lit("ET0"), "p_brand")).otherwise(F.col("p_brand")).alias("prefixed"))


@query("f02_split_and_fix", """
SELECT p_partkey, split_part(p_name, ' ', 1) AS first_word, split_part(p_name, ' ', 2) AS second_word,
  regexp_replace(p_name || '_st_districts', '_st_districts$', '') AS base,
  CASE p_type WHEN 'SMALL' THEN 'Small (S)' WHEN 'LARGE' THEN 'Large-L' ELSE p_type END AS fixed FROM part""")
def _(spark, sf):
    words = F.split("p_name", " ")
    fixes = F.create_map(F.lit("SMALL"), F.lit("Small (S)"), F.lit("LARGE"), F.lit("Large-L"))
    return D.table(spark, sf, "part").select(
        "p_partkey", words[0].alias("first_word"), F.coalesce(F.try_element_at(words, F.lit(2)), F.lit("")).alias("second_word"),
        F.regexp_replace(F.concat("p_name", F.lit("_st_districts")), "_st_districts$", "").alias("base"),
        F.coalesce(F.try_element_at(fixes, F.col("p_type")), F.col("p_type")).alias("fixed"))


@query("f03_regex_extract", """
SELECT station, CAST(regexp_extract(file, '_(\\d{8})\\.', 1) AS VARCHAR) AS day8,
  CAST(regexp_extract(file, 'lat(-?[0-9.]+)_', 1) AS DOUBLE) AS lat, CAST(regexp_extract(file, 'lon(-?[0-9.]+)_', 1) AS DOUBLE) AS lon
FROM (SELECT station, 'grid_lat' || iy || '.5_lon' || ix || '.25_' || (19950101 + station) || '.tif' AS file FROM station_places)""")
def _(spark, sf):
    s = lambda c: F.col(c).cast("string")
    name = F.concat(F.lit("grid_lat"), s("iy"), F.lit(".5_lon"), s("ix"), F.lit(".25_"),
                    (F.col("station") + 19950101).cast("string"), F.lit(".tif"))
    files = D.station_places(spark, sf).select("station", name.alias("file"))
    return files.select(
        "station", F.regexp_extract("file", r"_(\d{8})\.", 1).alias("day8"),
        F.regexp_extract("file", r"lat(-?[0-9.]+)_", 1).try_cast("double").alias("lat"),
        F.regexp_extract("file", r"lon(-?[0-9.]+)_", 1).try_cast("double").alias("lon"))


@query("f04_category_flags", """
SELECT p_partkey, CASE WHEN regexp_matches(p_type, 'ECON|STAND') THEN 1 ELSE 0 END AS basic,
  CASE WHEN regexp_matches(p_name, '(ring|bolt)$') THEN 1 ELSE 0 END AS fastener FROM part""")
def _(spark, sf):
    return D.table(spark, sf, "part").select(
        "p_partkey", F.col("p_type").rlike("ECON|STAND").cast("int").alias("basic"),
        F.col("p_name").rlike("(ring|bolt)$").cast("int").alias("fastener"))


@query("f05_parse_dates", """
SELECT report, date, CAST(date AS DATE) AS iso, CAST(date AS DATE) AS dmy,
  try_cast(year(date) || '-' || lpad(CAST(month(date) AS VARCHAR), 2, '0') || '-31' AS DATE) AS day31,
  last_day(date) AS month_end FROM all_reports""")
def _(spark, sf):
    fmts = ("yyyy-MM-dd", "dd/MM/yyyy", "MMM d, yyyy")
    return D.reports(spark, sf).select(
        "report", "date", S.parse_date(F.date_format("date", "MMM d, yyyy"), *fmts).alias("iso"),
        S.parse_date(F.date_format("date", "dd/MM/yyyy"), *fmts).alias("dmy"),
        S.build_date(F.year("date"), F.month("date"), F.lit(31)).alias("day31"), F.last_day("date").alias("month_end"))


@query("f06_event_interval", """
WITH r AS (SELECT report, year(date) AS y, CASE WHEN report % 5 = 0 THEN NULL ELSE month(date) END AS m,
  CASE WHEN report % 3 = 0 THEN NULL ELSE day(date) END AS d FROM all_reports),
i AS (SELECT report, make_date(y, coalesce(m, 1), coalesce(CASE WHEN m IS NULL AND d > 28 THEN 28 ELSE d END, 1)) AS s,
  last_day(make_date(y, coalesce(m, 12), 1)) AS e FROM r)
SELECT report, s AS start_date, e AS end_date, s + CAST(floor((e - s) / 2) AS INTEGER) AS mid_date FROM i""")
def _(spark, sf):
    none = F.lit(None).cast("int")
    m = F.when(F.col("report") % 5 != 0, F.month("date"))
    d = F.when(F.col("report") % 3 != 0, F.dayofmonth("date"))
    d = F.when(m.isNull() & (d > 28), 28).otherwise(d)
    s, e, mid = S.event_interval(F.year("date"), m, d, none, none, none)
    return D.reports(spark, sf).select("report", s.alias("start_date"), e.alias("end_date"), mid.alias("mid_date"))


@query("f07_date_parts", """
SELECT report, year(date) AS y, month(date) AS m, day(date) AS d, strftime(date, '%d/%m/%Y') AS text,
  CAST(date + INTERVAL 1 MONTH AS DATE) AS next_month, date - DATE '1995-01-01' AS age_days FROM all_reports""")
def _(spark, sf):
    return D.reports(spark, sf).select(
        "report", F.year("date").alias("y"), F.month("date").alias("m"), F.dayofmonth("date").alias("d"),
        F.date_format("date", "dd/MM/yyyy").alias("text"), F.add_months("date", 1).alias("next_month"),
        F.datediff("date", F.lit("1995-01-01").cast("date")).alias("age_days"))


@query("f08_safe_cast", """
SELECT p_partkey, coalesce(try_cast(replace(p_brand, 'Brand#', '') AS DOUBLE), -1) AS brand_no,
  coalesce(try_cast(p_type AS DOUBLE), 0) AS type_no FROM part""")
def _(spark, sf):
    return D.table(spark, sf, "part").select(
        "p_partkey", F.coalesce(F.replace("p_brand", F.lit("Brand#"), F.lit("")).try_cast("double"), F.lit(-1.0)).alias("brand_no"),
        F.coalesce(F.col("p_type").try_cast("double"), F.lit(0.0)).alias("type_no"))


@query("f09_null_tolerant_add", """
SELECT zone, date, z.value, e.severity, z.value + coalesce(e.severity, 0) AS total FROM zone_months z
LEFT JOIN (SELECT zone, CAST(date_trunc('month', date) AS DATE) AS date, max(severity) AS severity FROM impact_reports GROUP BY 1, 2) e USING (zone, date)""")
def _(spark, sf):
    e = D.events(spark, sf).groupBy("zone", F.trunc("date", "month").alias("date")).agg(F.max("severity").alias("severity"))
    return D.zone_months(spark, sf).join(e, ["zone", "date"], "left").select(
        "zone", "date", "value", "severity", S.add_missing(F.col("value"), F.col("severity")).alias("total"))


@query("f10_numeric_functions", """
SELECT p_partkey, floor(p_retailprice * 10 + 0.5) / 10 AS rounded, abs(p_retailprice - 1000) AS dist,
  sign(p_retailprice - 1000) AS sgn, round(sqrt(p_retailprice), 6) AS root, round(exp(p_size / 50.0), 6) AS e,
  round(ln(p_retailprice), 6) AS l, round(atan(p_size), 6) AS a FROM part""")
def _(spark, sf):
    p = F.col("p_retailprice")
    return D.table(spark, sf, "part").select(
        "p_partkey", S.half_up(p, 1).alias("rounded"), F.abs(p - 1000).alias("dist"), F.signum(p - 1000).cast("int").alias("sgn"),
        F.round(F.sqrt(p), 6).alias("root"), F.round(F.exp(F.col("p_size") / 50.0), 6).alias("e"),
        F.round(F.ln(p), 6).alias("l"), F.round(F.atan(F.col("p_size").cast("double")), 6).alias("a"))


@query("f11_inverse_normal", "SELECT p_partkey, round(" + ppf_sql("p") + """, 6) AS z FROM (
  SELECT p_partkey, ((p_partkey * 37) % 1000) / 1000.0 AS p FROM part)""")
def _(spark, sf):
    p = ((F.col("p_partkey") * 37) % 1000) / 1000.0
    return D.table(spark, sf, "part").select("p_partkey", F.round(S.norm_ppf(p), 6).alias("z"))


@query("f12_overlap_band", """
SELECT p_size * 2 AS pct, CASE WHEN p_size * 2 > 80 THEN 'very high' WHEN p_size * 2 > 60 THEN 'high'
  WHEN p_size * 2 > 40 THEN 'medium' WHEN p_size * 2 > 20 THEN 'low' ELSE 'very low' END AS band, count(*) AS n
FROM part GROUP BY 1, 2""")
def _(spark, sf):
    pct = F.col("p_size") * 2
    return D.table(spark, sf, "part").groupBy(pct.alias("pct"), S.overlap_band(pct).alias("band")).agg(F.count("*").alias("n"))


@query("f13_haversine", """
SELECT p.station, round(2 * 6371.0088 * asin(sqrt(least(1.0, pow(sin(radians(z.cy - p.lat) / 2), 2)
  + cos(radians(p.lat)) * cos(radians(z.cy)) * pow(sin(radians(z.cx - p.lon) / 2), 2)))), 6) AS km
FROM station_places p JOIN zone_shapes z ON p.zone = z.zone""")
def _(spark, sf):
    z = D.zone_shapes(spark, sf).select("zone", "cx", "cy")
    return D.station_places(spark, sf).join(z, "zone").select(
        "station", F.round(S.haversine_km(F.col("lat"), F.col("lon"), F.col("cy"), F.col("cx")), 6).alias("km"))


@query("f14_ray_cast", """
SELECT p.station, CASE WHEN abs(p.lon - z.cx) + abs(p.lat - z.cy) < z.r THEN 1 ELSE 0 END AS inside
FROM station_places p JOIN zone_shapes z ON p.zone = z.zone""")
def _(spark, sf):
    z = D.zone_shapes(spark, sf).select("zone", "ring")
    return D.station_places(spark, sf).join(z, "zone").select(
        "station", S.in_ring(F.col("lon"), F.col("lat"), F.col("ring")).cast("int").alias("inside"))


@query("f15_ensemble_arrays", """
SELECT vec_id, round(avg(CAST(m AS DOUBLE)), 6) AS mean, round(median(CAST(m AS DOUBLE)), 6) AS median,
  count(*) FILTER (m > 0) AS positive FROM (
  SELECT vec_id, unnest(list_slice(embedding, 1, 10)) AS m FROM embeddings) GROUP BY 1""")
def _(spark, sf):
    m = F.slice(F.col("embedding").cast("array<double>"), 1, 10)
    return D.table(spark, sf, "embeddings").select(
        "vec_id", F.round(S.array_mean(m), 6).alias("mean"), F.round(S.array_median(m), 6).alias("median"),
        F.size(F.filter(m, lambda x: x > 0)).alias("positive"))
