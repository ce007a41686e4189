"""Sources, sinks, projection and reshaping queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import reshape as R
from ..operators.series import clip_to_events
from ..session import work_path
from ..sources import readers, writers
from ..sources.settings import CountrySettings
from . import domain as D
from .registry import query


@query("s01_csv_scan", """
SELECT s_suppkey AS station, s_name AS name, CAST(s_nationkey AS BIGINT) AS zone, s_acctbal AS level
FROM supplier""")
def _(spark, sf):
    df = D.table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")
    path = writers.write_delimited(df.toDF("station", "name", "zone", "level"),
                                   work_path(spark, "stations"), sep=";")
    return readers.read_delimited(spark, path, "station BIGINT, name STRING, zone BIGINT, level DOUBLE",
                                  sep=";")


@query("s02_station_files", "SELECT zone AS station, date, value AS dis FROM zone_days")
def _(spark, sf):
    feed = F.concat(F.lit("dis_daily_feed_Z"), F.col("zone"), F.lit(".d"))
    df = D.zone_days(spark, sf).select(feed.alias("feed"), "date", F.col("value").alias("dis"))
    path = writers.write_delimited(df, work_path(spark, "feeds"), by=["feed"])
    out = readers.read_station_files(spark, path, "date DATE, dis DOUBLE",
                                     r"feed=(?:[^_/]*_){3}Z([^./]*)")
    return out.select(F.col("station").cast("bigint").alias("station"), "date", "dis")


@query("s03_file_filter", """
SELECT zone, date, value FROM zone_days WHERE year(date) BETWEEN 1997 AND 1999 AND value >= 40""")
def _(spark, sf):
    kind = F.when(F.col("value") < 40, "_QL_").otherwise("_final_")
    name = F.concat(F.lit("grid"), kind, F.year("date").cast("string"))
    df = D.zone_days(spark, sf).select("zone", "date", "value", name.alias("product"))
    path = writers.write_partitioned(df, work_path(spark, "products"), ["product"])
    year = F.regexp_extract("file_path", r"product=grid_[A-Za-z]+_(\d{4})", 1).cast("int")
    keep = ~F.col("file_path").contains("_QL_") & year.between(1997, 1999)
    return readers.read_selected_files(spark, path, "*.parquet", keep).select("zone", "date", "value")


@query("s04_grid_scan", """
SELECT iy, ix, date, value FROM cell_days
WHERE date BETWEEN DATE '1996-01-01' AND DATE '1998-12-31'""")
def _(spark, sf):
    df = D.cell_days(spark, sf).withColumn("year", F.year("date"))
    path = writers.write_partitioned(df, work_path(spark, "grid"), ["year"])
    out = readers.read_grid(spark, path, time=("1996-01-01", "1998-12-31"), time_col="date")
    return out.where(F.col("year").between(1996, 1998)).select("iy", "ix", "date", "value")


@query("s05_table_range", """
SELECT l_suppkey AS station, CAST(l_shipdate AS DATE) AS time, sum(l_quantity) AS dis24 FROM lineitem
WHERE l_shipdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1997-12-31' GROUP BY 1, 2""")
def _(spark, sf):
    df = readers.read_table_range(spark, f"{sf}/lineitem.parquet", "l_shipdate", "1996-01-01",
                                  "1997-12-31", {"l_suppkey": "station", "l_shipdate": "time",
                                                 "l_quantity": "dis24"})
    return df.groupBy("station", F.to_date("time").alias("time")).agg(F.sum("dis24").alias("dis24"))


@query("s06_xml_records", """
SELECT o_orderkey AS serial, zone, year(date) AS fechano, month(date) AS fechames,
       day(date) AS fechadia, severity AS afectados FROM all_reports JOIN orders ON report = o_orderkey""")
def _(spark, sf):
    df = D.reports(spark, sf).select(
        F.col("report").alias("serial"), "zone", F.year("date").alias("fechano"),
        F.month("date").alias("fechames"), F.dayofmonth("date").alias("fechadia"),
        F.col("severity").alias("afectados"))
    path = work_path(spark, "records")
    df.write.format("xml").option("rowTag", "TR").option("rootTag", "fichas").save(path)
    return readers.read_records(spark, path, "serial BIGINT, zone BIGINT, fechano INT, fechames INT, "
                                "fechadia INT, afectados DOUBLE")


@query("s07_sheet_scan", """
SELECT zone, year(date) AS year, month(date) AS month, value FROM zone_months""")
def _(spark, sf):
    months = D.zone_months(spark, sf).withColumns({"year": F.year("date"), "month": F.month("date")})
    # one sheet per zone: its lines are bounded by the months of the calendar
    line = F.concat(F.col("month").cast("string"), F.lit(";"), F.col("value").cast("string"))
    lines = months.select("zone", F.col("year"), F.col("month"), line.alias("text")).unionByName(
        months.select("zone", "year").distinct().select(
            "zone", "year", F.lit(0).alias("month"),
            F.concat(F.lit("Year: "), F.col("year").cast("string")).alias("text")))
    sheet = lines.groupBy("zone").agg(F.array_sort(F.collect_list(
        F.struct("year", "month", "text"))).alias("l"))
    head = F.lit("\n".join(f"preamble {i}" for i in range(6)) + "\n")
    body = F.concat(head, F.array_join(F.transform("l", lambda s: s["text"]), "\n"))
    path = work_path(spark, "sheets")
    sheet.select("zone", body.alias("value")).write.partitionBy("zone").text(path)
    out = readers.read_sheets(spark, path, skip=6)
    return out.select(F.regexp_extract("sheet", r"zone=(\d+)", 1).cast("bigint").alias("zone"), "year",
                      F.col("label").cast("int").alias("month"), "value")


@query("s08_csv_append", """
SELECT zone, date, severity FROM all_reports UNION ALL SELECT zone, date, severity FROM all_reports""")
def _(spark, sf):
    df = D.reports(spark, sf).select("zone", "date", "severity")
    path = work_path(spark, "catalogue")
    writers.write_delimited(df, path, sep="\t", mode="append")
    writers.write_delimited(df, path, sep="\t", mode="append")
    return readers.read_delimited(spark, path, "zone BIGINT, date DATE, severity DOUBLE", sep="\t")


@query("s09_partitioned_sink", """
SELECT zone, date, 1 AS admin_lvl, 'rain' AS indicator, rain * 2 AS value FROM zone_months
UNION ALL SELECT zone, date, 1, 'flow', value FROM zone_months""")
def _(spark, sf):
    m = D.zone_months(spark, sf)
    rain = m.select("zone", "date", F.lit(1).alias("admin_lvl"), F.lit("rain").alias("indicator"),
                    F.col("rain").alias("value"))
    flow = m.select("zone", "date", F.lit(1).alias("admin_lvl"), F.lit("flow").alias("indicator"), "value")
    by, path = ["admin_lvl", "indicator"], work_path(spark, "indicators")
    writers.write_partitioned(rain.unionByName(flow), path, by)
    writers.write_partitioned(rain.withColumn("value", F.col("value") * 2), path, by)
    return spark.read.parquet(path).select("zone", "date", "admin_lvl", "indicator", "value")


@query("s10_country_settings", """
SELECT 'north' AS country, iy, ix, sum(value) AS value FROM cell_days
WHERE iy / 10.0 + 0.05 BETWEEN 5.0 AND 10.0 AND ix / 10.0 + 0.05 BETWEEN 0.0 AND 9.7
  AND date BETWEEN DATE '1995-01-01' AND DATE '1998-12-31' GROUP BY 2, 3
UNION ALL SELECT 'south', iy, ix, sum(value) FROM cell_days
WHERE iy / 10.0 + 0.05 BETWEEN 0.0 AND 5.0 AND ix / 10.0 + 0.05 BETWEEN 2.0 AND 6.0
  AND date BETWEEN DATE '1997-01-01' AND DATE '2000-12-31' GROUP BY 2, 3""")
def _(spark, sf):
    runs = [CountrySettings("north", (5.0, 10.0), (0.0, 9.7), "1995-01-01", "1998-12-31"),
            CountrySettings("south", (0.0, 5.0), (2.0, 6.0), "1997-01-01", "2000-12-31")]
    grid = D.cell_days(spark, sf).withColumns({"lat": F.col("iy") / 10.0 + 0.05,
                                               "lon": F.col("ix") / 10.0 + 0.05})
    parts = [r.restrict(grid, "lat", "lon", "date").groupBy(F.lit(r.name).alias("country"), "iy", "ix")
             .agg(F.sum("value").alias("value")) for r in runs]
    return parts[0].unionByName(parts[1])


@query("p01_rename_map", """
SELECT s_suppkey AS station, s_name AS label, CAST(s_nationkey AS BIGINT) AS zone FROM supplier""")
def _(spark, sf):
    return R.rename_map(D.table(spark, sf, "supplier"), {
        "s_suppkey": "station", "s_name": "label", "s_nationkey": "zone", "s_acctbal": "x"})


@query("p02_clean_names", """
SELECT p_partkey AS part_key, p_name AS part_name, p_retailprice AS retail_price_usd FROM part""")
def _(spark, sf):
    raw = D.table(spark, sf, "part").select(
        F.col("p_partkey").alias(" Part Key"), F.col("p_name").alias("Part-Name"),
        F.col("p_retailprice").alias("Retail price (USD)"))
    return R.clean_columns(raw)


@query("p03_filters", """
SELECT zone, date, value FROM zone_days WHERE zone = 7 AND date >= DATE '1998-01-01' AND value > 60""")
def _(spark, sf):
    return D.zone_days(spark, sf).where("zone = 7 AND date >= DATE '1998-01-01' AND value > 60").select(
        "zone", "date", "value")


@query("p04_quality_filter", """
SELECT o_orderkey AS report, coalesce(CASE WHEN o_orderpriority = '3-MEDIUM' THEN NULL
  ELSE CAST(substr(o_orderpriority, 1, 1) AS BIGINT) - 1 END, 99) AS score FROM orders
WHERE o_orderpriority <> '1-URGENT'""")
def _(spark, sf):
    digit = F.substring("o_orderpriority", 1, 1).cast("int") - 1
    score = F.when(F.col("o_orderpriority") != "3-MEDIUM", digit)
    df = D.table(spark, sf, "orders").select(F.col("o_orderkey").alias("report"), score.alias("score"))
    return R.quality_filter(df, "score")


@query("p05_clip_to_events", """
SELECT f.zone, f.date, f.value FROM zone_filled f JOIN (
  SELECT zone, min(date) - 30 AS lo, max(date) + 30 AS hi FROM event_days GROUP BY zone) b
ON f.zone = b.zone AND f.date BETWEEN b.lo AND b.hi""")
def _(spark, sf):
    return clip_to_events(D.zone_filled(spark, sf), D.event_days(spark, sf), ["zone"], 30).select(
        "zone", "date", "value")


@query("p06_drop_nulls", "SELECT zone, date, value, rain FROM zone_dense WHERE value IS NOT NULL")
def _(spark, sf):
    return D.zone_dense(spark, sf).dropna(subset=["value", "rain"])


@query("p07_drop_empty_columns", "SELECT zone, date, value FROM zone_months")
def _(spark, sf):
    df = D.zone_months(spark, sf).select(
        "zone", "date", "value", F.lit(None).cast("double").alias("empty_a"),
        F.when(F.col("value") < 0, F.col("value")).alias("empty_b"))
    return R.drop_empty_columns(df)


@query("p08_melt", """
SELECT zone, date, 'flow' AS variable, value FROM zone_months
UNION ALL SELECT zone, date, 'rain', rain FROM zone_months""")
def _(spark, sf):
    return R.to_long(D.zone_months(spark, sf).withColumnRenamed("value", "flow"), ["zone", "date"],
                     ["flow", "rain"])


@query("p09_pivot_months", """
SELECT zone, year(date) AS year, """ + ", ".join(
    f"sum(CASE WHEN month(date) = {m} THEN value END) AS m{m}" for m in range(1, 13)) + """
FROM zone_months GROUP BY 1, 2""")
def _(spark, sf):
    m = D.zone_months(spark, sf).withColumns({"year": F.year("date"), "month": F.month("date")})
    wide = R.to_wide(m, ["zone", "year"], "month", list(range(1, 13)), F.sum("value"))
    return wide.select("zone", "year", *[F.col(str(i)).alias(f"m{i}") for i in range(1, 13)])


@query("p10_conditional_map", """
SELECT l_returnflag AS code, CAST(CASE l_returnflag WHEN 'A' THEN 0.25 WHEN 'R' THEN 0.75 ELSE 0.0 END AS DOUBLE) AS share,
  CASE WHEN avg(l_quantity) > 25.5 THEN 'Yes' ELSE 'No' END AS above, count(*) AS n
FROM lineitem GROUP BY 1, 2""")
def _(spark, sf):
    fractions = F.create_map(F.lit("A"), F.lit(0.25), F.lit("R"), F.lit(0.75))
    share = F.coalesce(F.try_element_at(fractions, F.col("code")), F.lit(0.0))
    li = D.table(spark, sf, "lineitem").withColumnRenamed("l_returnflag", "code")
    agg = li.groupBy("code").agg(F.avg("l_quantity").alias("m"), F.count("*").alias("n"))
    return agg.select("code", share.alias("share"),
                      F.when(F.col("m") > 25.5, "Yes").otherwise("No").alias("above"), "n")


@query("p11_crop_year", """
SELECT zone, CASE WHEN month(date) >= 7 THEN year(date) + 1 ELSE year(date) END AS crop_year,
  CASE WHEN month(date) IN (3,4,5) THEN 1 WHEN month(date) IN (7,8,9) THEN 2 ELSE 3 END AS season,
  sum(value) AS value FROM zone_days GROUP BY 1, 2, 3""")
def _(spark, sf):
    return D.zone_days(spark, sf).groupBy(
        "zone", S.crop_year(F.col("date")).alias("crop_year"),
        S.season_code(F.col("date")).alias("season")).agg(F.sum("value").alias("value"))


@query("p12_unit_conversion", """
SELECT zone, date, value * 1000 AS mm, round(value * 0.0001, 6) AS scaled,
  round(1000 * (value / 1000000) * 86400 * day(last_day(date)), 4) AS mm_month FROM zone_months""")
def _(spark, sf):
    days = F.dayofmonth(F.last_day("date"))
    return D.zone_months(spark, sf).select(
        "zone", "date", (F.col("value") * 1000).alias("mm"),
        F.round(F.col("value") * 0.0001, 6).alias("scaled"),
        F.round(1000 * (F.col("value") / 1000000) * 86400 * days, 4).alias("mm_month"))


@query("p13_number_and_spread", """
WITH t AS (SELECT zone, station, row_number() OVER (PARTITION BY zone ORDER BY level DESC, station) AS rn
  FROM (SELECT CAST(s_nationkey AS BIGINT) AS zone, s_suppkey AS station, s_acctbal AS level FROM supplier))
SELECT zone, count(*) AS n, max(CASE WHEN rn = 1 THEN station END) AS st1,
  string_agg('st' || rn || '=' || station, ',' ORDER BY rn) AS stations FROM t GROUP BY zone""")
def _(spark, sf):
    st = D.table(spark, sf, "supplier").select(
        F.col("s_nationkey").alias("zone"), F.col("s_suppkey").alias("station"), F.col("s_acctbal").alias("level"))
    numbered = R.number_within(st, ["zone"], [F.desc("level"), "station"], "st")
    wide = R.spread_slots(numbered, ["zone"], "station")
    number = F.transform(F.map_entries("slots"), lambda e: F.struct(
        F.substring(e["key"], 3, 20).cast("int").alias("i"), e["value"].alias("v")))
    return wide.select("zone", F.size("slots").alias("n"), F.col("slots")["st1"].alias("st1"), F.array_join(F.transform(
        F.array_sort(number), lambda e: F.concat(F.lit("st"), e["i"], F.lit("="), e["v"])), ",").alias("stations"))


SEASON = [(9, 0), (10, 0), (11, 0), (12, 0), (1, 1), (2, 1), (3, 1)]


@query("p14_repeat_months", """
SELECT z.zone, z.year, m.month, make_date(CAST(z.year + m.off AS BIGINT), CAST(m.month AS BIGINT), 1) AS month_date
FROM (SELECT DISTINCT zone, year(date) AS year FROM zone_days) z
JOIN (VALUES (9,0),(10,0),(11,0),(12,0),(1,1),(2,1),(3,1)) m(month, off) ON TRUE""")
def _(spark, sf):
    years = D.zone_days(spark, sf).select("zone", F.year("date").alias("year")).distinct()
    return R.repeat_months(years, "year", SEASON)


@query("p15_provenance", """
SELECT zone, date, severity, 'orders' AS data_source, 2 AS quality FROM all_reports""")
def _(spark, sf):
    return D.reports(spark, sf).select("zone", "date", "severity", F.lit("orders").alias("data_source"),
                                      F.lit(2).alias("quality"))


@query("p16_lead_features", """
SELECT zone, crop_year, lead, count(value) AS months_known, sum(value) AS value_cum,
  round(avg(value), 6) AS value_mean
FROM (SELECT zone, year(date) + CASE WHEN month(date) >= 7 THEN 1 ELSE 0 END AS crop_year,
        (month(date) + 5) % 12 AS month_rank, value FROM zone_months) m
JOIN (VALUES (1, 7), (2, 5), (3, 3), (4, 1)) l(lead, cut) ON month_rank <= cut GROUP BY 1, 2, 3""")
def _(spark, sf):
    m = D.zone_months(spark, sf).select("zone", S.crop_year(F.col("date")).alias("crop_year"),
                                        ((F.month("date") + 5) % 12).alias("month_rank"), "value")
    out = R.lead_features(m, ["zone", "crop_year"], "value", "month_rank", {1: 7, 2: 5, 3: 3, 4: 1})
    return out.withColumn("value_mean", F.round("value_mean", 6))


@query("p17_box_slice", """
SELECT iy, ix, date, value FROM cell_days WHERE iy BETWEEN 20 AND 60 AND ix BETWEEN 10 AND 50
AND date BETWEEN DATE '1997-01-01' AND DATE '1997-12-31'""")
def _(spark, sf):
    return D.cell_days(spark, sf).where(
        F.col("iy").between(20, 60) & F.col("ix").between(10, 50)
        & F.col("date").between(F.lit("1997-01-01").cast("date"), F.lit("1997-12-31").cast("date")))


@query("p18_cell_keys", """
SELECT station, CAST(iy AS VARCHAR) || '_' || CAST(ix AS VARCHAR) AS cell_key, iy, ix,
  round(floor((lat + 0.01) * 10) / 10 + 0.05, 6) AS centre_lat, round(floor((lon + 0.01) * 10) / 10 + 0.05, 6) AS centre_lon
FROM station_places""")
def _(spark, sf):
    from ..operators.spatial import cell_centre
    p = D.station_places(spark, sf).withColumn(
        "cell_key", F.concat_ws("_", F.col("iy").cast("string"), F.col("ix").cast("string")))
    parts = F.split("cell_key", "_")
    return p.select("station", "cell_key", parts[0].cast("bigint").alias("iy"),
                    parts[1].cast("bigint").alias("ix"),
                    F.round(cell_centre(F.col("lat") + 0.01), 6).alias("centre_lat"),
                    F.round(cell_centre(F.col("lon") + 0.01), 6).alias("centre_lon"))
