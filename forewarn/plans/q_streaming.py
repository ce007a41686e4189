"""Streaming queries: the ``events`` table is drained as a file stream into a table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import work_path
from ..streaming import jobs
from . import domain as D
from .registry import query


def stream(spark, sf):
    schema = D.table(spark, sf, "events").schema
    rows = jobs.file_stream(spark, sf, schema, "events.parquet")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


CLOSED = "(SELECT max(ts) - INTERVAL 1 DAY FROM events)"


@query("t01_incremental_ingest", """
SELECT event_id, user_id, CAST(ts AS DATE) AS day, value FROM events""")
def _(spark, sf):
    table, progress, inbox = (work_path(spark, n) for n in ("indicator", "progress", "inbox"))
    first = D.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    # a first delivery with every third row on a wrong day, then a second with all rows: only its files are read
    moved = first.where("event_id % 2 = 0").withColumn(
        "ts", F.when(F.col("event_id") % 3 == 0, F.col("ts") - F.expr("INTERVAL 1 DAY")).otherwise(F.col("ts")))
    for number, delivery in enumerate((moved, first)):
        delivery.withColumn("delivery", F.lit(number)).write.mode("append").parquet(inbox)
        rows = jobs.file_stream(spark, inbox, "event_id long, user_id long, ts timestamp, event_type string, value double, delivery int")
        rows = rows.select("event_id", "user_id", F.to_date("ts").alias("day"), "value", "delivery")
        jobs.ingest(rows, ["event_id"], ["day"], table=table, checkpoint=progress, version="delivery")
    return spark.read.parquet(table).select("event_id", "user_id", "day", "value")


@query("t02_daily_aggregate", f"""
SELECT user_id, CAST(date_trunc('day', ts) AS TIMESTAMP) AS window_start, count(*) AS n, round(sum(value), 4) AS total FROM events
GROUP BY 1, 2 HAVING CAST(date_trunc('day', ts) AS TIMESTAMP) + INTERVAL 1 DAY <= {CLOSED}""".replace(
    "HAVING CAST(date_trunc('day', ts) AS TIMESTAMP)", "HAVING max(CAST(date_trunc('day', ts) AS TIMESTAMP))"))
def _(spark, sf):
    out = jobs.windowed(stream(spark, sf), ["user_id"], "ts", "1 day",
                        [F.count("*").alias("n"), F.sum("value").alias("total")])
    t = spark.read.parquet(jobs.available_now(out, "daily"))
    return t.select("user_id", F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n",
                    F.round("total", 4).alias("total"))


@query("t03_sliding_sums", f"""
WITH w AS (SELECT event_type, CAST(date_trunc('day', ts) AS TIMESTAMP) - to_days(CAST(k AS INTEGER)) AS window_start, value FROM events, (VALUES (0), (1), (2)) x(k))
SELECT event_type, window_start, count(*) AS n, round(sum(value), 4) AS total FROM w
WHERE window_start + INTERVAL 3 DAY <= {CLOSED} GROUP BY 1, 2""")
def _(spark, sf):
    out = jobs.windowed(stream(spark, sf), ["event_type"], "ts", "3 days",
                        [F.count("*").alias("n"), F.sum("value").alias("total")], slide="1 day")
    t = spark.read.parquet(jobs.available_now(out, "sliding"))
    return t.select("event_type", F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n",
                    F.round("total", 4).alias("total"))


@query("t04_trigger_sessions", f"""
WITH h AS (SELECT user_id, ts, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events WHERE value >= 20),
s AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap >= INTERVAL 2 DAY THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS no FROM h)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 2 DAY AS session_end, count(*) AS n FROM s GROUP BY user_id, no
HAVING max(ts) + INTERVAL 2 DAY <= (SELECT max(ts) - INTERVAL 1 DAY FROM events WHERE value >= 20)""")
def _(spark, sf):
    out = jobs.sessions(stream(spark, sf).where("value >= 20"), ["user_id"], "ts", "2 days", [F.count("*").alias("n")])
    t = spark.read.parquet(jobs.available_now(out, "sessions"))
    return t.select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"),
                    F.col("session_end").cast("timestamp_ntz").alias("session_end"), "n")


@query("t05_live_triggers", """
WITH d AS (SELECT DISTINCT user_id AS station, CAST(ts AS DATE) AS date FROM events WHERE value >= 20)
SELECT station, date FROM (SELECT *, date - lag(date) OVER (PARTITION BY station ORDER BY date) AS gap FROM d)
WHERE (gap IS NULL OR gap > 3) AND date + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 DAY FROM events)""")
def _(spark, sf):
    rows = stream(spark, sf).withColumn("over", (F.col("value") >= 20).cast("int"))
    out = jobs.live_triggers(rows, "user_id", "ts", "over", 3)
    return spark.read.parquet(jobs.available_now(out, "live")).select("station", "date")


@query("t06_stream_static_alerts", """
WITH q AS (SELECT event_type, round(quantile_cont(value, 0.95), 6) AS threshold FROM events GROUP BY 1)
SELECT e.event_id, e.user_id, e.event_type, e.value, q.threshold FROM events e JOIN q USING (event_type) WHERE e.value >= q.threshold""")
def _(spark, sf):
    from ..operators.quantiles import quantiles_of_rows
    history = D.table(spark, sf, "events").select("event_type", "value")
    limits = quantiles_of_rows(history, ["event_type"], "value", [95]).select("event_type", "threshold")
    path = work_path(spark, "limits")
    limits.write.parquet(path)
    out = jobs.alerts(stream(spark, sf), spark.read.parquet(path), "event_type", "value")
    t = spark.read.parquet(jobs.available_now(out.select("event_id", "user_id", "event_type", "value", "threshold"), "alerts"))
    return t.select("event_id", "user_id", "event_type", "value", "threshold")
