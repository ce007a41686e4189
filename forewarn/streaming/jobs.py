"""Streaming counterparts of ingest, aggregation and triggers.

Every job reads a file source, keeps its progress in a checkpoint below the shared folder and writes a
table there; ``available_now`` drains what has arrived and stops.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..session import work_path
from ..sources.writers import upsert


def file_stream(spark: SparkSession, folder: str, schema, glob: str = "*.parquet",
                files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def available_now(stream: DataFrame, label: str, output: str = "append",
                  each: Callable[[DataFrame, int], None] | None = None,
                  checkpoint: str | None = None, table: str | None = None) -> str:
    """Drain the source into a table and return its path."""
    spark = stream.sparkSession
    table = table or work_path(spark, label)
    writer = (stream.writeStream.outputMode(output).trigger(availableNow=True)
              .option("checkpointLocation", checkpoint or work_path(spark, f"{label}-progress")))
    if each is None:
        query = writer.format("parquet").option("path", table).start()
    else:
        query = writer.foreachBatch(each).start()
    query.awaitTermination()
    return table


def ingest(stream: DataFrame, keys: list[str], by: list[str], label: str = "ingest",
           table: str | None = None, checkpoint: str | None = None, version: str | None = None) -> str:
    """Idempotent keyed ingest: a batch replayed after a failure rewrites the same rows.

    ``checkpoint`` keeps the progress: a later call with it reads only files that came since. The latest ``version`` of
    a key wins.
    """
    table = table or work_path(stream.sparkSession, label)

    def each(batch: DataFrame, _id: int) -> None:
        upsert(batch, table, keys, by, version)

    return available_now(stream, label, "append", each, checkpoint, table)


def windowed(stream: DataFrame, keys: list[str], ts: str, size: str, aggs: list[Column],
             slide: str | None = None, late: str = "1 day") -> DataFrame:
    """Tumbling or sliding event-time aggregate; a window is final when the watermark passed it."""
    win = F.window(ts, size, slide) if slide else F.window(ts, size)
    return (stream.withWatermark(ts, late).groupBy(*keys, win.alias("w")).agg(*aggs)
            .select(*keys, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                    *[F.col(c) for c in _names(aggs, keys, stream)]))


def _names(aggs: list[Column], keys: list[str], stream: DataFrame) -> list[str]:
    probe = stream.sparkSession.createDataFrame([], stream.schema).groupBy(*keys).agg(*aggs)
    return [c for c in probe.columns if c not in keys]


def sessions(stream: DataFrame, keys: list[str], ts: str, gap: str, aggs: list[Column],
             late: str = "1 day") -> DataFrame:
    """Exceedances closer than ``gap`` are one trigger."""
    return (stream.withWatermark(ts, late)
            .groupBy(*keys, F.session_window(ts, gap).alias("w")).agg(*aggs)
            .select(*keys, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"),
                    *[F.col(c) for c in _names(aggs, keys, stream)]))


DAY_MS = 86_400_000
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class PeakRanges(StatefulProcessor):
    """Of each station the last decided exceedance, the exceedances that wait, and a timer at the end of the first waiting day."""

    def __init__(self, day_range: int):
        self.day_range = day_range

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "day bigint")
        self.waiting = handle.getListState("waiting", "day bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known = {d for (d,) in self.waiting.get()}
        new = {int(d) for pdf in rows for d in pdf.loc[pdf["exceeds"] == 1, "day"]} - known
        if new:
            self.waiting.appendList([(d,) for d in sorted(new)])
        # a station that waited already has a timer; an earlier day needs one of its own
        yield self.settled(key, timerValues.getCurrentWatermarkInMs(), sorted(known | new), min(known, default=None))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self.settled(key, timerValues.getCurrentWatermarkInMs(), sorted(d for (d,) in self.waiting.get()), None)

    def settled(self, key, now: int, days: list[int], timed: int | None) -> pd.DataFrame:
        """Decide the waiting days that have ended, in order; a timer wakes the station at the end of the first day left, unless it
        is ``timed`` already."""
        ended = [d for d in days if (d + 1) * DAY_MS <= now]
        last = self.last.get()[0] if ended and self.last.exists() else None
        fired = []
        for d in ended:
            if last is None or d - last > self.day_range:
                fired.append(d)
            last = d if last is None else max(last, d)
        if ended:
            self.last.update((last,))
            left = [(d,) for d in days[len(ended):]]
            if left:
                self.waiting.put(left)
            else:
                self.waiting.clear()
        if len(ended) < len(days) and days[len(ended)] != timed:
            self.handle.registerTimer((days[len(ended)] + 1) * DAY_MS)
        return pd.DataFrame({"station": [int(key[0])] * len(fired), "day": fired})

    def close(self) -> None:
        pass


def live_triggers(stream: DataFrame, key: str, ts: str, exceeds: str, day_range: int,
                  late: str = "1 day") -> DataFrame:
    """Emit the days on which a new peak range opens, from the state of each station.

    A day opens a range when it exceeds and the previous exceedance is more than ``day_range`` days back. A day is
    decided once the watermark has passed its end: until then it waits in a list of the station's state, next to the last decided
    exceedance, and an event-time timer wakes the station. Whatever comes at most ``late`` behind the newest row may
    come in any order and in any batches; later rows are dropped by Spark. The state of a station is bounded by the
    days within ``late``, and lies in RocksDB, which the session is set to (typed state needs it). Rows that do not exceed move the
    watermark and go no further; of a station's waiting days one timer at a time is kept.
    """
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    rows = stream.withWatermark(ts, late).select(
        F.col(key).cast("bigint").alias("station"), F.col(ts).alias("_ts"),
        F.unix_date(F.to_date(ts)).cast("bigint").alias("day"), F.col(exceeds).alias("exceeds"))
    # names the event time, so that it stays behind the watermark, which all rows move
    rows = rows.where(F.when(F.col("_ts").isNotNull(), F.col("exceeds")) == 1)
    fired = rows.groupBy("station").transformWithStateInPandas(
        PeakRanges(day_range), "station bigint, day bigint", "Append", "EventTime")
    return fired.select("station", F.date_from_unix_date(F.col("day").cast("int")).alias("date"))


def alerts(stream: DataFrame, limits: DataFrame, key: str, value: str, limit: str = "threshold") -> DataFrame:
    """Rows over the threshold of their station, by a stream-static join."""
    return stream.join(limits, key).where(F.col(value) >= F.col(limit))
