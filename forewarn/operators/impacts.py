"""Impact records: harmonising, repairing, clustering, labelling, cataloguing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import add_missing, build_date, event_interval
from .rolling import runs
from .windows import along, past


def harmonise_sheet(df: DataFrame, source: str) -> DataFrame:
    """Event sheet with split start/end dates and totals per event."""
    start, end, middle = event_interval(*[F.col(c) for c in (
        "start_year", "start_month", "start_day", "end_year", "end_month", "end_day")])
    return df.select(
        F.lit(source).alias("data_source"), F.col("iso").alias("country"),
        F.lower("disaster_type").alias("disaster_type"), F.col("location"),
        middle.alias("event_date"), start.alias("start_date"), end.alias("end_date"),
        F.col("total_deaths").cast("double").alias("people_dead"),
        F.col("no_injured").cast("double").alias("people_injured"),
        F.col("no_affected").cast("double").alias("people_affected"))


def harmonise_records(df: DataFrame, source: str, country: str, types: dict[str, str]) -> DataFrame:
    """National loss records with one date and counts that add up to people affected."""
    when = build_date(F.col("year"), F.col("month"), F.col("day"))
    pairs = [x for kv in types.items() for x in (F.lit(kv[0]), F.lit(kv[1]))]
    kind = F.try_element_at(F.create_map(*pairs), F.upper("event"))
    return df.select(
        F.lit(source).alias("data_source"), F.lit(country).alias("country"),
        kind.alias("disaster_type"), F.col("place").alias("location"), when.alias("event_date"),
        when.alias("start_date"), when.alias("end_date"),
        add_missing(F.col("dead").cast("double"), F.col("missing").cast("double")).alias("people_dead"),
        F.col("injured").cast("double").alias("people_injured"),
        add_missing(F.col("affected").cast("double"), F.col("evacuated").cast("double"))
        .alias("people_affected"))


def merge_sources(country: str, disaster: str, *sources: DataFrame) -> DataFrame:
    """Union of harmonised sources for one country and disaster type."""
    out = None
    for s in sources:
        part = s.where((F.col("country") == country) & (F.col("disaster_type") == disaster))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def split_names(df: DataFrame, col: str, sep: str = ",", out: str | None = None) -> DataFrame:
    """One row per name of a separated list."""
    names = F.transform(F.split(F.col(col), sep), lambda s: F.trim(s))
    out = out or col
    return df.withColumn(out, F.explode(names)).where(F.col(out) != "")


def cluster_events(df: DataFrame, keys: list[str], cols: list[str], gap_days: int = 7,
                   date: str = "date") -> DataFrame:
    """Chain reports less than ``gap_days`` apart into one event; zeros do not enter the means.

    Reports of one day are combined first, with sums and counts, so chaining sees one row per key and
    day.
    """
    aggs = []
    for c in cols:
        aggs += [F.sum(F.nullif(F.col(c), F.lit(0))).alias(f"_s_{c}"),
                 F.count(F.nullif(F.col(c), F.lit(0))).alias(f"_n_{c}")]
    daily = df.groupBy(*keys, date).agg(F.count("*").alias("_reports"), *aggs)
    gap = F.datediff(F.col(date), F.lag(date).over(along(keys, date)))
    daily = daily.withColumn("_new", F.when(gap.isNull() | (gap >= gap_days), 1).otherwise(0))
    daily = daily.withColumn("event_no", F.sum("_new").over(past(keys, date)).cast("bigint"))
    means = [F.try_divide(F.sum(f"_s_{c}").cast("double"), F.sum(f"_n_{c}").cast("double")).alias(c)
             for c in cols]
    return daily.groupBy(*keys, "event_no").agg(
        F.min(date).alias("start_date"), F.max(date).alias("end_date"),
        F.sum("_reports").alias("reports"), *means)


def fill_event_day(events: DataFrame, rain: DataFrame, keys: list[str], value: str,
                   date: str = "date") -> DataFrame:
    """Replace a missing day by the wettest day of that month; the earliest one on a tie."""
    wettest = (rain.groupBy(*keys, F.trunc(date, "month").alias("month"))
               .agg(F.max_by(F.col(date), F.struct(F.col(value), -F.unix_date(date))).alias("wettest_day")))
    known = build_date(F.year("month"), F.month("month"), F.col("day"))
    return (events.join(wettest, [*keys, "month"], "left")
            .withColumn("date", F.coalesce(known, F.col("wettest_day"))))


def catalogue(hazard: DataFrame, mapping: DataFrame, events: DataFrame, summary: dict[str, Column],
              zone: str = "zone", station: str = "station", date: str = "date") -> DataFrame:
    """Impact-hazard catalogue: hazard rows per zone and day, outer-joined with the events.

    The reports of one zone and day enter as one row with the columns of ``summary``, so that stations
    and reports of a busy zone are not multiplied with each other.
    """
    daily = events.groupBy(zone, date).agg(*[c.alias(n) for n, c in summary.items()])
    return hazard.join(mapping, station).join(daily, [zone, date], "full_outer")


def label_months(features: DataFrame, sources: dict[str, DataFrame], zone: str = "zone",
                 month: str = "date") -> DataFrame:
    """Monthly features with one 0/1 label per event source and one for any of them."""
    out = features
    for name, events in sources.items():
        marks = (events.select(zone, F.trunc(month, "month").alias(month)).distinct()
                 .withColumn(name, F.lit(1)))
        out = out.join(marks, [zone, month], "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out.withColumn("any_source", F.greatest(*[F.col(n) for n in sources], F.lit(0)))


def yearly_labels(impacts: DataFrame, mapping: DataFrame, admin: str, livelihood: str, year: str,
                  affected: str) -> DataFrame:
    """Largest impact per year at two zone levels, the second through a mapping table."""
    first = impacts.groupBy(F.col(admin).alias("zone"), F.col(year)).agg(F.max(affected).alias("affected"))
    second = (impacts.join(mapping, admin).groupBy(F.col(livelihood).alias("zone"), F.col(year))
              .agg(F.max(affected).alias("affected")))
    return (first.withColumn("level", F.lit("admin"))
            .unionByName(second.withColumn("level", F.lit("livelihood"))))


def dry_month_classes(monthly: DataFrame, keys: list[str], dry: str, date: str = "date") -> DataFrame:
    """Lengths of consecutive dry months in the classes <3, 3-4, 5-9 and 10 or more."""
    stretches = (runs(monthly, keys, dry, date).where(F.col(dry) == 1)
                 .groupBy(*keys, "run_id").agg(F.count("*").alias("months")))
    m = F.col("months")

    def n(cond: Column, name: str) -> Column:
        return F.count(F.when(cond, 1)).alias(name)

    return stretches.groupBy(*keys).agg(
        n(m < 3, "under_3"), n(m.between(3, 4), "from_3"), n(m.between(5, 9), "from_5"),
        n(m >= 10, "from_10"))
