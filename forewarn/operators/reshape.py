"""Column cleaning, long/wide reshaping and lead-time feature sets."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .windows import along


def rename_map(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Select and rename in one projection; the target ``x`` drops the column."""
    return df.select(*[F.col(f"`{src}`").alias(dst) for src, dst in mapping.items() if dst != "x"])


def clean_name(name: str) -> str:
    """Lower-case words joined by underscores."""
    return re.sub(r"[^0-9a-z]+", "_", name.strip().lower()).strip("_")


def clean_columns(df: DataFrame) -> DataFrame:
    """Clean all column names; a repeated name gets a running number."""
    seen: dict[str, int] = {}
    names = []
    for c in df.columns:
        base = clean_name(c)
        seen[base] = seen.get(base, 0) + 1
        names.append(base if seen[base] == 1 else f"{base}_{seen[base]}")
    return df.toDF(*names)


def quality_filter(df: DataFrame, score: str, missing: int = 99) -> DataFrame:
    """Missing scores count as good; score 0 is dropped."""
    return df.withColumn(score, F.coalesce(F.col(score), F.lit(missing))).where(F.col(score) > 0)


def drop_empty_columns(df: DataFrame) -> DataFrame:
    """Drop columns without a single value (one aggregate, one row to the driver)."""
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(df.columns)]).first()
    return df.select(*[F.col(f"`{c}`") for i, c in enumerate(df.columns) if counts[i] > 0])


def to_long(df: DataFrame, ids: list[str], values: list[str], name: str = "variable",
            value: str = "value", drop_blank: bool = True) -> DataFrame:
    """Wide columns to rows; blanks and the usual missing markers go."""
    out = df.unpivot(ids, values, name, value)
    if not drop_blank:
        return out
    text = F.trim(F.col(value).cast("string"))
    return out.where(F.col(value).isNotNull() & ~text.isin("", "NA", "Na", "NaN", "nan", "#N-A"))


def to_wide(df: DataFrame, keys: list[str], name: str, names: list, agg: Column) -> DataFrame:
    """Rows to columns with the column list given, so no extra pass is needed to find it."""
    return df.groupBy(*keys).pivot(name, names).agg(agg)


def number_within(df: DataFrame, keys: list[str], order: list[str], prefix: str,
                  out: str = "slot") -> DataFrame:
    """Label the rows of each key ``prefix1``, ``prefix2`` ..., as many as there are."""
    return df.withColumn(out, F.concat(F.lit(prefix), F.row_number().over(along(keys, order)).cast("string")))


def spread_slots(numbered: DataFrame, keys: list[str], value: str, slot: str = "slot", out: str = "slots") -> DataFrame:
    """One row per key with a map from slot to value: the wide form for any number of slots."""
    return numbered.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(slot, value))).alias(out))


def repeat_months(df: DataFrame, year: str, months: list[tuple[int, int]]) -> DataFrame:
    """One row per season month: ``months`` lists ``(month, year offset)``."""
    rows = F.array(*[F.struct(F.lit(m).alias("month"), F.lit(o).alias("offset")) for m, o in months])
    return (df.withColumn("_m", F.explode(rows))
            .withColumns({"month": F.col("_m.month"),
                          "month_date": F.make_date(F.col(year) + F.col("_m.offset"),
                                                    F.col("_m.month"), F.lit(1))}).drop("_m"))


def lead_features(monthly: DataFrame, keys: list[str], value: str, month_rank: str,
                  leads: dict[int, int]) -> DataFrame:
    """Features known at issue time for every lead in one pass.

    ``leads`` maps a lead to the last month rank known then. A month row serves every lead that knows
    it, so it is sent to those leads only and combined per key and lead.
    """
    known = F.array(*[F.struct(F.lit(k).alias("lead"), F.lit(v).alias("cut")) for k, v in leads.items()])
    served = F.filter(known, lambda s: s["cut"] >= F.col(month_rank))
    flat = monthly.withColumn("lead", F.explode(F.transform(served, lambda s: s["lead"])))
    return flat.groupBy(*keys, "lead").agg(F.count(value).alias("months_known"),
                                           F.sum(value).alias("value_cum"),
                                           F.avg(value).alias("value_mean"))


def correlation_matrix(df: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Long table ``(keys, a, b, r)`` over all column pairs from one aggregate."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    cells = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(a, b).alias("r"))
             for a, b in pairs]
    wide = df.groupBy(*keys).agg(F.array(*cells).alias("_c")) if keys else df.agg(F.array(*cells).alias("_c"))
    return wide.select(*keys, F.explode("_c").alias("_r")).select(*keys, "_r.a", "_r.b", "_r.r")
