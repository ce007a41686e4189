"""Scans: delimited files, station files, sheets, records, grids and database tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import nan_to_null


def clean_nan(df: DataFrame) -> DataFrame:
    """NaN to null in every floating column."""
    fixes = {c: nan_to_null(F.col(c)) for c, t in df.dtypes if t in ("double", "float")}
    return df.withColumns(fixes) if fixes else df


def read_delimited(spark: SparkSession, path: str, schema: str, sep: str = ",",
                   encoding: str = "ISO-8859-1", null: str = "", index_column: bool = False) -> DataFrame:
    """Delimited text with a declared schema; a leading index column is dropped."""
    full = f"_index STRING, {schema}" if index_column else schema
    df = (spark.read.schema(full).option("header", True).option("sep", sep)
          .option("encoding", encoding).option("nullValue", null).option("nanValue", "NaN").csv(path))
    return clean_nan(df.drop("_index") if index_column else df)


def read_station_files(spark: SparkSession, path: str, schema: str, pattern: str, sep: str = ",",
                       out: str = "station") -> DataFrame:
    """Many files, the station taken from the file path by a regular expression."""
    df = (spark.read.schema(schema).option("header", True).option("sep", sep)
          .option("recursiveFileLookup", True).csv(path))
    return df.withColumn(out, F.regexp_extract(F.col("_metadata.file_path"), pattern, 1))


def read_selected_files(spark: SparkSession, path: str, glob: str, keep: Column | None = None,
                        fmt: str = "parquet") -> DataFrame:
    """Only files whose name fits ``glob`` and whose path satisfies ``keep``."""
    df = (spark.read.format(fmt).option("pathGlobFilter", glob)
          .option("recursiveFileLookup", True).load(path))
    df = df.withColumn("file_path", F.col("_metadata.file_path"))
    return df.where(keep) if keep is not None else df


def read_grid(spark: SparkSession, path: str, time: tuple[str, str] | None = None,
              lat: tuple[float, float] | None = None, lon: tuple[float, float] | None = None,
              lat_col: str = "lat", lon_col: str = "lon", time_col: str = "time") -> DataFrame:
    """Cell table restricted to a box and a period; the bounds reach the scan."""
    df = spark.read.parquet(path)
    for col, bounds in ((time_col, time), (lat_col, lat), (lon_col, lon)):
        if bounds:
            df = df.where(F.col(col).between(*sorted(bounds)))
    return df


def read_table_range(spark: SparkSession, source: str, column: str, low: str, high: str,
                     columns: dict[str, str], **jdbc) -> DataFrame:
    """Period of a database table, projected and renamed.

    With JDBC options the table is read in parallel by ``partitionColumn``; without them ``source`` is
    a Parquet path. Range and projection are pushed down either way.
    """
    if jdbc:
        df = spark.read.format("jdbc").options(dbtable=source, **jdbc).load()
    else:
        df = spark.read.parquet(source)
    df = df.where(F.col(column).between(F.lit(low).cast("timestamp"), F.lit(high).cast("timestamp")))
    return df.select(*[F.col(a).alias(b) for a, b in columns.items()])


def read_records(spark: SparkSession, path: str, schema: str, tag: str = "TR") -> DataFrame:
    """XML records by row tag."""
    return spark.read.format("xml").schema(schema).option("rowTag", tag).load(path)


def read_sheets(spark: SparkSession, path: str, skip: int, sep: str = ";") -> DataFrame:
    """Sheets exported as text: ``skip`` preamble rows, ``Year: yyyy`` headers above month rows.

    A sheet is one station's file and is read as one row; the header fills down by position within it.
    """
    from ..operators.windows import past
    files = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("sheet"), F.posexplode(F.split("value", "\n")))
    rows = files.where((F.col("pos") >= skip) & (F.trim("col") != ""))
    year = F.nullif(F.regexp_extract("col", r"^Year:\s*(\d{4})", 1), F.lit("")).cast("int")
    rows = rows.withColumn("_y", year)
    rows = rows.withColumn("year", F.last("_y", ignorenulls=True).over(past(["sheet"], "pos")))
    parts = F.split("col", sep)
    return rows.where(F.col("_y").isNull()).select(
        "sheet", "year", F.trim(parts[0]).alias("label"), parts[1].try_cast("double").alias("value"))
