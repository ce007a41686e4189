"""Sinks: delimited text, partitioned tables, keyed upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage, remove


def write_delimited(df: DataFrame, path: str, sep: str = ",", mode: str = "overwrite",
                    by: list[str] | None = None) -> str:
    """Delimited text with a header; ``mode='append'`` adds files, never rows one by one."""
    w = df.write.mode(mode).option("header", True).option("sep", sep)
    if by:
        w = w.partitionBy(*by)
    w.csv(path)
    return path


def write_partitioned(df: DataFrame, path: str, by: list[str]) -> str:
    """Replace only the partitions present in ``df``.

    Rows are clustered by the partition columns plus a spread of 32, so that a partition holding much
    of the table is still written by many tasks.
    """
    spread = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(32))
    (df.withColumn("_spread", spread).repartition(*by, "_spread").drop("_spread")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path))
    return path


def exists(spark: SparkSession, path: str) -> bool:
    """Whether anything is stored at ``path``; failures of the file system get out."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def latest(df: DataFrame, keys: list[str], version: str | None = None) -> DataFrame:
    """One row per key: the highest ``version``, ties and a missing version column by the largest row."""
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    order = [c for c in (version,) if c] + [c for c in rest if c != version]
    best = df.groupBy(*keys).agg(F.max(F.struct(*order)).alias("_row"))
    return best.select(*[c if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])


def upsert(df: DataFrame, path: str, keys: list[str], by: list[str], version: str | None = None) -> str:
    """Write ``df`` into a partitioned table, replacing rows with the same keys.

    Of several rows of one key the latest stays, also against the stored row where ``version`` is given. The partitions
    of the new rows are rewritten, and those that hold old rows of their keys: a key that moves leaves nothing behind.
    If ``by`` is part of the keys none can move and no other partition is read. Sending the same rows again changes
    nothing.
    """
    spark = df.sparkSession
    df = cut_lineage(latest(df, keys, version))
    if not exists(spark, path):
        return write_partitioned(df, path, by)
    stored = spark.read.parquet(path)
    touched = df.select(*by).distinct()
    if not set(by) <= set(keys):
        old = stored.select(*dict.fromkeys([*keys, *by])).join(df.select(*keys), keys, "left_semi").select(*by)
        touched = cut_lineage(touched.union(old).distinct())
    # the rows are cut from their source before the source's partitions are replaced
    there = stored.select("*", F.col("_metadata.file_path").alias("_file")).join(touched, by, "left_semi")
    files = there.select(*by, "_file").distinct()
    if version:
        merged = latest(there.select(df.columns).unionByName(df), keys, version)
    else:
        merged = df.unionByName(there.join(df.select(*keys), keys, "left_anti").select(df.columns))
    merged = cut_lineage(merged)
    emptied = [r[0] for r in files.join(merged.select(*by).distinct(), by, "left_anti").select("_file").collect()]
    write_partitioned(merged, path, by)
    for name in emptied:
        remove(spark, spark._jvm.java.net.URI(name).toString())
    return path
