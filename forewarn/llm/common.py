"""Helpers shared by the operators: row identity, written intermediates, components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from forewarn.session import remove, work_path

#: Separators of words: everything but letters and digits.
NOT_WORD = r"[^\p{L}\p{N}]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole(text: Column) -> Column:
    """A null text is an empty one."""
    return F.coalesce(text, F.lit(""))


def digest(text: Column) -> Column:
    """Tells rows apart that share an id: 64 bits of the text, equal for repeated rows."""
    return F.xxhash64(whole(text))


def written_at(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """The rows as a table in the shared folder, and its path: later steps survive the loss of any executor."""
    path = work_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, label: str) -> DataFrame:
    """As ``written_at``, without the path."""
    return written_at(df, label)[0]


def components(edges: DataFrame) -> DataFrame:
    """Smallest node of the component of each node of ``edges`` (``a``, ``b``; whole numbers, no nulls).

    Rounds of large-star and small-star: every node points its larger neighbours, then its smaller ones, to the
    smallest neighbour, until no edge moves. Rows stay at most the number of edges, a star's centre is found by a
    combinable minimum, and each round is a table in the shared folder that replaces the one before.
    Returns ``node`` and ``component``; a node without edges is not in the result.
    """
    now, path = written_at(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                           .where("a <> b").distinct(), "edges")
    state = None
    while True:
        both = now.select("a", "b").union(now.select(F.col("b"), F.col("a"))).toDF("a", "b")
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .union(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        after, new_path = written_at(small, "edges")
        remove(edges.sparkSession, path)
        seen = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == state:
            return after.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.col("b").alias("component")) \
                .union(after.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        state, now, path = seen, after, new_path
