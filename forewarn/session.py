"""Session defaults and the shared working folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "forewarn", master: str | None = None,
                  shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the settings the operators expect.

    On a cluster leave ``master`` and ``shuffle_partitions`` unset: AQE coalesces the shuffle
    partitions it does not need and splits the skewed ones.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
        .config("spark.ui.enabled", os.environ.get("FOREWARN_UI", "false"))
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if master and master.startswith("local"):
        builder = builder.config("spark.driver.memory", os.environ.get("FOREWARN_DRIVER_MEMORY", "12g"))
    return builder.getOrCreate()


#: Local folders of this program, and the lists of work tables that are open for removal.
_OWN: list[tempfile.TemporaryDirectory] = []
_OPEN: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local master may go without: a folder is made, set, and removed when the program ends. On a cluster each
    executor would write its part to its own disk, so there a missing setting is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if named:
        if current is None:
            context.setCheckpointDir(named)
        return named
    if current is None:
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("name a folder that all executors share in spark.checkpoint.dir")
        own = tempfile.TemporaryDirectory(prefix="run-", ignore_cleanup_errors=True)
        _OWN.append(own)
        context.setCheckpointDir(own.name)
        current = context.getCheckpointDir()
    return current


def work_path(spark: SparkSession, label: str) -> str:
    """A fresh path for one written table below the shared folder."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    for made in _OPEN:
        made.append(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete one work table, wherever the shared folder is."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def workspace(spark: SparkSession) -> Iterator[list[str]]:
    """Work tables made inside are removed at the end: write or collect the result before."""
    made: list[str] = []
    _OPEN.append(made)
    try:
        yield made
    finally:
        _OPEN.remove(made)
        for path in made:
            remove(spark, path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows survive the loss of any executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
