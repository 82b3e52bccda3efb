"""Session helpers shared by every operator: tables, checkpoints and bounded broadcasts."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Side tables up to this many bytes may be broadcast or collected; beyond it the shuffled way is taken.
SMALL_TABLE_BYTES = 8 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table `name` of the folder `sf_dir`."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Keep the cluster's shared folder; set one of our own only where none is set, and only on a local master, as in tests."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(shared or os.path.join(tempfile.gettempdir(), "quillstream-checkpoints"))


_FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of queries planned and run within are removed as soon as each has ended."""
    before = spark.conf.get(_FREED, "false")
    spark.conf.set(_FREED, "true")
    try:
        yield
    finally:
        spark.conf.set(_FREED, before)


def cut(df: DataFrame) -> DataFrame:
    """`df` written once to the shared checkpoint folder, so that its lineage ends there and its shuffles are freed.

    The files survive the loss of an executor. Empty results are fine.
    """
    ensure_checkpoint_dir(df.sparkSession)
    with shuffles_freed(df.sparkSession):
        return df.select("*").checkpoint(eager=True)


@contextmanager
def kept(df: DataFrame) -> Iterator[DataFrame]:
    """`df` as a table in the shared folder, removed at the end; unlike a checkpoint it is read by columns."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    at = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/table-{uuid.uuid4()}"
    try:
        with shuffles_freed(spark):
            df.select("*").write.parquet(at)
        yield spark.read.schema(df.schema).parquet(at)
    finally:
        remove(spark, at)


def remove(spark: SparkSession, at: str) -> None:
    """A folder and all in it gone."""
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def plan_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of the size of `df`, from file sizes, without running it."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_if_small(df: DataFrame, limit: int = SMALL_TABLE_BYTES) -> DataFrame:
    """Hint a broadcast only where the size is known to be bounded; else leave the choice to the optimizer."""
    return F.broadcast(df) if plan_bytes(df) <= limit else df
