"""Sessions, tables and the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def session(name: str = "lexiloom", **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC; further settings as keywords with ``__`` for dots."""
    b = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` of a table for work that is heavy for each row: dealt to all cores if its files have fewer parts with rows.

    A table of as many files as cores, or of enough row groups, stays as it is: nothing is shuffled at scale. The
    parts are counted without reading a column, and only where the files are few.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if len(df.inputFiles()) >= cores or df.select(F.spark_partition_id().alias("p")).distinct().count() >= cores:
        return df
    return df.repartition(cores)


def resident(df: DataFrame) -> DataFrame:
    """``df`` kept in memory between passes, on disk where it does not fit; ``unpersist`` lets it go."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only on a local master, where it is unset, a fresh folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the executors share")
        base = "file://" + tempfile.mkdtemp(prefix="lexiloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: its lineage ends there."""
    path = f"{shared_folder(df.sparkSession)}/lexiloom/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
