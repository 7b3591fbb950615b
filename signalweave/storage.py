"""Shared scratch space for iterative jobs, and input tables."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def workers_find_package(spark: SparkSession) -> None:
    """Let Python workers import this package where the driver found it; a cluster that ships it needs nothing of this."""
    root = str(Path(__file__).resolve().parent.parent)
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, known]))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    workers_find_package(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; only a local session that names none gets one of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"file://{tempfile.mkdtemp(prefix='signalweave-')}"


class Scratch:
    """Written tables that cut lineage; they outlive lost executors and go when the application ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        path = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write a table once and go on from the files."""
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def keep(self, *names: str) -> None:
        """Free all tables but these, once nothing reads the others."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        for held in fs.listStatus(path):
            if held.getPath().getName() not in names:
                fs.delete(held.getPath(), True)

    def drop(self, name: str) -> None:
        """Free a table that nothing reads any more."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def broadcast_if_small(df: DataFrame, rows: int) -> DataFrame:
    """Hint a broadcast only after counting; beyond ``rows`` the join is left to shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def hot_join(rows: DataFrame, small: DataFrame, key: list[str], n: str) -> DataFrame:
    """``rows`` joined with ``small`` (one row a key: key, ``n``, ...), the hottest keys apart; ``n``: rows of the key.

    A key that has more than a share of 1 in 4 x partitions of the rows can exist
    at most 4 x partitions times, so these keys are broadcast and their rows stay
    where they are; only rows of the others are shuffled. Both inputs are read
    twice: give written tables.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    least = max(1, rows.count() // (4 * parts))
    hot = small.where(F.col(n) > least)
    if not hot.limit(1).count():
        return rows.join(small, key)
    cold = rows.join(F.broadcast(hot.select(*key)), key, "left_anti").join(small.where(F.col(n) <= least), key)
    return rows.join(F.broadcast(hot), key).unionByName(cold)
