"""Readers for the given tables and the shared working folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Give a CPU-heavy stage at least one partition per core.

    Does nothing when the input already splits that finely, which is always so
    for a large corpus; small inputs are redistributed by key while they are
    still narrow.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, *keys)


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder below the one the cluster names; local sessions may use a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="scanfold-")
    return os.path.join(base, f"run-{uuid.uuid4().hex}")


def staged(df: DataFrame) -> DataFrame:
    """Write a result that several branches need, and go on from the written table.

    Cuts the lineage at a place executors share: later jobs re-read files
    instead of repeating the scan, also after a lost executor.
    """
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a table that ``staged`` wrote, once what was made of it is written too."""
    spark = df.sparkSession
    for folder in {os.path.dirname(name) for name in df.inputFiles()}:
        if os.path.basename(folder).startswith("run-"):
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
