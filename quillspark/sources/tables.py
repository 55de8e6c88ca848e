"""Readers and the shared folder for written intermediate tables."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data directory; columns are pruned and filters pushed by Catalyst."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores for costly work on each row: a small file that cannot be split would keep one
    core busy. Input of at least as many partitions as cores, the case at scale, is not shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, else (tests, local mode) one of our own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = "file://" + os.path.join(tempfile.gettempdir(), "quillspark-shared")
    return path.rstrip("/")


_roots: set[str] = set()


def clean(spark: SparkSession) -> None:
    """Delete the tables this application has cut; tables that are still to be read are gone with them."""
    root = f"{shared_dir(spark)}/quillspark/{spark.sparkContext.applicationId}"
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _clean_at_exit(spark: SparkSession) -> None:
    with contextlib.suppress(Exception):  # the session may be gone
        clean(spark)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: lineage ends here, and
    losing an executor later costs a re-read of files, not a recomputation. The tables of an application are
    deleted by ``clean``, which also runs when the driver's Python ends."""
    spark = df.sparkSession
    root = f"{shared_dir(spark)}/quillspark/{spark.sparkContext.applicationId}"
    if root not in _roots:
        _roots.add(root)
        atexit.register(_clean_at_exit, spark)
    path = f"{root}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
