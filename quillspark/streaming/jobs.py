"""Structured Streaming (R1-R4): incremental naive Bayes, bounded micro-batches, hours of the last two
weeks, growing JSON-lines files. Every job takes its checkpoint folder from the caller; on a cluster it
lies in the shared folder."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.learn import nb_counts
from ..schema import RAW_REVIEW


def review_lines(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """JSON lines that are appended to a folder file by file; a batch holds a bounded number of files."""
    return spark.readStream.schema(RAW_REVIEW).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def windowed_hours(events: DataFrame, time: str = "ts", key: str = "user_id", value: str = "value", late: str = "1 day") -> DataFrame:
    """Sum of ``value`` per key over 14 days, every day; rows later than ``late`` are left out."""
    e = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return e.groupBy(F.window(time, "14 days", "1 day"), key).agg(F.sum(value).alias("hours"))


def deduplicated(stream: DataFrame, id_col: str, time: str, late: str = "7 days") -> DataFrame:
    """Each id once, however often it is fetched again within ``late``."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([id_col])


class NaiveBayesTables:
    """Count tables of naive Bayes that grow with each micro-batch: every batch appends its counts as
    a folder named by the batch, so that a batch that is replayed replaces itself and counts once."""

    def __init__(self, path: str):
        self.path = path

    def update(self, batch: DataFrame, number: int) -> None:
        """``batch(id, y, features map)``."""
        long = batch.select("id", F.explode("features").alias("feature", "value")).where("value > 0")
        feats, classes = nb_counts(long, batch.select("id", "y"))
        feats.write.mode("overwrite").parquet(os.path.join(self.path, "features", f"batch={number}"))
        classes.write.mode("overwrite").parquet(os.path.join(self.path, "classes", f"batch={number}"))

    def start(self, stream: DataFrame, checkpoint: str):
        return stream.writeStream.foreachBatch(self.update).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def tables(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        f = spark.read.parquet(os.path.join(self.path, "features"))
        c = spark.read.parquet(os.path.join(self.path, "classes"))
        return (
            f.groupBy("feature", "y").agg(F.sum("total").alias("total"), F.sum("records").alias("records")),
            c.groupBy("y").agg(F.sum("n").alias("n")),
        )
