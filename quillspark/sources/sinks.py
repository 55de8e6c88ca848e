"""Sinks (K1-K10). Tables are written partitioned; text reports are small and built from one row."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import arff_text


def write_json_lines(df: DataFrame, path: str) -> None:
    """K1."""
    df.write.mode("append").json(path)


def write_reviews(df: DataFrame, path: str) -> None:
    """K2: stored by game and partition, each id once."""
    df.dropDuplicates(["id_string"]).write.mode("overwrite").partitionBy("game", "partition").parquet(path)


def write_features(df: DataFrame, path: str) -> None:
    """K3: features as a table of their own; only the partitions written are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("game").parquet(path)


def arff_lines(df: DataFrame, text: str, value: str) -> DataFrame:
    """K4: one data line a row."""
    return df.select(F.concat(F.lit('"'), arff_text(F.col(text)), F.lit('",'), F.col(value).cast("string")).alias("line"))


def arff_header(relation: str, nominal: list[str] | None = None) -> str:
    kind = "{" + ",".join(nominal) + "}" if nominal else "numeric"
    return f"@relation {relation}\n@attribute text string\n@attribute value {kind}\n\n@data"


def _write_lines(spark: SparkSession, lines: list[str], path: str) -> None:
    """A few lines as one text file, on whatever store the path is."""
    spark.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_arff(df: DataFrame, path: str, relation: str, text: str, value: str, nominal: list[str] | None = None) -> None:
    """K4: the header and the lines as text files in the folders ``header`` and ``data``."""
    arff_lines(df, text, value).write.mode("overwrite").text(f"{path}/data")
    _write_lines(df.sparkSession, [arff_header(relation, nominal)], f"{path}/header")


def describe_report(row: dict) -> str:
    """K5: the text of a descriptive report from one aggregate row."""
    lines = [f"Number of reviews: {row['n']}"]
    for name in ("length", "hours"):
        lines += [f"{name} {s}: {row[f'{name}_{s}']:.2f}" for s in ("mean", "min", "max", "std")]
    return "\n".join(lines) + "\n"


def write_csv(df: DataFrame, path: str) -> None:
    """K6, K7: reports of a few rows, one file."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_weights(weights: DataFrame, params: dict, path: str) -> None:
    """K8: weights by falling size, in files that follow each other in that order, and the parameters, in
    the folders ``weights`` and ``params``."""
    rows = weights.orderBy(F.desc(F.abs("weight")), "feature")
    rows.write.mode("overwrite").option("header", True).option("escape", '"').csv(f"{path}/weights")
    _write_lines(weights.sparkSession, [json.dumps(params, sort_keys=True)], f"{path}/params")


def write_model(model: DataFrame, path: str) -> None:
    """K9: a model is its table of counts or weights."""
    model.write.mode("overwrite").parquet(path)
