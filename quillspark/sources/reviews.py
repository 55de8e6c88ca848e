"""Review sources (S1-S12, J1, J8, J10): JSON lines, stored reviews, scans, lookups."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.labels import label_column, label_value
from ..schema import RAW_REVIEW, partition_key
from .tables import table


def json_lines(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """JSON-lines files with the fixed schema; a malformed line is dropped by ``typed_hours``."""
    return spark.read.schema(RAW_REVIEW).json(paths)


def parsed_lines(df: DataFrame, line_col: str = "line") -> DataFrame:
    """S1, M2 on a column of lines: the review's fields beside the other columns; a cut line is all null."""
    r = F.from_json(line_col, RAW_REVIEW)
    return df.withColumn("_r", r).select(*[c for c in df.columns if c != line_col], "_r.*")


def typed_hours(df: DataFrame) -> DataFrame:
    """Rows whose hours are a number."""
    return df.where(F.col("total_game_hours").isNotNull())


def _listed(folder: str, spark: SparkSession | None) -> list[str]:
    """Names in a folder: of any store Spark can reach, or of the local disk without a session."""
    if spark is None:
        if not os.path.isdir(folder):
            raise FileNotFoundError(folder)
        return os.listdir(folder)
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        raise FileNotFoundError(folder)
    return [x.getPath().getName() for x in fs.listStatus(at)]


def game_files(games: str, data_dir: str, sample: str = "sample.jsonlines", spark: SparkSession | None = None) -> list[str]:
    """S3: the files of a comma list of games, or of all; the sample is dropped; none left is an error."""
    if not games.strip():
        raise ValueError("no games given")
    there = sorted(f for f in _listed(data_dir, spark) if f.endswith(".jsonlines"))
    if games.strip() == "all":
        names = there
    else:
        names = [g.strip() if g.strip().endswith(".jsonlines") else g.strip() + ".jsonlines" for g in games.split(",")]
        missing = [n for n in names if n != sample and n not in there]
        if missing:
            raise FileNotFoundError(", ".join(missing))
    names = [n for n in names if n != sample]
    if not names:
        raise ValueError("no game files")
    return names


def stored(spark: SparkSession, sf_dir: str, columns: list[str] | None = None, where: Column | None = None, ids: DataFrame | None = None) -> DataFrame:
    """Stored reviews, each id once: the row stored first. The shuffle carries the asked columns only, and of
    these only the rows that ``where`` and ``ids`` (one column, a semi-join) leave. ``where`` may use columns
    that are equal in all rows of a review (game, partition, texts, addresses), so that it commutes with
    the choice of the row and reaches the scan."""
    df = table(spark, sf_dir, "review")
    cols = [c for c in (df.columns if columns is None else columns) if c != "id_string"]
    if where is not None:
        df = df.where(where)
    if ids is not None:
        df = df.join(ids.select(F.col(ids.columns[0]).alias("id_string")), "id_string", "left_semi")
    w = Window.partitionBy("id_string").orderBy("inserted_at", "num_found_helpful", "num_comments")
    keep = list(dict.fromkeys(["id_string", *cols, "inserted_at", "num_found_helpful", "num_comments"]))
    once = df.select(*keep).withColumn("_k", F.row_number().over(w)).where("_k = 1")
    return once.select("id_string", *cols)


def of_scan(partition: str = "all", games: list[str] | None = None) -> Column:
    """Rows of one partition or all, of some games or all."""
    key = partition_key(partition)
    out = F.lit(True) if key == "all" else stored_partition(F.col("partition")) == key
    return out & F.col("game").isin(*games) if games else out


def stored_partition(p: Column) -> Column:
    """The partition's one spelling; null if it is none."""
    low = F.lower(F.trim(p))
    return F.when(low.isin("train", "training"), "training").when(low.isin("test", "extra"), low)


def partition_scan(df: DataFrame, game: str, partition: str = "all", exclude: tuple[str, ...] = ("nlp_features",)) -> DataFrame:
    """One game, one partition or all, without the large columns."""
    return df.where(of_scan(partition, [game])).drop(*exclude)


def require_rows(df: DataFrame) -> DataFrame:
    """An empty scan is an error."""
    if df.isEmpty():
        raise ValueError("no rows")
    return df


def scan(
    df: DataFrame,
    partition: str = "all",
    games: list[str] | None = None,
    columns: list[str] | None = None,
    sort: str | None = "steam_id_number",
    ids: DataFrame | None = None,
    id_col: str = "id_string",
) -> DataFrame:
    """Partition, games, projection, order (ties by id), and a set of ids as a semi-join."""
    if games or partition_key(partition) != "all":
        df = df.where(of_scan(partition, games))
    if ids is not None:
        df = df.join(ids.select(F.col(ids.columns[0]).alias(id_col)), id_col, "left_semi")
    if sort:
        df = df.orderBy(sort, id_col)
    return df.select(*columns) if columns else df


def label_scan(df: DataFrame, games: list[str] | None, label: str, lognormal: bool = False, power: float | None = None) -> DataFrame:
    """Label values of some games, transformed, nulls dropped."""
    out = df.where(F.col("game").isin(*games)) if games else df
    v = label_value(label_column(df, label), label, lognormal, power)
    return out.select("id_string", v.alias("label")).where("label is not null")


def game_ids(reviews: DataFrame, catalog: DataFrame) -> DataFrame:
    """The catalogue's app id beside each review."""
    return reviews.join(catalog.select("game", F.col("appid").alias("catalog_appid")), "game")


def stored_features(ids: DataFrame, features: DataFrame, key: str = "id_string") -> DataFrame:
    """Features of each id; null if there are none."""
    return ids.join(features, key, "left")


def page_offsets(n_rows: int, limit: int = -1, step: int = 10) -> list[tuple[int, int]]:
    """(page, offset) of a paged listing, up to ``limit`` rows."""
    n = n_rows if limit < 0 else min(n_rows, limit)
    return [(i // step + 1, i) for i in range(0, n, step)]
