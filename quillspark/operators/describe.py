"""Aggregations."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def distribution(df: DataFrame, label: str = "label") -> DataFrame:
    """A1, A2: rows and share of each label value."""
    n = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def described(df: DataFrame, text: str, hours: str) -> DataFrame:
    """A3: number, mean, least, greatest and population deviation of text length and hours."""
    aggs = [F.count("*").alias("n")]
    for name, c in (("length", F.length(text)), ("hours", F.col(hours))):
        c = c.cast("double")
        aggs += [F.avg(c).alias(f"{name}_mean"), F.min(c).alias(f"{name}_min"), F.max(c).alias(f"{name}_max"), F.stddev_pop(c).alias(f"{name}_std")]
    return df.agg(*aggs)


def histogram(df: DataFrame, value: str, bins: int = 10) -> DataFrame:
    """``bins`` equal widths from least to greatest, the last closed. The limits are scalar
    subqueries; the values are shuffled as counts only."""
    lo = df.agg(F.min(value).cast("double")).scalar()
    hi = df.agg(F.max(value).cast("double")).scalar()
    v = F.col(value).cast("double")
    at = F.least(F.coalesce(F.floor(F.try_divide(v - lo, (hi - lo) / bins)), F.lit(0)), F.lit(bins - 1))  # one value only: bin 0
    return (
        df.where(F.col(value).isNotNull())
        .select(at.cast("int").alias("bin"))
        .groupBy("bin")
        .agg(F.count("*").alias("n"))
    )


def ceil_histogram(df: DataFrame, value: str, width: float) -> DataFrame:
    """Counts of values rounded up to a multiple of ``width``."""
    return df.where(F.col(value).isNotNull()).groupBy((F.ceil(F.col(value) / width) * width).cast("double").alias("upper")).agg(F.count("*").alias("n"))


def coverage(df: DataFrame, value: str, cap: float, least: float = 0.9) -> DataFrame:
    """Share of rows up to ``cap``, and whether it is enough."""
    share = df.agg(F.avg((F.col(value) <= cap).cast("int")).alias("share"))
    return share.withColumn("covered", F.col("share") >= least)


def exact_percentile(df: DataFrame, value: str, p: float, slack: float = 0.001) -> float | None:
    """The exact percentile (between two values, in proportion) of all rows, without gathering them: a sketch
    of fixed size gives limits around it, the rows below are counted, and only the distinct values between the
    limits, about 2 ``slack`` of the rows, are ordered. Null without rows."""
    v = F.col(value)
    rows = df.where(v.isNotNull()).select(v.cast("double").alias("v"))
    around = [max(0.0, p - slack), min(1.0, p + slack)]
    n, limits = rows.agg(F.count("*"), F.percentile_approx("v", around, 10 * int(1 / slack))).first()
    if not n:
        return None
    at = (n - 1) * p
    first = math.floor(at)
    lo, hi = limits
    for _ in range(2):
        below = rows.where(F.col("v") < lo).count()
        counts = rows.where(F.col("v").between(lo, hi)).groupBy("v").agg(F.count("*").alias("c"))
        up = counts.withColumn("upto", F.sum("c").over(Window.orderBy("v")) + below)
        a, b = up.agg(F.min(F.when(F.col("upto") > first, F.col("v"))), F.min(F.when(F.col("upto") > min(first + 1, n - 1), F.col("v")))).first()
        if below <= first and a is not None and b is not None:
            return a + (b - a) * (at - first)
        lo, hi = float("-inf"), float("inf")  # the sketch missed: order all distinct values
    raise AssertionError("no value at the rank")


def moments(df: DataFrame, value: str) -> DataFrame:
    """N, extremes, population deviation, mean, median, mode (ties: the smallest), skewness,
    kurtosis and the K2-style Jarque-Bera statistic, from explicit moments (two passes, both of sums)."""
    v = F.col(value).cast("double")
    base = df.where(v.isNotNull() & ~F.isnan(v)).select(v.alias("v"))
    m = base.agg(F.avg("v")).scalar()
    mode = base.groupBy("v").agg(F.count("*").alias("c")).agg(F.max_by("v", F.struct(F.col("c"), -F.col("v"))).alias("mode"))
    d = F.col("v") - F.col("m")
    out = base.withColumn("m", m).agg(
        F.count("*").alias("n"),
        F.min("v").alias("min"),
        F.max("v").alias("max"),
        F.first("m").alias("mean"),
        F.lit(exact_percentile(base, "v", 0.5)).cast("double").alias("median"),
        F.avg(d * d).alias("m2"),
        F.avg(d * d * d).alias("m3"),
        F.avg(d * d * d * d).alias("m4"),
    )
    skew = F.try_divide(F.col("m3"), F.pow("m2", F.lit(1.5)))
    kurt = F.try_divide(F.col("m4"), F.col("m2") * F.col("m2"))
    return out.withColumn("mode", mode.scalar()).select(
        "n", "min", "max", F.sqrt("m2").alias("std"), "mean", "median", "mode", skew.alias("skewness"), kurt.alias("kurtosis"),
        (F.col("n") / 6 * (skew * skew + (kurt - 3) * (kurt - 3) / 4)).alias("jarque_bera"),
    )


def zscores(df: DataFrame, value: str) -> DataFrame:
    """(v - mean) / population deviation; null if all values are equal."""
    m, s = df.agg(F.avg(value)).scalar(), df.agg(F.stddev_pop(value)).scalar()
    return df.withColumn("z", F.try_divide(F.col(value) - m, s))


def majority(df: DataFrame, by: list[str], label: str) -> DataFrame:
    """The most frequent label per group; ties: the smallest."""
    return df.groupBy(*by, label).agg(F.count("*").alias("n")).groupBy(*by).agg(
        F.max_by(label, F.struct(F.col("n"), -F.col(label))).alias("majority"), F.max("n").alias("n"), F.sum("n").alias("total")
    )


def classes(df: DataFrame, label: str) -> DataFrame:
    """The distinct labels."""
    return df.where(F.col(label).isNotNull()).select(label).distinct()


def same_classes(a: DataFrame, b: DataFrame, label: str) -> bool:
    """Whether both have the same labels."""
    ca, cb = classes(a, label), classes(b, label)
    return ca.exceptAll(cb).isEmpty() and cb.exceptAll(ca).isEmpty()
