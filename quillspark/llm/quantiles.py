"""Problem 5: percentiles per group with a stated rank-error bound, in a form that can be joined.

Randomized compactor hierarchies (KLL sketches, Spark's JVM aggregates): every level keeps a sorted
buffer, a full level passes every other value, odd or even at random, to the next; two sketches merge
level by level. Map-side partial sketches keep the shuffle at one sketch per task and group, so a
group that holds a third of all rows never gathers its values in one task.

Rank error: with probability 0.99 a reported value's rank is off by at most ``rank_error(k)`` times n
(single query, the published fit for this sketch family); groups that fit the base level are exact.

Defined cases: null, NaN, negative values and rows without group or day are left out; repeated rows of
one id count once, by the earliest row (ties: the smaller value), so a day's sketch never changes when later days
arrive; infinite values count as very large; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PERCENTS = (50, 90, 95, 99)
K = 2048


def rank_error(k: int = K) -> float:
    """Normalised rank error at 99 % confidence, the published empirical fit 2.296 / k^0.9723."""
    return 2.296 / k**0.9723


def first_rows(df: DataFrame, id_col: str, time_col: str, value_col: str, group_col: str) -> DataFrame:
    """(grp, day, value): one row per id, the earliest."""
    one = (
        df.select(id_col, F.struct(F.col(time_col).alias("t"), F.col(value_col).alias("v"), F.col(group_col).alias("g")).alias("r"))
        .groupBy(id_col)
        .agg(F.min("r").alias("r"))
    )
    value = F.col("r.v")
    return one.where(value.isNotNull() & ~F.isnan(value) & (value >= 0) & F.col("r.g").isNotNull()).select(
        F.col("r.g").alias("grp"), F.to_date("r.t").alias("day"), value.alias("value")
    )


def day_sketches(values: DataFrame, k: int = K) -> DataFrame:
    """(grp, day, n, sketch): one mergeable sketch per group and day."""
    return values.groupBy("grp", "day").agg(
        F.count("value").alias("n"), F.kll_sketch_agg_double("value", F.lit(k)).alias("sketch")
    )


def merge_sketches(sketches: DataFrame, k: int = K, by: tuple[str, ...] = ("grp",)) -> DataFrame:
    """Join sketches of separate days or partitions into one per group."""
    return sketches.groupBy(*by).agg(
        F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", F.lit(k)).alias("sketch")
    )


def answer(sketches: DataFrame, percents: tuple[int, ...] = PERCENTS, k: int = K) -> DataFrame:
    """Percentiles of each sketch; ``rank_error`` is the bound that holds for the row (0 if exact)."""
    return sketches.select(
        *[c for c in sketches.columns if c != "sketch"],
        *[F.kll_sketch_get_quantile_double("sketch", F.lit(p / 100)).alias(f"p{p}") for p in percents],
        F.when(F.col("n") <= k, F.lit(0.0)).otherwise(F.lit(rank_error(k))).alias("rank_error"),
    )


def outside_bound(values: DataFrame, answers: DataFrame, percents: tuple[int, ...] = PERCENTS) -> DataFrame:
    """(grp, n, n_outside): how many of a group's answers lie beyond their ``rank_error``, by exact ranks.
    ``answers`` has one row a group; the ranks are counts, added up before they are shuffled."""
    p = [f"p{x}" for x in percents]
    ranks = (
        values.join(answers.select("grp", "rank_error", *p), "grp")
        .groupBy("grp")
        .agg(F.count("*").alias("n"), F.first("rank_error").alias("e"), *[f(c) for c in p for f in (_below, _up_to)])
    )
    beyond = [((F.col(f"{c}_lt") > (x / 100 + F.col("e")) * F.col("n") + 1) | (F.col(f"{c}_le") < (x / 100 - F.col("e")) * F.col("n") - 1)).cast("int") for x, c in zip(percents, p)]
    return ranks.select("grp", "n", sum(beyond[1:], beyond[0]).alias("n_outside"))


def _below(c: str):
    return F.sum((F.col("value") < F.col(c)).cast("long")).alias(f"{c}_lt")


def _up_to(c: str):
    return F.sum((F.col("value") <= F.col(c)).cast("long")).alias(f"{c}_le")
