"""Vectorisation and feature selection (V1, V2, V5). Features stay sparse throughout."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import cut
from .describe import exact_percentile

HASHED_DEFAULT = 1 << 18


def hashed(long: DataFrame, n: int = HASHED_DEFAULT) -> DataFrame:
    """V2: (id, slot, value): features hashed to ``n`` non-negative slots by the first 32 bits of their MD5,
    which every engine has; values of a slot added."""
    slot = F.conv(F.substring(F.md5("feature"), 1, 8), 16, 10).cast("bigint") % n
    return long.groupBy("id", slot.cast("int").alias("slot")).agg(F.sum("value").cast("double").alias("value"))


def hashed_vectors(long: DataFrame, n: int = HASHED_DEFAULT) -> DataFrame:
    """V2, V3: (id, features) with ``features`` a sparse vector."""
    from pyspark.ml.linalg import SparseVector, VectorUDT

    @F.udf(VectorUDT())
    def sparse(cells):
        return SparseVector(n, [c["slot"] for c in cells], [c["value"] for c in cells])

    cells = F.array_sort(F.collect_list(F.struct("slot", "value")))
    return hashed(long, n).groupBy("id").agg(cells.alias("cells")).select("id", sparse("cells").alias("features"))


def chi2(long: DataFrame, labels: DataFrame) -> DataFrame:
    """V5: (feature, chi2) with observed = sum of values per class and expected = share of the class times
    the feature's sum. From long features (id, feature, value) and labels (id, y)."""
    priors = labels.groupBy("y").agg(F.count("*").alias("c")).withColumn("share", F.col("c") / F.sum("c").over(Window.partitionBy()))
    obs = long.join(labels, "id").groupBy("feature", "y").agg(F.sum("value").cast("double").alias("o"))
    total = Window.partitionBy("feature")
    cells = obs.withColumn("t", F.sum("o").over(total)).join(F.broadcast(priors.select("y", "share")), "y")
    e = F.col("t") * F.col("share")
    part = cells.groupBy("feature").agg(F.sum((F.col("o") - e) * (F.col("o") - e) / e).alias("seen"), F.max("t").alias("t"), F.sum("share").alias("s"))
    # classes in which the feature does not occur add their expected value
    return part.select("feature", (F.col("seen") + F.col("t") * (1 - F.col("s"))).alias("chi2"))


def selected(scores: DataFrame, percentile: float) -> DataFrame:
    """V5: features above the cut of the upper ``percentile`` share (1.0: all); ties at the cut are kept."""
    if not 0 < percentile <= 1:
        raise ValueError("percentile must be in (0, 1]")
    if percentile == 1:
        return scores.select("feature")
    scores = cut(scores)
    least = exact_percentile(scores, "chi2", 1 - percentile)
    return scores.where(F.col("chi2") >= F.lit(least)).select("feature")
