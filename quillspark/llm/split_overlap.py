"""Problem 1: evaluation records that stand, the same or almost the same, in the training split.

Word n-gram hashes of the evaluation records are partitioned by hash (rarest first, see near_pairs), the
training records' own rarest are scanned for hits, and for every pair that may reach the Jaccard threshold
the containment of the evaluation record in the training record is computed on the whole sets. An
evaluation record inside a far longer training record does not reach it.

Defined cases: null, empty and short texts and records of no known partition do not count; repeated rows
of one id count once; records of one side only give no rows; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .near_pairs import EVAL, TRAIN, near_pairs

THRESHOLD = 0.5
SHINGLE = 3
MIN_WORDS = 20


def overlaps(docs: DataFrame, t: float = THRESHOLD) -> DataFrame:
    """(id, containment, jaccard, n_classes) of every evaluation record of ``docs(id, side, s)`` with its
    best training class; ``n_classes`` counts the training classes it meets."""
    pairs, reps, members = near_pairs(docs.select("id", F.lit(0).cast("long").alias("grp"), "side", "s"), t)
    side = reps.select("rid", "side")
    both = pairs.select(F.col("a").alias("rid"), F.col("b").alias("other"), F.col("na").alias("n"), F.col("nb").alias("m"), "overlap").union(
        pairs.select("b", "a", "nb", "na", "overlap")
    )
    both = both.join(side.select(F.col("rid").alias("other"), F.col("side").alias("so")), "other").where(F.col("so").bitwiseAND(TRAIN) != 0)
    same = reps.where(F.col("side") == EVAL + TRAIN).select("rid", F.col("n"), F.col("n").alias("m"), F.col("n").alias("overlap"))
    hits = both.select("rid", "n", "m", "overlap").union(same)
    best = hits.groupBy("rid").agg(
        F.max(F.col("overlap") / F.col("n")).alias("containment"),
        F.max(F.col("overlap") / (F.col("n") + F.col("m") - F.col("overlap"))).alias("jaccard"),
        F.count("*").alias("n_classes"),
    )
    keys = reps.select("rid", "h1", "h2").join(best, "rid")
    return (
        members.where(F.col("side").bitwiseAND(EVAL) != 0)
        .join(keys, ["h1", "h2"])
        .groupBy("id")
        .agg(F.max("containment").alias("containment"), F.max("jaccard").alias("jaccard"), F.max("n_classes").alias("n_classes"))
    )
