"""Problem 6: records of one group whose texts are the same but for small edits, insertions, reordering.

Bit-sliced comparison within buckets of a shared rare shingle, see near_pairs. Results: pairs between
records, and one row per record with its group id and number of links. Defined cases: null, empty and
short texts and records without a group do not count; repeated rows of one id count once; copies are
links too; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .linked_splits import components
from .near_pairs import near_pairs

THRESHOLD = 0.5


def _linked(docs: DataFrame, t: float):
    pairs, reps, members = near_pairs(docs, t)
    keys = reps.select("rid", "grp", "h1", "h2", "m")
    linked = pairs.select(F.col("a").alias("rid")).union(pairs.select("b")).distinct()
    wanted = keys.join(linked.withColumn("in_pair", F.lit(True)), "rid", "left").where("m > 1 or in_pair")
    ids = members.join(wanted.select("rid", "grp", "h1", "h2"), ["grp", "h1", "h2"]).select("rid", "id").distinct()
    return pairs, ids


def duplicate_pairs(docs: DataFrame, t: float = THRESHOLD) -> DataFrame:
    """(id_a, id_b), id_a < id_b, of all pairs of records of ``docs(id, grp, side, s)``, copies expanded."""
    pairs, ids = _linked(docs, t)
    a, b = ids.select(F.col("rid").alias("a"), F.col("id").alias("x")), ids.select(F.col("rid").alias("b"), F.col("id").alias("y"))
    between = pairs.select("a", "b").join(a, "a").join(b, "b").where("x <> y")
    within = a.join(b, a["a"] == b["b"]).where("x < y")
    both = between.select("x", "y").union(within.select("x", "y"))
    return both.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def duplicate_groups(docs: DataFrame, t: float = THRESHOLD) -> DataFrame:
    """(id, group_id, n_links): group_id is the least class number linked, over any number of steps;
    n_links counts the records linked directly. Copies are not expanded into pairs."""
    pairs, ids = _linked(docs, t)
    size = ids.groupBy("rid").agg(F.count("*").alias("k"))
    comps = components(pairs.select(F.lpad(F.col("a").cast("string"), 20, "0").alias("a"), F.lpad(F.col("b").cast("string"), 20, "0").alias("b")))
    both = pairs.select("a", "b").union(pairs.select("b", "a"))
    links = both.join(size.withColumnRenamed("rid", "b"), "b").groupBy("a").agg(F.sum("k").alias("others"))
    per = (
        size.join(links, size["rid"] == links["a"], "left")
        .join(comps, F.lpad(F.col("rid").cast("string"), 20, "0") == F.col("node"), "left")
        .select("rid", F.coalesce(F.col("component").cast("long"), "rid").alias("group_id"), (F.col("k") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    )
    return ids.join(per, "rid").select("id", "group_id", "n_links").where("n_links > 0")
