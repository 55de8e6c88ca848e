"""Deterministic sampling.

Random order is order by md5(seed:id), so every engine draws the same rows. Ranks within a label or game
are taken in two steps (``ranked``), so that a label of a third of all rows is spread over tasks; what a rank
needs from the whole (quotas, available rows) are counts per label, a table of a few rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Hexadecimal digits of a hash that make a slice: 4,096 slices of a label.
SLICE_CHARS = 3


def order_key(seed: int, id_col: str = "id") -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))


def ranked(df: DataFrame, by: str, key: Column, id_col: str) -> DataFrame:
    """``df`` with ``_rn``, the 1-based rank of each row within ``by`` in order of the string ``key``, then id,
    and ``_of``, the number of rows of ``by``. Rows are numbered within slices of equal first characters of
    the key and moved up by the number of rows in the slices before; one exchange serves both."""
    rows = df.withColumn("_key", key).withColumn("_slice", F.substring("_key", 1, SLICE_CHARS))
    size = rows.groupBy(by, "_slice").agg(F.count("*").alias("_n"))
    up = Window.partitionBy(by).orderBy("_slice")
    before = size.select(
        F.col(by).alias("_by"), F.col("_slice").alias("_at"), (F.sum("_n").over(up) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy(by)).alias("_of")
    )
    within = rows.withColumn("_k", F.row_number().over(Window.partitionBy(by, "_slice").orderBy("_key", id_col)))
    return within.join(before, within[by].eqNullSafe(before["_by"]) & (within["_slice"] == before["_at"])).select(*df.columns, (F.col("_k") + F.col("_before")).alias("_rn"), "_of")


def train_test_extra(df: DataFrame, group: str, max_size: int, percent: float, id_col: str = "id", seed: int = 1, extra_train_row: bool = True) -> DataFrame:
    """Per group the first ``max_size`` rows in hash order, ceil(n * percent / 100) of them (one more
    with ``extra_train_row``, as stored reviews were split) training, the rest test; beyond, extra."""
    n = F.least("_of", F.lit(max_size))
    cut = F.ceil(n * percent / 100) + (1 if extra_train_row else 0)
    split = F.when(F.col("_rn") > max_size, "extra").when(F.col("_rn") <= cut, "training").otherwise("test")
    return ranked(df, group, order_key(seed, id_col), id_col).select(*df.columns, split.alias("split"))


def quotas(df: DataFrame, label: str, size: int, sampling: str, folds: int = 1) -> DataFrame:
    """(label, cnt, quota) rows per fold of ``size``. even: ceil(size / labels), capped by what the
    rarest label supplies to a fold; stratified: ceil(share * size), all shrunk alike when a label
    is too rare for that."""
    c = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("cnt"))
    all_ = Window.partitionBy()
    if sampling == "even":
        q = F.least(F.ceil(F.lit(size) / F.count("*").over(all_)), F.floor(F.min("cnt").over(all_) / folds))
        return c.withColumn("quota", q.cast("int"))
    if sampling != "stratified":
        raise ValueError("sampling must be even or stratified")
    c = c.withColumn("want", F.ceil(F.col("cnt") * size / F.sum("cnt").over(all_)))
    shrink = F.least(F.lit(1.0), F.min(F.floor(F.col("cnt") / folds) / F.col("want")).over(all_))
    return c.withColumn("_s", shrink).withColumn("quota", F.greatest(F.floor(F.col("want") * F.col("_s")), F.lit(0)).cast("int")).select(label, "cnt", "quota")


def folds(df: DataFrame, label: str, n_folds: int, size: int, sampling: str = "even", id_col: str = "id", seed: int = 12345, set_name: str = "training_set") -> DataFrame:
    """(set_name, fold, pos, id) of disjoint folds: the rank within a label, in hash order, says
    the fold, so no row is removed and looked for again. A fold is cut to ``size`` in hash order."""
    q = quotas(df, label, size, sampling, n_folds)
    rows = ranked(df.where(F.col(label).isNotNull()).select(F.col(id_col).alias("id"), label), label, order_key(seed, "id"), "id")
    got = rows.join(F.broadcast(q), label).where(F.col("_rn") <= F.col("quota") * n_folds)
    got = got.withColumn("fold", F.floor((F.col("_rn") - 1) / F.col("quota")).cast("int") + 1)
    pos = F.row_number().over(Window.partitionBy("fold").orderBy(order_key(seed + 1, "id"), "id")) - 1
    return got.withColumn("pos", pos).where(F.col("pos") < size).select(F.lit(set_name).alias("set_name"), "fold", "pos", "id")


def enough_folds(n_got: int, n_wanted: int) -> bool:
    """At least 75 % of the folds asked for."""
    return n_got >= 0.75 * n_wanted


def layered(
    df: DataFrame, label: str, test: int = 0, training: tuple[int, int] = (0, 0), grid: tuple[int, int] = (0, 0), sampling: str = "even", id_col: str = "id", seed: int = 12345
) -> DataFrame:
    """Test set, then training folds, then grid-search folds, each from the rows the former left."""
    check_plan(training, grid, test, sampling)
    out, left = None, df
    for name, (k, size) in (("test_set", (1 if test else 0, test)), ("training_set", training), ("grid_search_set", grid)):
        if not k:
            continue
        part = folds(left, label, k, size, sampling, id_col, seed, name)
        left = without(left, part, id_col)
        out = part if out is None else out.unionByName(part)
    return out


def check_plan(training: tuple[int, int], grid: tuple[int, int], test: int, sampling: str) -> None:
    """A number of folds needs a size and the other way round; nothing may be negative."""
    if sampling not in ("even", "stratified"):
        raise ValueError("unknown sampling")
    for k, size in (training, grid):
        if k < 0 or size < 0 or bool(k) != bool(size):
            raise ValueError("folds and fold size must both be positive or both 0")
    if test < 0 or not (training[0] or grid[0] or test):
        raise ValueError("nothing to sample")


def within(df: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """Semi-join to a set of ids."""
    return df.join(ids.select(F.col("id").alias(id_col)), id_col, "left_semi")


def without(df: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """Anti-join to ids already used."""
    return df.join(ids.select(F.col("id").alias(id_col)), id_col, "left_anti")


def labels_of(df: DataFrame, label: str, id_col: str = "id") -> DataFrame:
    """Sorted ids of every label, as rows (label, pos, id) rather than one array a label, which would
    gather a hot label in one row."""
    rows = ranked(df.where(F.col(label).isNotNull()).select(label, id_col), label, F.col(id_col), id_col)
    return rows.select(label, (F.col("_rn") - 1).alias("pos"), F.col(id_col).alias("id"))


def round_robin(df: DataFrame, label: str, id_col: str = "id", seed: int = 12345) -> DataFrame:
    """(turn, label, id): one id of every label, then the next of every label, until all are out."""
    rows = ranked(df.where(F.col(label).isNotNull()).select(label, id_col), label, order_key(seed, id_col), id_col)
    return rows.select(F.col("_rn").alias("turn"), label, F.col(id_col).alias("id")).orderBy("turn", label)


def leave_one_out(fold_set: DataFrame) -> DataFrame:
    """(held_out, fold) training folds of each split; the folds are a handful of numbers."""
    f = fold_set.agg(F.array_sort(F.collect_set("fold")).alias("f"))
    pairs = f.select("f", F.explode("f").alias("held_out")).select("held_out", F.explode("f").alias("fold"))
    return pairs.where("held_out <> fold")


def stratified_kfold(df: DataFrame, label: str, k: int, id_col: str = "id", seed: int = 12345) -> DataFrame:
    """Fold number by the rank within the label, in turn."""
    rows = ranked(df.where(F.col(label).isNotNull()).select(F.col(id_col).alias("id"), label), label, order_key(seed, "id"), "id")
    return rows.select("id", label, ((F.col("_rn") - 1) % k).cast("int").alias("fold"))


def top_weights(weights: DataFrame, n: int, multiclass: bool = True) -> DataFrame:
    """By falling absolute weight, zero weights removed with several classes only."""
    w = weights.where("weight <> 0") if multiclass else weights
    return w.orderBy(F.desc(F.abs("weight")), *[c for c in w.columns if c != "weight"]).limit(n)
