"""Evaluation of predictions (A10, A11, E1-E13). Input: predictions(learner, fold, y, p); rows with a null
or NaN label or prediction do not count. Everything is computed from the confusion table, whose size is
bounded by the number of classes, not of rows - except the rank correlations of raw values.

Definitions where a library was the model: kappa = 1 - sum(w obs) / sum(w exp) over the full range of
labels from least to greatest; off by one means distance max(|i - j| - 1, 0); tau is tau-b; a precision
without predictions is 0; the least frequent class is that of the least support, ties: the smallest.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["learner", "fold"]


def usable(preds: DataFrame) -> DataFrame:
    """Predictions that count: each (learner, fold, id) once, numbers in both columns."""
    ok = ~F.isnan("y") & ~F.isnan("p")
    return preds.where(F.col("y").isNotNull() & F.col("p").isNotNull() & ok).dropDuplicates(["learner", "fold", "id"])


def rounded(preds: DataFrame) -> DataFrame:
    """Labels and predictions rounded half to even (-0 is 0)."""
    return preds.withColumn("y", F.rint("y") + 0.0).withColumn("p", F.rint("p") + 0.0)


def confusion(preds: DataFrame, by: list[str] = KEYS) -> DataFrame:
    """A10: (by, actual, predicted, n), only cells that occur."""
    return rounded(preds).groupBy(*by, F.col("y").alias("actual"), F.col("p").alias("predicted")).agg(F.count("*").alias("n"))


def full_confusion(conf: DataFrame, by: list[str] = KEYS) -> DataFrame:
    """A10: all cells of the sorted union of labels."""
    labels = conf.groupBy(*by).agg(F.array_sort(F.array_union(F.collect_set("actual"), F.collect_set("predicted"))).alias("l"))
    grid = labels.select(*by, "l", F.explode("l").alias("actual")).select(*by, "actual", F.explode("l").alias("predicted"))
    return grid.join(conf, [*by, "actual", "predicted"], "left").fillna(0, ["n"])


def per_class(conf: DataFrame, by: list[str] = KEYS) -> DataFrame:
    """(by, label, support, predicted, hits, precision, recall, f1)."""
    rows = conf.select(*by, F.col("actual").alias("label"), F.col("n").alias("s"), F.lit(0).alias("q"), F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0).alias("h"))
    cols = conf.select(*by, F.col("predicted").alias("label"), F.lit(0).alias("s"), F.col("n").alias("q"), F.lit(0).alias("h"))
    c = rows.unionByName(cols).groupBy(*by, "label").agg(F.sum("s").alias("support"), F.sum("q").alias("predicted"), F.sum("h").alias("hits"))
    zero = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    return c.withColumn("precision", zero(F.col("hits"), F.col("predicted"))).withColumn("recall", zero(F.col("hits"), F.col("support"))).withColumn(
        "f1", zero(2 * F.col("hits"), F.col("predicted") + F.col("support"))
    )


def class_scores(conf: DataFrame, by: list[str] = KEYS) -> DataFrame:
    """Accuracy; precision and F1, macro and weighted; F1 of the least frequent true class."""
    c = per_class(conf, by)
    w = F.sum("support")
    return c.groupBy(*by).agg(
        (F.sum("hits") / w).alias("accuracy"),
        F.avg("precision").alias("precision_macro"),
        (F.sum(F.col("precision") * F.col("support")) / w).alias("precision_weighted"),
        F.avg("f1").alias("f1_macro"),
        (F.sum(F.col("f1") * F.col("support")) / w).alias("f1_weighted"),
        F.avg("recall").alias("recall_macro"),
        F.min_by("f1", F.when(F.col("support") > 0, F.struct("support", "label"))).alias("f1_score_least_frequent"),
    )


def kappas(conf: DataFrame, by: list[str] = KEYS) -> DataFrame:
    """E5: uwk, lwk, qwk and their off-by-one forms. Null if there is one label only. Expected weights come
    from the two margins, (labels)^2 rows a group."""
    n = conf.groupBy(*by).agg(F.sum("n").alias("total"))
    rows = conf.groupBy(*by, F.col("actual")).agg(F.sum("n").alias("r"))
    cols = conf.groupBy(*by, F.col("predicted")).agg(F.sum("n").alias("c"))
    exp = rows.join(cols, by).join(n, by).select(*by, "actual", "predicted", F.lit(0.0).alias("obs"), (F.col("r") * F.col("c") / F.col("total")).alias("exp"))
    obs = conf.select(*by, "actual", "predicted", F.col("n").cast("double").alias("obs"), F.lit(0.0).alias("exp"))
    d = F.abs(F.col("actual") - F.col("predicted"))
    off = F.greatest(d - 1, F.lit(0.0))
    weights = {}
    for suffix, x in (("", d), ("_off_by_one", off)):
        weights["uwk" + suffix] = F.when(x == 0, 0.0).otherwise(1.0)
        weights["lwk" + suffix] = x
        weights["qwk" + suffix] = x * x
    aggs = [(1 - F.try_divide(F.sum(w * F.col("obs")), F.sum(w * F.col("exp")))).alias(k) for k, w in weights.items()]
    return obs.unionByName(exp).groupBy(*by).agg(*aggs)


def _r(n: Column, sx, sy, sxx, syy, sxy) -> Column:
    num = n * sxy - sx * sy
    return F.try_divide(num, F.sqrt((n * sxx - sx * sx) * (n * syy - sy * sy)))


def pearson(df: DataFrame, x: str, y: str, by: list[str] = KEYS) -> DataFrame:
    """(by, n, r) by explicit sums; null if either is constant."""
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    return df.groupBy(*by).agg(
        F.count("*").alias("n"), _r(F.count("*").cast("double"), F.sum(a), F.sum(b), F.sum(a * a), F.sum(b * b), F.sum(a * b)).alias("r")
    )


def _incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta by continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _incomplete_beta(b, a, 1 - x)
    front = math.exp(a * math.log(x) + b * math.log1p(-x) - math.lgamma(a) - math.lgamma(b) + math.lgamma(a + b)) / a
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    f = d
    for m in range(1, 400):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for num in (even, odd):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            f *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * f


def pearson_p(n: int, r: float | None) -> float | None:
    """Two-sided p of r under no correlation, from Student's t as an incomplete beta."""
    if r is None or n < 3:
        return None
    if abs(r) >= 1:
        return 0.0
    df = n - 2
    return _incomplete_beta(df / 2, 0.5, df / (df + r * r * df / (1 - r * r)))


def with_p(corr: DataFrame) -> DataFrame:
    """``significance`` beside n and r; one row a group, so a plain function on few rows."""
    return corr.withColumn("significance", F.udf(pearson_p, "double")("n", "r"))


def average_ranks(df: DataFrame, value: str, by: list[str] = KEYS) -> DataFrame:
    """Ranks of ``value`` per group, ties averaged, from counts per distinct value."""
    c = df.groupBy(*by, value).agg(F.count("*").alias("_c"))
    below = F.coalesce(F.sum("_c").over(Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return c.select(*by, value, (below + (F.col("_c") + 1) / 2).alias(f"rank_{value}"))


def spearman(df: DataFrame, by: list[str] = KEYS) -> DataFrame:
    """Pearson's r of average ranks."""
    j = df.join(average_ranks(df, "y", by), [*by, "y"]).join(average_ranks(df, "p", by), [*by, "p"])
    return pearson(j, "rank_y", "rank_p", by).withColumnRenamed("r", "rho")


def kendall(conf: DataFrame, by: list[str] = KEYS) -> DataFrame:
    """Tau-b from the confusion cells: concordant and discordant pairs of cells, labels^4 at most."""
    a = conf.select(*by, F.col("actual").alias("a1"), F.col("predicted").alias("p1"), F.col("n").alias("n1"))
    b = conf.select(*by, F.col("actual").alias("a2"), F.col("predicted").alias("p2"), F.col("n").alias("n2"))
    s = F.signum(F.col("a1") - F.col("a2")) * F.signum(F.col("p1") - F.col("p2"))
    cd = a.join(b, by).groupBy(*by).agg((F.sum(s * F.col("n1") * F.col("n2")) / 2).alias("cd"))
    pairs = lambda c: F.sum(F.col(c) * (F.col(c) - 1)) / 2
    n = conf.groupBy(*by).agg(F.sum("n").alias("n"))
    ty = conf.groupBy(*by, "actual").agg(F.sum("n").alias("r")).groupBy(*by).agg(pairs("r").alias("ty"))
    tp = conf.groupBy(*by, "predicted").agg(F.sum("n").alias("c")).groupBy(*by).agg(pairs("c").alias("tp"))
    all_ = F.col("n") * (F.col("n") - 1) / 2
    return n.join(ty, by).join(tp, by).join(cd, by).select(
        *by, F.try_divide("cd", F.sqrt((all_ - F.col("ty")) * (all_ - F.col("tp")))).alias("tau")
    )


def evaluation(preds: DataFrame, by: list[str] = KEYS) -> DataFrame:
    """All metrics in one row a group."""
    good = usable(preds)
    conf = confusion(good, by)
    out = class_scores(conf, by).join(kappas(conf, by), by).join(kendall(conf, by).withColumnRenamed("tau", "kendall_tau_rounded"), by)
    for name, df in (("unrounded", good), ("rounded", rounded(good))):
        out = out.join(pearson(df, "y", "p", by).select(*by, F.col("r").alias(f"pearson_r_{name}")), by)
        out = out.join(spearman(df, by).select(*by, F.col("rho").alias(f"spearman_{name}")), by)
    return out


def matrices(conf: DataFrame, by: list[str] = KEYS) -> DataFrame:
    """A10: the confusion matrix as array<array<long>>, rows and columns in order of label."""
    rows = full_confusion(conf, by).groupBy(*by, "actual").agg(F.array_sort(F.collect_list(F.struct("predicted", "n"))).alias("r"))
    m = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("actual", F.transform("r", lambda x: x["n"]).alias("v")))).alias("m"))
    return m.select(*by, F.transform("m", lambda x: x["v"]).alias("confusion_matrix"), F.transform("m", lambda x: x["actual"]).alias("labels"))


def printable(conf: DataFrame, by: list[str] = KEYS) -> DataFrame:
    """The matrix as text, tab separated, with the labels that are in it."""
    line = lambda h, xs: F.concat_ws("\t", h, F.transform(xs, lambda x: x.cast("bigint").cast("string")))
    m = matrices(conf, by)
    body = F.transform(F.arrays_zip("labels", "confusion_matrix"), lambda r: line(r["labels"].cast("bigint").cast("string"), r["confusion_matrix"]))
    return m.select(*by, F.concat_ws("\n", line(F.lit(""), F.col("labels")), F.array_join(body, "\n")).alias("printable"))


def across_folds(metrics: DataFrame) -> DataFrame:
    """Mean of every metric over a learner's folds."""
    names = [c for c in metrics.columns if c not in KEYS]
    return metrics.groupBy("learner").agg(F.count("*").alias("folds"), *[F.avg(c).alias(c) for c in names])


def mean_confusion(conf: DataFrame) -> DataFrame:
    """Element-wise mean of the folds' confusion matrices, cells that are missing in a fold being 0."""
    n = conf.groupBy("learner").agg(F.countDistinct("fold").alias("k"))
    return conf.groupBy("learner", "actual", "predicted").agg(F.sum("n").alias("n")).join(n, "learner").select(
        "learner", "actual", "predicted", (F.col("n") / F.col("k")).alias("mean_n")
    )


def ranked(metrics: DataFrame, objective: str) -> DataFrame:
    """Learners by falling objective."""
    w = Window.orderBy(F.desc(objective), "learner")
    return metrics.select("learner", objective, F.row_number().over(w).alias("place"))
