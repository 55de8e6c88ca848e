"""Feature assembly and extraction."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from ..functions.labels import label_column, label_value
from ..schema import LABELS

FAMILIES = ("length", "word", "char", "cluster", "dep")


def truthy(v: Column) -> Column:
    """0, empty and null are dropped; NaN stays."""
    return v.isNotNull() & ((v != 0) | F.isnan(v))


def label_map(df: DataFrame, labels: tuple[str, ...] = LABELS) -> Column:
    """map<string,double> of the record's labels, top level and nested."""
    names = F.array(*[F.lit(n) for n in labels])
    return F.map_from_arrays(names, F.array(*[label_column(df, n).cast("double") for n in labels]))


def all_features(df: DataFrame, target: str, nlp: bool = True, nlp_col: str = "nlp_features") -> Column:
    """Text features and labels that are not falsy, in one map; a label wins over a text feature of
    its name; null if the target is missing or 0."""
    m = label_map(df)
    if nlp:
        own = F.array(*[F.lit(n) for n in LABELS])
        text = F.map_filter(F.coalesce(F.col(nlp_col), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<int>"))), lambda k, v: ~F.array_contains(own, k))
        m = F.map_concat(F.transform_values(text, lambda k, v: v.cast("double")), m)
    return F.when(truthy(label_column(df, target).cast("double")), F.map_filter(m, lambda k, v: truthy(v)))


def data_points(df: DataFrame, target: str, nlp: bool = True, attributes: tuple[str, ...] = (), lognormal=False, power=None, ranges=None, id_col: str = "id_string") -> DataFrame:
    """P5: (y, id, x): transformed target, and the features without target and unwanted labels; records
    without features are dropped."""
    wanted = [a for a in attributes if a != target]
    unwanted = F.array(*[F.lit(n) for n in LABELS if n not in wanted])
    x = F.map_filter(all_features(df, target, nlp), lambda k, v: ~F.array_contains(unwanted, k))
    y = label_value(label_column(df, target), target, lognormal, power, ranges).cast("double")
    return df.select(y.alias("y"), F.col(id_col).alias("id"), x.alias("x")).where(F.size("x") > 0)


def fixed_attributes(df: DataFrame) -> DataFrame:
    """Attributes that are no text, with ``updated``: 1 if the review was ever updated."""
    top = [n for n in LABELS if n in df.columns]
    return df.select("id_string", *top, "rating", F.col("date_updated").isNotNull().cast("int").alias("updated"))


def _counted(n: Callable[[dict], dict[str, int]], df: DataFrame, columns: dict[str, Column], id_col: str) -> DataFrame:
    """(id, features array<struct<feature, value>>, sorted by name) by ``n`` from each row's ``columns``: a
    row's features are counted where the row lies, nothing is shuffled. Null or empty: no features."""
    rows = df.select(F.col(id_col).alias("id"), *[c.alias(k) for k, c in columns.items()])
    names = list(columns)

    def run(batches):
        for b in batches:
            cols = [b.column(i + 1).to_pylist() for i in range(len(names))]
            size, feature, value = [0], [], []
            for row in zip(*cols):
                got = n(dict(zip(names, row)))
                keys = sorted(got)
                feature += keys
                value += [got[k] for k in keys]
                size.append(len(feature))
            items = pa.StructArray.from_arrays([pa.array(feature, pa.string()), pa.array(value, pa.int32())], ["feature", "value"])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(size, pa.int32()), items)], ["id", "features"])

    one = T.StructType([T.StructField("feature", T.StringType()), T.StructField("value", T.IntegerType())])
    return rows.mapInArrow(run, T.StructType([rows.schema["id"], T.StructField("features", T.ArrayType(one))]))


def _char_counts(text: str | None, lo: int, hi: int) -> Counter:
    t = text or ""
    return Counter(chain.from_iterable([t[i : i + k] for i in range(len(t) - k + 1)] for k in range(lo, hi + 1)))


def _word_counts(sentences: list[list[str]] | None, lo: int, hi: int) -> Counter:
    out: Counter = Counter()
    for w in sentences or ():
        for k in range(lo, hi + 1):
            out.update(w if k == 1 else map(" ".join, zip(*[w[i:] for i in range(k)])))
    return out


def word_counts(df: DataFrame, id_col: str, text: str, lower: bool = True, lo: int = 1, hi: int = 2) -> DataFrame:
    """(id, features) of n-grams of tokens within sentences."""
    return _counted(lambda r: _word_counts(r["w"], lo, hi), df, {"w": tx.sentence_tokens(tx.normalized(F.col(text), lower))}, id_col)


def char_counts(df: DataFrame, id_col: str, text: str, lower: bool = False, lo: int = 2, hi: int = 5) -> DataFrame:
    """(id, features) of n-grams of characters of the raw text, across spaces."""
    return _counted(lambda r: _char_counts(r["t"], lo, hi), df, {"t": F.lower(text) if lower else F.col(text)}, id_col)


def extracted(df: DataFrame, id_col: str, text: str, lower: bool = True, lower_chars: bool = False) -> DataFrame:
    """(id, features) of length, word and character features; of equal names the later family's
    value holds. Clusters and dependencies need supplied tables, see ``merged``."""

    def all_(r):
        return {**({r["n"]: 1} if r["n"] is not None else {}), **_word_counts(r["w"], 1, 2), **_char_counts(r["t"], 2, 5)}

    columns = {
        "n": tx.length_feature(F.col(text)).cast("string"),
        "w": tx.sentence_tokens(tx.normalized(F.col(text), lower)),
        "t": F.lower(text) if lower_chars else F.col(text),
    }
    return _counted(all_, df, columns, id_col)


def exploded(counts: DataFrame) -> DataFrame:
    """(id, feature, value) of (id, features)."""
    return counts.select("id", F.inline("features"))


def cluster_features(tokens: DataFrame, clusters: DataFrame) -> DataFrame:
    """from tokens (id, token) and a table token -> cluster."""
    j = tokens.join(clusters, "token").select("id", F.concat(F.lit("cluster"), F.col("cluster").cast("string")).alias("feature"))
    return j.groupBy("id", "feature").agg(F.count("*").cast("int").alias("value")).select("id", F.lit("cluster").alias("family"), "feature", "value")


def dependency_features(parses: DataFrame) -> DataFrame:
    """from parses (id, head_lemma, dep, child_lemma, child_tag): head:dep:child, where the child's tag
    is no punctuation."""
    punct = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
    keep = parses.where(~F.contains(F.lit(punct), F.col("child_tag")))
    j = keep.select("id", F.concat_ws(":", "head_lemma", "dep", "child_lemma").alias("feature"))
    return j.groupBy("id", "feature").agg(F.count("*").cast("int").alias("value")).select("id", F.lit("dep").alias("family"), "feature", "value")


def merged(parts: DataFrame) -> DataFrame:
    """(id, feature, value); of families with an equal name the later one's value holds."""
    rank = F.array_position(F.array(*[F.lit(f) for f in FAMILIES]), F.col("family"))
    return parts.groupBy("id", "feature").agg(F.max_by("value", rank).alias("value"))


def binarized_map(m: Column) -> Column:
    """every feature that is there has the value 1."""
    return F.transform_values(m, lambda k, v: F.lit(1))


def to_extract(df: DataFrame, existing: DataFrame, key: str = "id_string") -> DataFrame:
    """records whose features are not stored yet."""
    return df.join(existing.select(key).distinct(), key, "left_anti")


def as_maps(long: DataFrame) -> DataFrame:
    """M3: (id, features map) of long features; entries are sorted by name."""
    e = F.array_sort(F.collect_list(F.struct("feature", "value")))
    return long.groupBy("id").agg(F.map_from_entries(e).alias("features"))


def document_frequency(long: DataFrame, n: int) -> DataFrame:
    """The ``n`` features in most records; ties by name."""
    return long.groupBy("feature").agg(F.count("*").alias("records")).orderBy(F.desc("records"), "feature").limit(n)


def ranked_vocabulary(long: DataFrame) -> DataFrame:
    """V1: (feature, index) over all records, in order of name. Ranges of names are numbered apart and
    offset by the sizes of the ranges before, so that no task sees the whole vocabulary."""
    v = long.select("feature").distinct().withColumn("head", F.substring("feature", 1, 2))
    sizes = v.groupBy("head").agg(F.count("*").alias("n"))
    offset = sizes.withColumn("offset", F.coalesce(F.sum("n").over(Window.orderBy("head").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = v.withColumn("k", F.row_number().over(Window.partitionBy("head").orderBy("feature")) - 1)
    return within.join(offset.select("head", "offset"), "head").select("feature", (F.col("k") + F.col("offset")).alias("index"))
