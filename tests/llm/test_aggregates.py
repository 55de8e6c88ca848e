"""Splits, term counts, percentiles."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import linked_splits, quantiles, term_counts


def test_accounts(spark):
    urls = ["http://x.example/id/Ab_c", " HTTPS://WWW.x.example/id/ab%5Fc/home ", "http://x.example/id/AB_C?l=english", "http://x.example/id/ab_c/#top", "http://x/profiles/123/", None, "", "nonsense", "http://x/id/a%zz"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, u string").orderBy("i")
    got = [r[0] for r in df.select(linked_splits.account(F.col("u"))).collect()]
    assert got == ["i:ab_c"] * 4 + ["n:123", None, None, None, "i:a%zz"]


def test_components_equal_union_find(spark):
    rng = random.Random(4)
    edges = [(f"n{rng.randrange(150)}", f"n{rng.randrange(150)}") for _ in range(110)] + [(f"c{i}", f"c{i + 1}") for i in range(40)] + [("n1", "n1")]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in linked_splits.components(spark.createDataFrame(edges, "a string, b string")).collect()}
    linked = {x for e in edges for x in e if e[0] != e[1]}
    assert got == {x: find(x) for x in linked}
    assert linked_splits.components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_splits_grow_and_quarantine(spark, tmp_path):
    path = f"file://{tmp_path}/state"
    none = spark.createDataFrame([], "a string, b string")
    n = spark.createDataFrame([(f"a{i}", 1) for i in range(400)] + [("big", 150)], "node string, n int")
    state = lambda *at: {r["node"]: (r["component"], r["split"], r["status"]) for r in linked_splits.load(spark, path, *at).collect()}
    assert state() == {} and linked_splits.advance(n, none, path) == 1
    got = {k: v[1] for k, v in state().items()}
    sizes = {s: sum((150 if k == "big" else 1) for k, v in got.items() if v == s) for s in linked_splits.PROPORTIONS}
    assert sizes["train"] == pytest.approx(440, abs=40) and sizes["test"] == pytest.approx(55, abs=30)
    train = [k for k, v in sorted(got.items()) if v == "train" and k != "big"]
    a, b = train[0], next(k for k, v in sorted(got.items()) if v == "test")
    more = spark.createDataFrame([("new1", 1), ("new2", 1), ("alone", 1), (None, 5)], "node string, n int")
    edges = spark.createDataFrame([(a, b), ("new1", "new2"), ("new2", "big"), (train[1], train[2]), (None, "x")], "a string, b string")
    assert linked_splits.advance(more, edges, path) == 2
    two = state()
    assert two[a][1:] == two[b][1:] == ("quarantine", "conflict") and two[a][0] == two[b][0]
    assert two["new1"] == two["new2"] == two["big"] and two["big"][1:] == (got["big"], "ok")
    assert two[train[1]][0] == two[train[2]][0] and two["alone"][2] == "ok"
    assert all(v[1] == got[k] for k, v in two.items() if k in got and k not in (a, b))
    # what has merged merges on, the old version stays readable, an empty batch changes nothing
    chain = spark.createDataFrame([(train[2], train[3]), (train[3], "new1")], "a string, b string")
    assert linked_splits.advance(more.limit(0), chain, path) == 3
    three = state()
    assert len({three[k][0] for k in (train[1], train[2], train[3], "big", "new1", "new2")}) == 1
    assert {k: v[1] for k, v in state(2).items()} == got and len(three) == len(two)
    linked_splits.advance(more.limit(0), none, path)
    assert state() == three


def test_in_several_partitions(spark):
    rows = [("1", "n:1", "training"), ("2", "i:a", "test"), ("3", "i:b", "test"), ("4", "i:b", "test"), ("5", None, "test"), ("6", "n:1", None), ("1", "n:1", "training")]
    recs = spark.createDataFrame(rows, "id string, node string, part string")
    comps = linked_splits.components(spark.createDataFrame([("n:1", "i:a")], "a string, b string"))
    assert sorted(r["id"] for r in linked_splits.in_several_partitions(recs, comps).collect()) == ["1", "2"]
    assert linked_splits.in_several_partitions(recs.limit(0), comps).count() == 0


def test_term_counts(spark):
    rng = random.Random(1)
    rows = []
    for i in range(300):
        m = {f"t{rng.randrange(60)}": rng.choice([0, 1, 2, None, -1]) for _ in range(8)} | {"hot": 2}
        rows.append((f"r{i}", m))
    rows += rows[:20] + rows[5:9] + [("none", None), ("none", None), ("empty", {}), ("empty", {}), ("zero", {"only_zero": 0})]
    df = spark.createDataFrame(rows, "id string, m map<string,int>").withColumn("total", F.lit(1))
    total, records = {}, {}
    for m in dict(rows).values():
        for k, v in (m or {}).items():
            total[k] = total.get(k, 0) + max(v or 0, 0)
            records[k] = records.get(k, 0) + ((v or 0) > 0)
    total, records = {k: v for k, v in total.items() if records[k]}, {k: v for k, v in records.items() if v}
    n = sum(m is not None for m in dict(rows).values())
    mark = lambda c: "rare" if c < 3 else "common" if c > 0.25 * n else None
    for share in (1 / 500, 0.5):
        got = {r["term"]: (r["total"], r["records"]) for r in term_counts.term_counts(df, "id", "m", share).collect()}
        assert got.pop(None)[1] == n and got == {k: (total[k], records[k]) for k in total}
    got = {r["feature"]: r["mark"] for r in term_counts.marked_terms(df, "id", "m").collect()}
    assert got == {k: mark(c) for k, c in records.items()}
    assert term_counts.marked_terms(df.limit(0), "id", "m").count() == 0
    rows = [("a", {"x": 1}), ("a", {"x": 3, "y": 1}), (None, {"x": 1}), (None, {"x": 1}), *[("hot", {"x": 1, f"u{i % 3}": 2}) for i in range(500)]]
    got = term_counts.term_counts(spark.createDataFrame(rows, "id string, m map<string,int>").repartition(4), "id", "m").collect()
    assert {r["term"]: (r["total"], r["records"]) for r in got} == {None: (0, 3), "x": (5, 3), "y": (1, 1), "u0": (2, 1), "u1": (2, 1), "u2": (2, 1)}


def test_repeated_ids_are_all_in_the_filter(spark):
    h = spark.range(20000).select(F.xxhash64((F.col("id") % 15000).cast("string")).alias("h"))
    bits = {k: np.frombuffer(zlib.decompress(x), np.uint8) for k, x in term_counts.repeated_ids(h).items()}
    ids = spark.range(15000).select("id", F.xxhash64(F.col("id").cast("string")).alias("h")).orderBy("id").toPandas()
    maybe = term_counts._maybe(ids.h.to_numpy(), bits)
    assert maybe[:5000].all() and maybe[5000:].sum() < 100
    assert term_counts.repeated_ids(h.limit(0)) == {}


def test_percentiles(spark):
    rng = random.Random(2)
    rows = [(f"r{i}", rng.choice(["g1", "g1", "g2"]), f"2024-01-{1 + i % 9:02d} 00:00:00", rng.lognormvariate(3, 2)) for i in range(20000)]
    rows += [("x1", "g1", "2024-01-01 00:00:00", None), ("x2", "g1", "2024-01-01 00:00:00", float("nan")), ("x3", "g1", "2024-01-01 00:00:00", -1.0), ("x4", None, "2024-01-01 00:00:00", 1.0)]
    df = spark.createDataFrame(rows + [(a, b, "2024-02-01 00:00:00", 1e9) for a, b, _, _ in rows[:50]], "id string, g string, t string, v double").withColumn("t", F.col("t").cast("timestamp"))
    values = quantiles.first_rows(df, "id", "t", "v", "g")
    for k in (256, 32768):
        answers = quantiles.answer(quantiles.merge_sketches(quantiles.day_sketches(values, k), k), k=k)
        outside = 0
        for r in answers.collect():
            v = sorted(x[3] for x in rows if x[1] == r["grp"] and x[3] is not None and x[3] >= 0)
            assert r["n"] == len(v) and (r["rank_error"] > 0) == (k == 256)
            for p in quantiles.PERCENTS:
                rank = sum(x <= r[f"p{p}"] for x in v) / len(v)
                outside += abs(rank - p / 100) > r["rank_error"] + 1 / len(v)
        assert outside <= (1 if k == 256 else 0)  # the bound holds with probability 0.99 for each of eight
        assert sum(x["n_outside"] for x in quantiles.outside_bound(values, answers).collect()) <= (1 if k == 256 else 0)
    assert quantiles.day_sketches(values.limit(0)).count() == 0
