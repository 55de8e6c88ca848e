import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.operators import describe as ds
from quillspark.operators import features as ft
from quillspark.operators import learn as ln
from quillspark.operators import vectorize as vz

REVIEW = "id_string string, num_games_owned long, num_friends long, total_game_hours double, num_reviews long, achievement_progress struct<num_achievements_attained:long,num_achievements_possible:long,num_achievements_percentage:double>, nlp_features map<string,int>"


def reviews(spark):
    return spark.createDataFrame(
        [
            ("a", 5, 0, float("nan"), 2, (20, None, 0.5), {"game we": 1, "zero": 0, "num_friends": 9}),
            ("b", 0, 3, 1.0, 1, None, {"x": 1}),
            ("c", None, 3, 1.0, 1, None, None),
            ("d", 2, None, None, None, None, None),
        ],
        REVIEW,
    )


def test_feature_assembly(spark):
    df = reviews(spark)
    got = {r["id_string"]: r["m"] for r in df.select("id_string", ft.all_features(df, "num_games_owned").alias("m")).collect()}
    a = got["a"]
    assert math.isnan(a.pop("total_game_hours"))
    assert a == {"game we": 1.0, "num_games_owned": 5.0, "num_reviews": 2.0, "num_achievements_attained": 20.0, "num_achievements_percentage": 0.5}
    assert got["b"] is None and got["c"] is None and got["d"] == {"num_games_owned": 2.0}
    plain = df.select(ft.all_features(df, "num_games_owned", nlp=False).alias("m")).first()["m"]
    assert "game we" not in plain


def test_data_points(spark):
    got = {r["id"]: (r["y"], r["x"]) for r in ft.data_points(reviews(spark), "num_games_owned", True, ("num_reviews",), lognormal=True).collect()}
    assert set(got) == {"a"} and got["a"][0] == pytest.approx(math.log(5)) and got["a"][1] == {"game we": 1.0, "num_reviews": 2.0}


def test_families(spark):
    parts = spark.createDataFrame([("1", "length", "9", 1), ("1", "word", "9", 4), ("1", "char", "the", 7), ("1", "word", "the", 2)], "id string, family string, feature string, value int")
    assert sorted(map(tuple, ft.merged(parts).collect())) == [("1", "9", 4), ("1", "the", 7)]
    toks = spark.createDataFrame([("1", "a"), ("1", "b"), ("1", "zz")], "id string, token string")
    cl = spark.createDataFrame([("a", 251), ("b", 251)], "token string, cluster int")
    assert [tuple(r) for r in ft.cluster_features(toks, cl).collect()] == [("1", "cluster", "cluster251", 2)]
    parses = spark.createDataFrame([("1", "behave", "ROOT", "game", "NN"), ("1", "x", "punct", ".", ".")], "id string, head_lemma string, dep string, child_lemma string, child_tag string")
    assert [r["feature"] for r in ft.dependency_features(parses).collect()] == ["behave:ROOT:game"]


def test_vocabulary_is_in_order(spark):
    long = spark.createDataFrame([("1", x) for x in ("b", "ab", "aa", "", "é", "b", "abc")], "id string, feature string")
    got = sorted((r["index"], r["feature"]) for r in ft.ranked_vocabulary(long).collect())
    assert got == list(enumerate(sorted({"b", "ab", "aa", "", "é", "abc"})))


def test_chi2_by_hand(spark):
    long = spark.createDataFrame([("1", "f", 2), ("2", "f", 1), ("3", "g", 1)], "id string, feature string, value int")
    y = spark.createDataFrame([("1", 1.0), ("2", 2.0), ("3", 2.0)], "id string, y double")
    got = {r["feature"]: r["chi2"] for r in vz.chi2(long, y).collect()}
    assert got["f"] == pytest.approx((2 - 1) ** 2 / 1 + (1 - 2) ** 2 / 2)
    assert got["g"] == pytest.approx((0 - 1 / 3) ** 2 / (1 / 3) + (1 - 2 / 3) ** 2 / (2 / 3))
    assert vz.selected(vz.chi2(long, y), 0.5).count() == 1
    with pytest.raises(ValueError):
        vz.selected(long, 0.0)


def test_histogram_of_one_value(spark):
    df = spark.createDataFrame([(3.0,), (3.0,), (None,)], "v double")
    assert [tuple(r) for r in ds.histogram(df, "v").collect()] == [(0, 2)]
    assert ds.zscores(df, "v").first()["z"] is None
    assert ds.moments(df, "v").first()["mode"] == 3.0


@pytest.mark.parametrize("kind, params", [("perc", {"n_iter": 5}), ("pagc", {"n_iter": 5, "C": 1.0}), ("sgdc", {"n_iter": 5, "alpha": 0.01, "penalty": "l2", "average": True})])
def test_online_learners_separate(kind, params):
    rng = np.random.default_rng(0)
    y = rng.integers(0, 3, 200).astype(float)
    rows = [(np.array([int(k), 3 + int(rng.integers(3))]), np.array([1.0, 0.3])) for k in y]
    m = ln.Online(kind, params, 6, np.array([0.0, 1.0, 2.0]))
    for s in range(0, 200, 50):
        m.partial_fit(rows[s : s + 50], y[s : s + 50])
    assert (m.predict(rows) == y).mean() > 0.95


def test_regression_and_clusters():
    rng = np.random.default_rng(1)
    x = rng.normal(size=300)
    rows = [(np.array([0]), np.array([v])) for v in x]
    m = ln.Online("pagr", {"n_iter": 5, "C": 0.1}, 1, np.array([]))
    m.partial_fit(rows, 2 * x + 1)
    assert np.abs(m.predict(rows) - (2 * x + 1)).mean() < 0.3
    pts = [(np.array([0]), np.array([v])) for v in np.concatenate([np.zeros(50), np.full(50, 9.0)])]
    k = ln.Online("mbkm", {"n_clusters": 2, "init": "k-means++"}, 1, np.array([]))
    k.partial_fit(pts, None)
    p = k.predict(pts)
    assert len(set(p[:50])) == 1 and len(set(p[50:])) == 1 and p[0] != p[99]


def test_majority_predictions(spark):
    train = spark.createDataFrame([(2.0,), (1.0,), (1.0,), (2.0,)], "y double")
    assert {r["p"] for r in ln.majority_predictions(train, train).collect()} == {1.0}


def test_grid_search_needs_two_folds(spark):
    one = spark.createDataFrame([(1, "a", 1.0, [0], [1.0])], "fold int, id string, y double, slots array<int>, vals array<double>")
    with pytest.raises(ValueError):
        ln.grid_search(one, "perc", [{}], 4, F.lit)


def test_exact_percentile(spark):
    import numpy as np

    from quillspark.operators.describe import exact_percentile

    rng = np.random.default_rng(1)
    for v in (rng.lognormal(3, 2, 5000), rng.integers(0, 4, 3000).astype(float), np.array([7.0]), np.array([1.0, 2.0])):
        df = spark.createDataFrame([(float(x),) for x in v] + [(None,)], "v double")
        for p in (0.0, 0.5, 0.9, 1.0):
            assert abs(exact_percentile(df, "v", p) - np.percentile(v, 100 * p)) < 1e-9
    assert exact_percentile(df.limit(0), "v", 0.5) is None


def test_perceptrons_of_a_grid_together():
    """Predictions of every combination as alone; at most 58 of the 96 models are trained, in two tasks a fold."""
    rng = np.random.default_rng(5)
    classes, combinations = np.array([0.0, 1.0, 2.0]), ln.grid_rows("perc")
    rows = [(np.sort(rng.choice(60, 8, replace=False)), rng.normal(size=8)) for _ in range(120)]
    y = rng.integers(0, 3, 120).astype(float)
    blocks = ln._blocks("perc", combinations)
    assert len(blocks) == 2 and sum(map(len, blocks)) == 58 and sorted(i for b in blocks for m in b for i in m) == list(range(96))
    for block in blocks:
        together = ln.Perceptrons([combinations[m[0]] for m in block], 60, classes)
        for s in (0, 60):
            together.partial_fit(rows[s : s + 60], y[s : s + 60])
        for numbers, got in zip(block, together.predict(rows)):
            for i in numbers:
                alone = ln.Online("perc", combinations[i], 60, classes)
                for s in (0, 60):
                    alone.partial_fit(rows[s : s + 60], y[s : s + 60])
                assert (alone.predict(rows) == got).all()


def test_kmeans_never_holds_all_rows_dense():
    import tracemalloc

    rng = np.random.default_rng(6)
    rows = [(rng.choice(4096, 5, replace=False), np.ones(5)) for _ in range(3000)]
    m = ln.Online("mbkm", {"n_clusters": 3, "init": "k-means++"}, 4096, np.array([]))
    tracemalloc.start()
    m.partial_fit(rows, None)
    m.predict(rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6 < 3000 * 4096 * 8


def test_streamed_folds_equal_one_by_one(spark):
    rng = np.random.default_rng(7)
    rows = [(int(i % 3) + 1, f"r{i:03d}", float(rng.integers(0, 2)), sorted(rng.choice(20, 4, replace=False).tolist()), rng.normal(size=4).tolist()) for i in range(90)]
    points = spark.createDataFrame(rows, "fold int, id string, y double, slots array<int>, vals array<double>")
    for learner, params in (("mbkm", {"n_clusters": 2, "init": "k-means++"}), ("pagc", {"n_iter": 2, "C": 1.0})):
        got = {(r["fold"], r["id"]): r["p"] for r in ln.cross_validated(points, learner, params, 20).collect()}
        assert len(got) == 90
        for out in (1, 2, 3):
            model, of = ln.Online(learner, params, 20, np.array([0.0, 1.0])), lambda k: [(np.array(r[3]), np.array(r[4])) for r in rows if r[0] == k]
            for k in {1, 2, 3} - {out}:
                model.partial_fit(of(k), np.array([r[2] for r in rows if r[0] == k]))
            assert [got[r[0], r[1]] for r in rows if r[0] == out] == model.predict(of(out)).tolist()
