import collections
import hashlib

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from quillspark.operators import sampling as sp


def frame(spark, labels):
    return spark.createDataFrame([(f"r{i:04d}", x) for i, x in enumerate(labels)] or [("none", None)], "id string, label int")


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(1, 3), min_size=40, max_size=120), st.sampled_from(["even", "stratified"]))
def test_folds_are_disjoint_and_bounded(spark, labels, sampling):
    got = sp.layered(frame(spark, labels), "label", 10, (3, 9), (2, 6), sampling).collect()
    ids = [r["id"] for r in got]
    assert len(ids) == len(set(ids))
    sizes = collections.Counter((r["set_name"], r["fold"]) for r in got)
    limit = {"test_set": 10, "training_set": 9, "grid_search_set": 6}
    assert all(0 < n <= limit[s] for (s, _), n in sizes.items())
    assert {f for (s, f) in sizes if s == "training_set"} <= {1, 2, 3}


def test_sampling_is_deterministic(spark):
    df = frame(spark, [1, 2] * 30)
    a = sp.folds(df, "label", 2, 10).collect()
    b = sp.folds(df.repartition(7), "label", 2, 10).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


@pytest.mark.parametrize("args", [((3, 0), (0, 0), 0), ((0, 5), (0, 0), 0), ((0, 0), (2, 0), 0), ((-1, 5), (0, 0), 0), ((0, 0), (0, 0), -1), ((0, 0), (0, 0), 0)])
def test_plan_errors(args):
    with pytest.raises(ValueError):
        sp.check_plan(*args, "even")
    with pytest.raises(ValueError):
        sp.check_plan((3, 15), (0, 0), 0, "odd")


def test_split(spark):
    df = frame(spark, [1] * 20).withColumnRenamed("label", "game")
    got = collections.Counter(r["split"] for r in sp.train_test_extra(df, "game", 10, 50.0).collect())
    assert got == {"training": 6, "test": 4, "extra": 10}
    got = collections.Counter(r["split"] for r in sp.train_test_extra(df, "game", 10, 50.0, extra_train_row=False).collect())
    assert got == {"training": 5, "test": 5, "extra": 10}


def test_leave_one_out(spark):
    df = spark.createDataFrame([(1,), (2,), (3,), (3,)], "fold int")
    assert sorted(map(tuple, sp.leave_one_out(df).collect())) == [(1, 2), (1, 3), (2, 1), (2, 3), (3, 1), (3, 2)]


def test_ranks_in_slices_are_the_ranks(spark):
    df = frame(spark, [1, 2, None, 2, 1] * 40)
    got = {r["id"]: (r["_rn"], r["_of"]) for r in sp.ranked(df, "label", sp.order_key(3, "id"), "id").collect()}
    for label in (1, 2, None):
        ids = [r["id"] for r in df.collect() if r["label"] == label]
        order = sorted(ids, key=lambda x: hashlib.md5(f"3:{x}".encode()).hexdigest())
        assert [got[x] for x in order] == [(i + 1, len(ids)) for i in range(len(ids))]
    assert sp.ranked(df.limit(0), "label", sp.order_key(3, "id"), "id").count() == 0
