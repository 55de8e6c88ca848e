import pytest

from quillspark.operators import metrics as mt


def preds(spark, pairs):
    return spark.createDataFrame([("m", 1, str(i), float(y), p) for i, (y, p) in enumerate(pairs)], "learner string, fold int, id string, y double, p double")


def test_scores_by_hand(spark):
    p = preds(spark, [(1, 1.0), (1, 2.0), (2, 2.4), (2, 2.0), (3, 1.0), (3, None), (3, float("nan"))])
    conf = mt.confusion(mt.usable(p))
    r = mt.class_scores(conf).first()
    assert r["accuracy"] == pytest.approx(3 / 5)
    assert r["precision_macro"] == pytest.approx((1 / 2 + 2 / 3 + 0) / 3)
    assert r["f1_macro"] == pytest.approx((1 / 2 + 4 / 5 + 0) / 3)
    assert r["f1_score_least_frequent"] == 0.0
    k = mt.kappas(conf).first()
    assert k["uwk"] == pytest.approx(1 - (2 / 5) / (1 - (2 * 2 + 2 * 3 + 1 * 0) / 25))
    assert [list(x) for x in mt.matrices(conf).first()["confusion_matrix"]] == [[1, 1, 0], [0, 2, 0], [1, 0, 0]]


def test_correlations(spark):
    p = preds(spark, [(1, 1.0), (2, 2.0), (3, 3.0), (4, 5.0)])
    assert mt.spearman(p).first()["rho"] == pytest.approx(1.0)
    assert mt.kendall(mt.confusion(p)).first()["tau"] == pytest.approx(1.0)
    flat = preds(spark, [(1, 1.0), (2, 1.0)])
    assert mt.pearson(flat, "y", "p").first()["r"] is None
    assert mt.kendall(mt.confusion(flat)).first()["tau"] is None


def test_pearson_p():
    # r = 0.5, n = 10: t = 1.633 with 8 degrees of freedom
    assert mt.pearson_p(10, 0.5) == pytest.approx(0.14111, abs=1e-4)
    assert mt.pearson_p(2, 0.5) is None and mt.pearson_p(5, 1.0) == 0.0
