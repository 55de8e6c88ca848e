from pyspark.sql import functions as F

from quillspark.functions import scrape as sc
from quillspark.functions import text as tx
from quillspark.operators import features as ft


def col(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("v"))).collect()]


def test_normalized(spark):
    assert col(spark, ["  Ive\n\tdont  IM ", None, ""], tx.normalized) == ["I have don't I am", None, ""]


def test_length_feature(spark):
    assert col(spark, ["a", "ab", "abc", "a" * 8, "a" * 9, "", None], tx.length_feature) == [0, 1, 2, 3, 4, None, None]


def test_ngrams(spark):
    df = spark.createDataFrame([(1, "A b. c b"), (2, ""), (3, None), (4, "a"), (5, "ééx")], "i int, t string")
    of = lambda counts: {r["id"]: {x["feature"]: x["value"] for x in r["features"]} for r in counts.collect()}
    words = of(ft.word_counts(df, "i", "t"))
    assert words[1] == {"a": 1, "b": 2, ".": 1, "a b": 1, "b .": 1, "c": 1, "c b": 1} and words[2] == words[3] == {}
    chars = of(ft.char_counts(df, "i", "t", lo=2, hi=3))
    assert chars[5] == {"éé": 1, "éx": 1, "ééx": 1} and chars[4] == chars[3] == {}
    every = of(ft.extracted(df, "i", "t"))
    assert every[4] == {"0": 1, "a": 1} and every[3] == {} and every[1]["b."] == 1 and every[1]["3"] == 1
    assert ft.exploded(ft.extracted(df.limit(0), "i", "t")).count() == 0


def test_helpful_funny(spark):
    got = col(
        spark,
        ["1,200 of 2,400 people (50%) found this review helpful 3 people found this review funny", "No ratings yet", "5 people found this review funny", "what", None, "0 of 0 people (0%) found this review helpful"],
        sc.helpful_funny,
    )
    assert tuple(got[0]) == (1200, 2400, 1200, 0.5, 3)
    assert tuple(got[1]) == (0, 0, 0, None, 0)
    assert tuple(got[2]) == (0, 0, 0, None, 5)
    assert got[3] is None and got[4] is None
    assert got[5]["found_helpful_percentage"] is None


def test_dates_and_hours(spark):
    got = col(spark, ["Posted: Jan 13 @ 3:50pm Updated: Feb 2, 2014 @ 1:00am", "Posted: x"], sc.posted_dates)
    assert tuple(got[0]) == ("Jan 13, 2015, 3:50PM", "Feb 2, 2014, 1:00AM")
    assert tuple(got[1]) == (None, None)
    assert tuple(col(spark, ["1.5 hrs last two weeks / 1,003.2 hrs on record"], sc.hours)[0]) == (1.5, 1003.2)
    assert tuple(col(spark, ["3 hrs on record"], sc.hours)[0]) == (None, 3.0)


def test_html(spark):
    assert col(spark, ['<div><span class="t a">x <b>y</b></span><span>z</span></div>', None], lambda c: sc.element_strings(c, "span", "t")) == [["x", "y"], None]
    assert col(spark, ['<span id="commentthread_1">12</span>', "none"], sc.comment_count) == [12, 0]


def test_pairs(spark):
    m = col(spark, [["12", "Games", "3", "Reviews"], [], ["1"]], sc.pairs_map, "array<string>")
    assert m == [{"Games": "12", "Reviews": "3"}, {}, {}]
