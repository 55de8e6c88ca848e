import math

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.functions import labels as lb

RANGES = [(0.1, 2.0), (2.1, 3.0)]


# Bins that other programs store as well, so that they have to come out alike.
STORED_BINS = [
    ((0, 5, 5, 1.0), [(0.0, 1.0), (1.1, 2.0), (2.1, 3.0), (3.1, 4.0), (4.1, 5.0)]),
    ((0, 5, 5, 1.5), [(0.0, 0.4), (0.5, 1.0), (1.1, 1.9), (2.0, 3.2), (3.3, 5.0)]),
    ((0, 900, 3, 5.0), [(0.0, 29.0), (29.1, 174.2), (174.3, 900.0)]),
]


@pytest.mark.parametrize("args, want", STORED_BINS)
def test_stored_bins(args, want):
    assert lb.bin_ranges(*args) == want


@given(st.integers(-50, 50), st.integers(20, 4000), st.integers(2, 6), st.sampled_from([1.0, 1.2, 2.0]))
def test_bins_cover_the_limits_without_gap(low, width, n, factor):
    bins = lb.bin_ranges(low, low + width, n, factor)
    assert len(bins) == n and bins[0][0] == low and bins[-1][1] == low + width
    assert all(round(b[0] - a[1], 6) == 0.1 for a, b in zip(bins, bins[1:]))
    widths = [b - a for a, b in bins]
    assert all(y >= x - 1.2 for x, y in zip(widths, widths[1:]))


def raises(f, *args):
    with pytest.raises(ValueError):
        f(*args)


def test_limits_that_give_no_bins():
    for gap in (0.0, lb.TOLERANCE / 2, lb.TOLERANCE * 0.99, -1.0):  # nothing between the limits, or less
        raises(lb.bin_ranges, 7.0, 7.0 + gap)
    for k in (2, 3, 5):  # more decimals than the grid has
        raises(lb.bin_ranges, 0, 9 + 10.0**-k)
    for factor in (0.0, -0.5, -3.0):
        raises(lb.bin_ranges, 0, 9, 3, factor)
    for high in (float("inf"), 2.0**60):  # a step of 0.1 is lost there
        raises(lb.bin_ranges, 0, high, 2, 3.0)


def chain(*ends, step=0.1):
    """Ranges one after the other from their upper ends, ``step`` apart."""
    lows = [0.0, *(round(e + step, 3) for e in ends[:-1])]
    return [(lo, float(hi)) for lo, hi in zip(lows, ends)]


def test_check_ranges():
    good = chain(7.5, 12.0, 80.3)
    lb.check_ranges(good)
    for k in range(len(good)):
        lo, hi = good[k]
        for changed in ((lo, lo), (hi, lo), (lo, hi + 0.04), (lo - 0.04, hi), (int(lo), hi), (lo, int(hi)), (lo, str(hi))):
            if changed != (lo, hi):
                raises(lb.check_ranges, [*good[:k], changed, *good[k + 1 :]])
    for few in ([], good[:1]):
        raises(lb.check_ranges, few)
    for step in (0.0, 0.2, 1.0, -0.1):
        raises(lb.check_ranges, chain(7.5, 12.0, 80.3, step=step))


def one(spark, value, **kw):
    df = spark.createDataFrame([(value,)], "v double")
    return df.select(lb.label_value(F.col("v"), **kw)).first()[0]


def test_bins(spark):
    df = spark.createDataFrame([(0.1,), (0.0001,), (1.5,), (1.99,), (2.5,), (None,)], "v double")
    assert [r[0] for r in df.select(lb.bin_index(F.col("v"), RANGES)).collect()] == [1, None, 1, 1, 2, None]
    bins = spark.createDataFrame([(1, 0.1, 2.0), (2, 2.1, 3.0)], "bin int, lo double, hi double")
    assert [r["bin"] for r in lb.bin_join(df, "v", bins).collect()] == [1, None, 1, 1, 2, None]


def test_label_value(spark):
    assert one(spark, None) is None
    assert one(spark, 45.9, lognormal=True) == pytest.approx(math.log(45.9))
    assert one(spark, 0.5, lognormal=True) == 0.5
    assert one(spark, 45.9, power=2.0) == pytest.approx(45.9**2)
    assert one(spark, 0.5, label="found_helpful_percentage") == 50.0
    assert one(spark, 34.0, ranges=[(0.0, 5.0), (5.1, 20.2), (20.3, 34.0)]) == 3
    with pytest.raises(ValueError):
        lb.label_value(F.col("v"), lognormal=True, power=2.0)
    for value, kw in ((-1.0, {}), (34.0, {"ranges": [(0.0, 5.0), (5.1, 20.2), (20.3, 33.9)]})):
        with pytest.raises(Exception):
            one(spark, value, **kw)


def test_label_lookup(spark):
    df = spark.createDataFrame([(3, (20, 40, 0.5))], "num_badges long, achievement_progress struct<num_achievements_attained:long,num_achievements_possible:long,num_achievements_percentage:double>")
    row = df.select(lb.label_column(df, "num_badges"), lb.label_column(df, "num_achievements_attained"), lb.label_column(df, "num_guides")).first()
    assert tuple(row) == (3, 20, None)
    with pytest.raises(ValueError):
        lb.label_column(df, "nonsense")


def test_rescaled_constant_predictions(spark):
    df = spark.createDataFrame([(1.0, 0.0)], "p double, s double")
    got = df.select(lb.rescaled(F.col("p"), F.col("p"), F.col("s"), F.lit(2.0), F.lit(1.0), F.lit(1.0), F.lit(3.0))).first()[0]
    assert got == 3.0
