"""Label values: lookup, scaling, logarithm, power, bins, rounding, rescaling."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import LABELS, NESTED, PERCENTAGE_LABELS

Ranges = list[tuple[float, float]]
TOLERANCE = 0.05
_ONE_DECIMAL = re.compile(r"^-?\d+\.\d$")


def label_column(df: DataFrame, label: str) -> Column:
    """A label is looked up at top level, then in the nested struct; an unknown one is an error."""
    if label not in LABELS:
        raise ValueError(f"unknown label: {label!r}")
    if label in df.columns:
        return F.col(label)
    if NESTED in df.columns and label in df.schema[NESTED].dataType.fieldNames():
        return F.col(NESTED)[label]
    return F.lit(None).cast("double")


def check_transforms(lognormal: bool, power: float | None) -> None:
    if lognormal and power:
        raise ValueError("logarithm and power exclude each other")


def ln_label(v: Column) -> Column:
    """L2: the natural logarithm above 1, the value itself up to 1."""
    return F.when(v > 1, F.ln(v)).otherwise(v)


def label_value(v: Column, label: str = "", lognormal: bool = False, power: float | None = None, ranges: Ranges | None = None) -> Column:
    """L1: null stays null, a negative value is an error, fractions of the percentage labels become
    percents, then logarithm or power, then the bin (an error if there is none)."""
    check_transforms(lognormal, power)
    v = v.cast("double")
    out = F.when(v < 0, F.raise_error(F.lit("negative label value")).cast("double")).otherwise(v)
    if label in PERCENTAGE_LABELS:
        out = out * 100
    if lognormal:
        out = ln_label(out)
    elif power:
        out = F.pow(out, F.lit(float(power)))
    if ranges:
        b = bin_index(out, ranges)
        out = F.when(out.isNotNull() & b.isNull(), F.raise_error(F.lit("no bin for label value")).cast("int")).otherwise(b)
    return out


def bin_index(v: Column, ranges: Ranges) -> Column:
    """1-based number of the first range that holds the value within 0.05; null if none does."""
    out = None
    for i, (lo, hi) in enumerate(ranges, 1):
        inside = (v > lo - TOLERANCE) & (v < hi + TOLERANCE)
        out = F.when(inside, i) if out is None else out.when(inside, i)
    return out


def bin_join(df: DataFrame, value: str, bins: DataFrame) -> DataFrame:
    """The bin of each row from a table (bin, lo, hi), first match; for tables of bins, which are a
    handful of rows, gathered into one array by a scalar subquery: a lookup, not a join."""
    arr = bins.agg(F.array_sort(F.collect_list(F.struct("bin", "lo", "hi")))).scalar()
    hit = F.filter("_bins", lambda b: (F.col(value) > b["lo"] - TOLERANCE) & (F.col(value) < b["hi"] + TOLERANCE))
    return df.withColumn("_bins", arr).withColumn("bin", F.get(hit, F.lit(0))["bin"]).drop("_bins")


def _round1(x: float) -> float:
    return round(x, 1)


def bin_ranges(low: float, high: float, nbins: int = 5, factor: float = 1.0) -> Ranges:
    """L4: ``nbins`` ranges on a grid of 0.1 whose widths grow by ``factor``."""
    if factor <= 0:
        raise ValueError("factor must be positive")
    if low > high or abs(high - low) < TOLERANCE:
        raise ValueError("limits must differ and be in order")
    if not (math.isfinite(low) and math.isfinite(high)) or high == high + 0.1:
        raise ValueError("limits too large")
    for x in (low, high):
        if abs(x * 10 - round(x * 10)) > 1e-6:
            raise ValueError("limits have more than one decimal")
    parts = [factor**i for i in range(nbins)]
    unit = round(_round1(high) - low) / sum(parts)
    out, lo = [], float(low)
    for i, part in enumerate(parts):
        hi = _round1(lo + unit * part - (0.1 if i else 0.0))
        hi = float(high) if i == nbins - 1 else min(hi, float(high))
        out.append((lo, hi))
        lo = min(_round1(hi + 0.1), float(high))
    check_ranges(out)
    return out


def check_ranges(ranges: Ranges) -> None:
    """At least two ranges of floats with exactly one decimal, ascending, 0.1 apart; else an error."""
    if len(ranges) < 2:
        raise ValueError("fewer than two bins")
    for lo, hi in ranges:
        if not (isinstance(lo, float) and isinstance(hi, float) and _ONE_DECIMAL.match(str(lo)) and _ONE_DECIMAL.match(str(hi))):
            raise ValueError("bin ends must be floats with one decimal")
        if not lo < hi:
            raise ValueError("a bin's lower end must be below its upper end")
    for (_, hi), (lo, _) in zip(ranges, ranges[1:]):
        if abs(lo - hi - 0.1) >= TOLERANCE:
            raise ValueError("bins must be 0.1 apart")


def bin_limits(df: DataFrame, value: str, whole: bool = True) -> tuple[float, float]:
    """A4, A5: least and greatest value, by default rounded outwards to whole numbers: two scalars."""
    lo, hi = df.agg(F.min(value), F.max(value)).first()
    return (float(math.floor(lo)), float(math.ceil(hi))) if whole else (float(lo), float(hi))


#: Further transforms.
TRANSFORMS = {
    "pow5": lambda v: F.pow(v, F.lit(5.0)),
    "pow2": lambda v: F.pow(v, F.lit(2.0)),
    "sqrt": F.sqrt,
    "root4": lambda v: F.pow(v, F.lit(0.25)),
    "log1p": F.log1p,
    "log2p": lambda v: F.log2(v + 1),
    "log10p": lambda v: F.log10(v + 1),
}


def half_even(v: Column) -> Column:
    """Rounding of labels and predictions, ties to even."""
    return F.rint(v)


def rescaled(pred: Column, pred_mean: Column, pred_std: Column, y_mean: Column, y_std: Column, lo: Column, hi: Column) -> Column:
    """Z-score by the predictions' own mean and deviation, scaled to the labels' and clipped to the
    classes; constant predictions give the highest class."""
    z = F.try_divide(pred - pred_mean, pred_std)
    return F.coalesce(F.greatest(lo, F.least(hi, z * y_std + y_mean)), hi)


def clipped(pred: Column, lo: Column, hi: Column) -> Column:
    return F.greatest(lo, F.least(hi, pred))
