"""Statistics of a sorted array column. Every function gives null for an empty array."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def filled(values: Column, out: Column) -> Column:
    return F.when(F.size(values) > 0, out)


def _at(values: Column, rank: Column) -> Column:
    """The value at a rank that may lie between two. A bound rank keeps the terms few, as they are worked out
    for every share of every cell. Between equals or at a whole rank the next value has no part, as it may be infinite
    or NaN; equals come first, so that both values are always looked up and a list made for this is made once."""
    low, high, part = F.get(values, rank.cast("int")), F.get(values, rank.cast("int") + 1), rank - rank.cast("int")
    return F.when((high != low) & (part > 0), low + (high - low) * part).otherwise(low)


def percentile(values: Column, share: float) -> Column:
    """Linear interpolation between the two nearest ranks."""
    return _at(values, (F.size(values) - 1) * F.lit(float(share)))


def percentiles(values: Column, shares: Sequence[float]) -> Column:
    last = F.size(values) - 1
    ranks = F.transform(F.array(*[F.lit(float(s)) for s in shares]), lambda s: last * s)
    return filled(values, F.transform(ranks, lambda r: _at(values, r)))


def median(values: Column) -> Column:
    return filled(values, percentile(values, 0.5))


def l_moments(values: Column) -> Column:
    """The first four sample L-moments as an array, from probability-weighted sums over the ranks."""
    n = F.size(values).cast("double")
    zero = F.struct(*[F.lit(0.0).alias(k) for k in ("j", "b0", "b1", "b2", "b3")])

    def add(acc: Column, x: Column) -> Column:
        j = acc["j"]
        w1 = x * j
        w2 = w1 * (j - 1)
        return F.struct((j + 1).alias("j"), (acc["b0"] + x).alias("b0"), (acc["b1"] + w1).alias("b1"), (acc["b2"] + w2).alias("b2"), (acc["b3"] + w2 * (j - 2)).alias("b3"))

    def finish(acc: Column) -> Column:
        part = lambda b, k: F.try_divide(acc[b], _falling(n, k))
        return F.array(part("b0", 1), part("b1", 2), part("b2", 3), part("b3", 4))

    sums = filled(values, F.aggregate(values, zero, add, finish))
    return F.transform(F.array(sums), lambda b: F.array(b[0], 2 * b[1] - b[0], 6 * (b[2] - b[1]) + b[0], 20 * b[3] - 30 * b[2] + 12 * b[1] - b[0]))[0]


def _falling(n: Column, k: int) -> Column:
    out = n
    for i in range(1, k):
        out = out * (n - i)
    return out


def mode(values: Column, bins: Sequence[int] = (64, 10)) -> Column:
    """The left edge of the fullest of equal bins between the least and the largest value, the lowest of equals.
    Where the values lie so close that so many bins have no width, the next number of bins is taken; none: null."""
    low, high = F.element_at(values, 1), F.element_at(values, -1)
    out = F.when(F.size(values) == 0, F.lit(None).cast("double")).when(low == high, low)
    for n in bins:
        width = (high - low) / n
        out = out.when((low + width > low) & (high - width < high), _fullest(values, n))
    return out


def _fullest(values: Column, bins: int) -> Column:
    """The array is sorted, so each bin is a run."""
    low, high = F.element_at(values, 1), F.element_at(values, -1)
    bin_of = lambda x: F.least(F.floor((x - low) * bins / (high - low)).cast("int"), F.lit(bins - 1))
    start = F.struct(*[F.lit(v).cast("int").alias(k) for k, v in (("bin", -1), ("n", 0), ("best", 0), ("most", 0))])

    def add(acc: Column, b: Column) -> Column:
        n = F.when(acc["bin"] == b, acc["n"] + 1).otherwise(F.lit(1))
        more = n > acc["most"]
        return F.struct(b.alias("bin"), n.alias("n"), F.when(more, b).otherwise(acc["best"]).alias("best"), F.when(more, n).otherwise(acc["most"]).alias("most"))

    best = F.aggregate(F.transform(values, bin_of), start, add, lambda acc: acc["best"])
    return low + best * (high - low) / bins


def mean_distance(values: Column, center: Column) -> Column:
    """The mean of |x - center|."""
    total = F.aggregate(values, F.lit(0.0), lambda acc, x: acc + F.abs(x - center))
    return filled(values, total / F.size(values))


def median_distance(values: Column, center: Column) -> Column:
    """The median of |x - center|."""
    return filled(values, percentile(F.sort_array(F.transform(values, lambda x: F.abs(x - center))), 0.5))


def cubes_about(values: Column, center: Column) -> Column:
    """The sum of (x - center) cubed. Deviations are taken from the finished mean, so that values that lie evenly
    about it cancel out to 0, as running moments don't."""
    return filled(values, F.aggregate(values, F.lit(0.0), lambda acc, x: acc + F.pow(x - center, F.lit(3.0))))


def count_above(values: Column, floor: Column, points: Column) -> Column:
    """How many values exceed floor, 0 included; null where there are no points, with or without a value, or no floor."""
    return F.when(floor.isNotNull() & (points > 0), F.size(F.filter(values, lambda x: x > floor)).cast("long"))


def profile_area(shares: Column) -> Column:
    """The area under the curve of percentiles 0 to 99 over the 99th, from an array of them; null if that is not
    positive."""
    top = F.get(shares, 99)
    inner = F.aggregate(F.slice(shares, 2, 98), F.lit(0.0), lambda acc, q: acc + 2 * q / top)
    return F.when(top > 0, (F.get(shares, 0) / top + inner + 1) / 2)
