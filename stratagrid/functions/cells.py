"""Columns for the geometry of points and cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..grid import Bounds


def cell_x(x: Column, root: Bounds, resolution: float) -> Column:
    return F.floor((x - F.lit(float(root.minx))) / F.lit(float(resolution))).cast("int")


def cell_y(y: Column, root: Bounds, resolution: float) -> Column:
    """Counted from the north."""
    return F.ceil((F.lit(float(root.maxy)) - y) / F.lit(float(resolution)) - 1).cast("int")


def in_bounds(x: Column, y: Column, box: Bounds) -> Column:
    """Half-open, as plain comparisons that reach the scan."""
    return (x >= F.lit(float(box.minx))) & (x < F.lit(float(box.maxx))) & (y >= F.lit(float(box.miny))) & (y < F.lit(float(box.maxy)))


def boxes_meet(box: Bounds, minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    """Whether boxes in columns share more than an edge with box."""
    return (minx < F.lit(float(box.maxx))) & (maxx > F.lit(float(box.minx))) & (miny < F.lit(float(box.maxy))) & (maxy > F.lit(float(box.miny)))


def ranges_overlap(a_from: Column, a_to: Column, b_from: Column, b_to: Column) -> Column:
    """Both ends belong to a range."""
    return (a_from <= b_to) & (a_to >= b_from)


def range_encloses(a_from: Column, a_to: Column, b_from: Column, b_to: Column) -> Column:
    return (a_from <= b_from) & (a_to >= b_to)


def epoch_days(moment: Column) -> Column:
    return F.unix_date(moment.cast("date"))


def in_stratum(x: Column, low: float | None, high: float | None) -> Column:
    """low <= x < high; an open end is None."""
    out = F.lit(True)
    if low is not None:
        out = out & (x >= F.lit(float(low)))
    if high is not None:
        out = out & (x < F.lit(float(high)))
    return out
