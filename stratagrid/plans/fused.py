"""All metrics of a cell in one aggregation.

Each metric asks a Cell for its ingredients. They are gathered from all metrics first and computed together:
one groupBy over (xi, yi) with the filtered counts, sums and value lists, then a few projections, each upon the
columns of the one before. So points are shuffled once, whatever the number of metrics, and metrics that need
another value of their cell (deviations, counts above the mean) need no second pass over the points.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import replace
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ordered
from ..operators.metrics import PERCENTILES, Metric, carry

KEYS = ("xi", "yi")


class Ingredients:
    """Columns to compute: aggregates, and layers of projections above them."""

    def __init__(self, keys: Sequence[str] = KEYS) -> None:
        self.keys = tuple(keys)
        self.aggregates: dict[str, Column] = {}
        self.layers: list[dict[str, Column]] = [{}, {}, {}]
        self._names: dict[tuple, str] = {}

    def name(self, *key) -> str:
        return self._names.setdefault(key, f"_{len(self._names)}_{re.sub(r'[^A-Za-z]', '', key[0])}")

    def aggregate(self, key: tuple, make: Callable[[], Column]) -> Column:
        name = self.name(*key)
        if name not in self.aggregates:
            self.aggregates[name] = make()
        return F.col(name)

    def layer(self, level: int, key: tuple, make: Callable[[], Column]) -> Column:
        name = self.name(*key)
        if name not in self.layers[level]:
            self.layers[level][name] = make()
        return F.col(name)

    def plan(self, points: DataFrame) -> DataFrame:
        """Where values are listed, combining before the shuffle saves nothing: each list would travel, with the
        same values in several. So the points go first, each once, and are combined where they arrive. Sums and
        counts alone are combined on both sides, as usual."""
        if any(key[0] in ("list", "points") for key, name in self._names.items() if name in self.aggregates):
            points = points.repartition(*self.keys)
        out = points.groupBy(*self.keys).agg(*[c.alias(k) for k, c in self.aggregates.items()])
        for layer in self.layers:
            if layer:
                out = out.select("*", *[c.alias(k) for k, c in layer.items()])
        return out


class Cell:
    """One attribute of a cell under some filters."""

    def __init__(self, ingredients: Ingredients, attribute: str, filters: tuple[str, ...]) -> None:
        self.own, self.attribute, self.filters = ingredients, attribute, tuple(dict.fromkeys(filters))

    def also(self, filters: tuple[str, ...]) -> Cell:
        """The same attribute under these filters instead."""
        return Cell(self.own, self.attribute, filters)

    def _kept(self, value: Column) -> Column:
        for f in self.filters:
            value = F.when(F.expr(f), value)
        return value

    def agg(self, what: str, make: Callable[[Column], Column]) -> Column:
        return self.own.aggregate((what, self.attribute, self.filters), lambda: make(self._kept(F.col(self.attribute).cast("double"))))

    def layer(self, level: int, what: str, make: Callable[[], Column]) -> Column:
        return self.own.layer(level, (what, self.attribute, self.filters), make)

    def count(self) -> Column:
        return self.own.aggregate(("count", "", self.filters), lambda: F.count(self._kept(F.lit(1))))

    def average(self) -> Column:
        return self.agg("average", F.avg)

    def minimum(self) -> Column:
        return self.agg("min", F.min)

    def maximum(self) -> Column:
        return self.agg("max", F.max)

    def stddev(self) -> Column:
        return self.agg("stddev", F.stddev_pop)

    def mean(self) -> Column:
        """The average; none where every value is 0."""
        return F.when((self.maximum() != 0) | (self.minimum() != 0), self.average())

    def values(self) -> Column:
        listed = self.agg("list", F.collect_list)
        return self.layer(0, "values", lambda: F.sort_array(listed))

    def percentiles(self) -> Column:
        values = self.values()
        return self.layer(1, "percentiles", lambda: ordered.percentiles(values, [p / 100 for p in PERCENTILES]))

    def profile_area(self) -> Column:
        values = self.values()
        shares = self.layer(1, "shares", lambda: ordered.percentiles(values, [p / 100 for p in range(100)]))
        return ordered.profile_area(shares)

    def l_moments(self) -> Column:
        values = self.values()
        return self.layer(1, "l_moments", lambda: ordered.l_moments(values))

    def median(self) -> Column:
        values = self.values()
        return self.layer(1, "median", lambda: ordered.median(values))

    def mode(self) -> Column:
        values = self.values()
        return self.layer(1, "mode", lambda: ordered.mode(values))

    def count_above(self, what: str, of: tuple[str, ...]) -> Column:
        """Values above the mean or mode of the same attribute under the filters of."""
        values, center, points = self.values(), getattr(self.also(of), what)(), self.count()
        return self.own.layer(2, ("above", self.attribute, self.filters, what, of), lambda: ordered.count_above(values, center, points))


def outputs(metrics: Sequence[Metric], attributes: Sequence[str]) -> list[tuple[Metric, str]]:
    """The (metric, attribute) pairs that there is a column for, in order."""
    return [(m, a) for m in metrics for a in attributes if m.applies_to(a)]


def flagged(points: DataFrame, metrics: Sequence[Metric]) -> tuple[DataFrame, list[Metric]]:
    """points with a boolean column for each user's filter, and the metrics with that column as a predicate."""
    functions = dict.fromkeys(f for m in metrics for f in m.filters if not isinstance(f, str))
    if not functions:
        return points, list(metrics)
    columns = points.columns
    names = {f: f"_stays_{k}" for k, f in enumerate(functions)}
    points = points.withColumns({names[f]: f.flag(columns) for f in functions})
    return points, [replace(m, filters=tuple(names.get(f, f) for f in m.filters)) for m in metrics]


def cell_metrics(points: DataFrame, metrics: Sequence[Metric], attributes: Sequence[str], keys: Sequence[str] = KEYS, lists: bool = False, drop_bare: bool = False) -> DataFrame:
    """One row per cell with points: the keys, count, m_{attribute}_{metric} for each output in double precision,
    and, if asked for, each attribute's values as a list in one common order.

    drop_bare: as in an older program, a cell that the first metric has nothing for loses all metrics."""
    points, metrics = flagged(points, metrics)
    own = Ingredients(keys)
    count = own.aggregate(("count", "", ()), lambda: F.count(F.lit(1)))
    wanted = outputs([m for m in metrics if m.build], attributes)
    columns = {m.entry_name(a): m.build(Cell(own, a, m.filters)) for m, a in wanted}
    if drop_bare and wanted:
        kept = Cell(own, wanted[0][1], wanted[0][0].filters).count() > 0
        columns = {k: F.when(kept, c) for k, c in columns.items()}
    extra = []
    if lists:
        packed = own.aggregate(("points",), lambda: F.collect_list(F.struct(*[F.col(a) for a in attributes])))
        extra = [packed.getField(a).alias(a) for a in attributes]
    out = own.plan(points).select(*keys, count.alias("count"), *[c.alias(k) for k, c in columns.items()], *extra)
    users = [m for m in metrics if m.method]
    return with_user_metrics(points, out, users, attributes, keys) if users else out


def with_user_metrics(points: DataFrame, cells: DataFrame, metrics: Sequence[Metric], attributes: Sequence[str], keys: Sequence[str] = KEYS) -> DataFrame:
    """cells with a column for each user function and attribute. Functions run on Arrow batches, one call per
    cell; values of dependencies reach them as scalars from the cell's row."""
    needed = dict.fromkeys(m for u in metrics for m in u.dependencies)
    found = [c for c in cells.columns if any(c == f"m_{a}_{d}" for a in attributes for d in needed)]
    rows = points.join(cells.select(*keys, *found), list(keys)) if found else points
    made = []
    for m in metrics:
        for a in [a for a in attributes if m.applies_to(a)]:
            value = F.col(a)
            for f in m.filters:
                value = F.when(F.expr(f), value)
            deps = []
            for d in m.dependencies:
                if m_a := next((c for c in (f"m_{a}_{d}", *(f"m_{x}_{d}" for x in attributes)) if c in cells.columns), None):
                    deps.append(F.col(m_a))
                else:
                    raise ValueError(f"{m.name} needs {d}, which is not computed")
            made.append(_user_function(m)(value, *deps).alias(m.entry_name(a)))
    out = cells.join(rows.groupBy(*keys).agg(*made), list(keys), "left")
    return out.select(*[c for c in cells.columns if not c.startswith("m_") and c not in attributes], *[c for c in out.columns if c.startswith("m_")], *[c for c in cells.columns if c in attributes])


def _user_function(metric: Metric):
    kind = metric.spark_type or "array<double>"
    method, policy, listed = metric.method, metric.nan_policy, metric.spark_type is None
    carry(method)

    @F.pandas_udf(kind)
    def call(*series: pd.Series) -> Any:
        values = series[0].dropna()
        known = [s.iloc[0] if len(s) else None for s in series[1:]]
        if any(k is None or k != k for k in known):
            if policy == "raise":
                raise ValueError(f"{metric.name}: a dependency has no value in this cell")
            return None
        if not len(values):
            return None
        out = method(values, *known)
        if listed:
            return [float(v) for v in out]
        return None if out is None or out != out else out

    call.__name__ = metric.name
    return call
