"""The catalogue of cell statistics.

A metric says what it computes from the ingredients of a cell (see plans.fused). Its filters are SQL predicates
over the point columns and hold together; rows that fail them are no part of the cell, and where none is left
the result is null, for counts too. Ingredients are found by (attribute, filters), never by name alone, so a
metric's value doesn't depend on which others are computed beside it.
"""

from __future__ import annotations

import importlib
import importlib.util
import json
import re
import sys
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace
from pathlib import Path
from typing import TYPE_CHECKING, Any

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import ordered

if TYPE_CHECKING:
    from ..plans.fused import Cell

#: NumPy kind of a result to its Spark type and what stands for no data in files.
DTYPES = {"float32": ("float", -9999.0), "float64": ("double", -9999.0), "int32": ("int", -9999), "int64": ("long", -9999), "int16": ("short", -9999), "int8": ("short", -9999), "uint8": ("short", 0), "uint16": ("int", 0), "uint32": ("long", 0), "object": (None, None)}

PERCENTILES = (1, 5, 10, 20, 25, 30, 40, 50, 60, 70, 75, 80, 90, 95, 99)
STRATA_BREAKS = (1.37, 5.0, 10.0, 15.0, 20.0)


@dataclass(frozen=True)
class Attribute:
    """A point column that a store keeps."""

    name: str
    dtype: str = "float32"

    def entry_name(self) -> str:
        return self.name

    def to_json(self) -> dict:
        return {"name": self.name, "dtype": self.dtype}

    @classmethod
    def from_dict(cls, found: dict) -> Attribute:
        return cls(found["name"], found["dtype"])


#: Usual dimensions of point clouds. Unknown names are taken as float32.
DIMENSIONS = {a.name: a for a in (
    Attribute("X", "float64"), Attribute("Y", "float64"), Attribute("Z", "float64"), Attribute("Intensity", "uint16"),
    Attribute("ReturnNumber", "uint8"), Attribute("NumberOfReturns", "uint8"), Attribute("Classification", "uint8"),
    Attribute("ScanAngleRank", "float32"), Attribute("UserData", "uint8"), Attribute("PointSourceId", "uint16"),
    Attribute("GpsTime", "float64"), Attribute("Red", "uint16"), Attribute("Green", "uint16"), Attribute("Blue", "uint16"),
    Attribute("HeightAboveGround", "float64"), Attribute("ScanDirectionFlag", "uint8"), Attribute("EdgeOfFlightLine", "uint8"),
)}
DEFAULT_ATTRIBUTES = ("Z", "NumberOfReturns", "ReturnNumber", "Intensity")


def attribute(name: str) -> Attribute:
    return DIMENSIONS.get(name, Attribute(name))


def named(function: Callable) -> str:
    """Where a user's function is found again: a module or file, and its name there."""
    return f"{_FILES.get(function.__module__, function.__module__)}:{function.__qualname__}"


def find(where: str) -> Callable:
    module, _, name = where.rpartition(":")
    target: Any = _load_file(module) if module.endswith(".py") else importlib.import_module(module)
    for part in name.split("."):
        target = getattr(target, part)
    return target


def carry(function: Callable) -> None:
    """Send a user's module along with its functions, as executors may not have it."""
    home = sys.modules.get(function.__module__)
    if home is not None and home.__name__ != "__main__" and not home.__name__.startswith("stratagrid"):
        cloudpickle.register_pickle_by_value(home)


@dataclass(frozen=True)
class RowFilter:
    """A user's filter: a function of some points as a pandas DataFrame to the rows that stay, or to a boolean for
    each row. It sees Arrow batches, which are neither cells nor tiles, so what it says of a row must follow from
    that row alone. columns: those that it reads, all if none are named; naming them keeps the others unread."""

    function: Callable[[pd.DataFrame], pd.DataFrame | pd.Series]
    columns: tuple[str, ...] = ()

    def to_json(self) -> dict:
        return {"function": named(self.function), "columns": list(self.columns)}

    def flag(self, columns: Iterable[str]) -> Column:
        """Whether each row stays."""
        function = self.function
        carry(function)

        @F.pandas_udf("boolean")
        def stays(rows: pd.DataFrame) -> pd.Series:
            rows = rows.reset_index(drop=True)
            found = function(rows)
            if isinstance(found, pd.Series):
                return found.fillna(False).astype(bool)
            return pd.Series(rows.index.isin(found.index))

        return stays(F.struct(*[F.col(f"`{c}`") for c in self.columns or columns]))


def _filter(found) -> str | RowFilter:
    if isinstance(found, dict):
        return RowFilter(find(found["function"]), tuple(found.get("columns") or ()))
    return RowFilter(found) if callable(found) else found


@dataclass(frozen=True)
class Metric:
    """build: the result from a cell's ingredients; or method: a function of a pandas Series of the attribute's
    values (and of the dependencies' values in the cell) to a scalar or list."""

    name: str
    build: Callable[[Cell], Column] | None = field(default=None, compare=False)
    dtype: str = "float32"
    attributes: tuple[str, ...] = ()
    filters: tuple[str | RowFilter, ...] = ()
    method: Callable[..., Any] | None = None
    dependencies: tuple[str, ...] = ()
    nan_policy: str = "propagate"
    description: str = ""
    #: The preset's arguments, where the metric is one of get_grid_metrics().
    preset: tuple = ()

    def __post_init__(self) -> None:
        if self.dtype not in DTYPES:
            raise ValueError(f"{self.name}: dtype {self.dtype} is none of {sorted(DTYPES)}")
        if self.nan_policy not in ("propagate", "raise"):
            raise ValueError(f"{self.name}: nan_policy is 'propagate' or 'raise'")
        object.__setattr__(self, "filters", tuple(map(_filter, self.filters)))

    @property
    def nan_value(self):
        return DTYPES[self.dtype][1]

    @property
    def spark_type(self) -> str | None:
        return DTYPES[self.dtype][0]

    def entry_name(self, attribute: str) -> str:
        return f"m_{attribute}_{self.name}"

    def applies_to(self, attribute: str) -> bool:
        return not self.attributes or attribute in self.attributes

    def add_filter(self, predicate: str | RowFilter | Callable) -> Metric:
        """A metric with one more predicate, or user's function of rows; this one stays as it is."""
        predicate = _filter(predicate)
        return self if predicate in self.filters else replace(self, filters=(*self.filters, predicate))

    def on(self, *attributes: str) -> Metric:
        return replace(self, attributes=attributes)

    def to_json(self) -> dict:
        """User functions are named, never pickled: a store holds no code."""
        out = {k: getattr(self, k) for k in ("name", "dtype", "nan_policy", "description")}
        out |= {k: list(getattr(self, k)) for k in ("attributes", "dependencies", "preset")}
        out["filters"] = [f if isinstance(f, str) else f.to_json() for f in self.filters]
        if self.method:
            out["method"] = named(self.method)
        return out

    def to_string(self) -> str:
        return json.dumps(self.to_json())

    @classmethod
    def from_dict(cls, found: dict) -> Metric:
        lists = {k: tuple(found.get(k) or ()) for k in ("attributes", "filters", "dependencies", "preset")}
        plain = {k: found[k] for k in ("name", "dtype", "nan_policy", "description") if k in found}
        if where := found.get("method"):
            return cls(method=find(where), **plain, **lists)
        known = get_grid_metrics(*lists["preset"]) if lists["preset"] else _BY_NAME
        return replace(known[found["name"]], **plain, **lists)

    @classmethod
    def from_string(cls, text: str) -> Metric:
        return cls.from_dict(json.loads(text))


def _ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a, F.nullif(b.cast("double"), F.lit(0.0)))


def _percentile(share: int) -> Callable[[Cell], Column]:
    return lambda c: F.get(c.percentiles(), PERCENTILES.index(share))


def _between(high: int, low: int) -> Callable[[Cell], Column]:
    return lambda c: _percentile(high)(c) - _percentile(low)(c)


def _l(k: int) -> Callable[[Cell], Column]:
    return lambda c: F.get(c.l_moments(), k - 1)


def _moment(kind: str) -> Callable[[Cell], Column]:
    """Sums of powers over (n - 1) times a power of the population's deviation; zero counts as undefined."""

    def build(c: Cell) -> Column:
        n = c.count().cast("double")
        if kind == "skewness":
            values = c.values()
            cubes = c.layer(1, "cubes_about", lambda: ordered.cubes_about(values, c.average()))
            plain = _ratio(cubes, n * F.pow(c.stddev(), F.lit(3.0)))
        else:
            plain = c.agg("kurtosis", F.kurtosis) + 3
        # A cell of equal values has no deviation; the engine calls its moments NaN or null.
        return F.when((c.maximum() > c.minimum()) & ~F.isnan(plain), F.nullif(_ratio(plain * n, n - 1), F.lit(0.0)))

    return build


def _stats() -> list[Metric]:
    return [
        Metric("mode", lambda c: c.mode()),
        Metric("median", lambda c: c.median()),
        Metric("min", lambda c: c.minimum()),
        Metric("max", lambda c: c.maximum()),
        Metric("stddev", lambda c: c.stddev()),
        Metric("cv", lambda c: _ratio(c.stddev(), c.mean())),
        Metric("canopy_relief_ratio", lambda c: F.nullif(_ratio(c.average() - c.minimum(), c.maximum() - c.minimum()), F.lit(0.0))),
        Metric("sqmean", lambda c: F.sqrt(c.agg("squares", lambda x: F.avg(x * x)))),
        Metric("cumean", lambda c: F.cbrt(c.agg("cubes", lambda x: F.avg(F.abs(x * x * x))))),
    ]


def _product_moments() -> list[Metric]:
    return [
        Metric("mean", lambda c: c.mean()),
        Metric("variance", lambda c: F.when(c.count() > 1, c.agg("variance", F.var_samp))),
        Metric("skewness", _moment("skewness")),
        Metric("kurtosis", _moment("kurtosis")),
    ]


def _l_moments() -> list[Metric]:
    out = [Metric(f"l{k}", _l(k)) for k in (1, 2, 3, 4)]
    return out + [Metric("lcv", lambda c: _ratio(_l(2)(c), _l(1)(c))), Metric("lskewness", lambda c: _ratio(_l(3)(c), _l(2)(c))), Metric("lkurtosis", lambda c: _ratio(_l(4)(c), _l(2)(c)))]


def _percentiles() -> list[Metric]:
    out = [Metric(f"p{p:02d}", _percentile(p)) for p in PERCENTILES]
    return out + [Metric("90m10", _between(90, 10)), Metric("95m05", _between(95, 5)), Metric("profile_area", lambda c: c.profile_area()), Metric("iq", _between(75, 25))]


def _aad() -> list[Metric]:
    return [
        Metric("aad", lambda c: c.layer(2, "aad", lambda: ordered.mean_distance(c.values(), c.mean()))),
        Metric("mad_median", lambda c: c.layer(2, "mad_median", lambda: ordered.median_distance(c.values(), c.median()))),
        Metric("mad_mode", lambda c: c.layer(2, "mad_mode", lambda: ordered.median_distance(c.values(), c.mode()))),
        Metric("mad_mean", lambda c: c.layer(2, "mad_mean", lambda: ordered.median_distance(c.values(), c.mean()))),
    ]


def _group(metrics: Iterable[Metric]) -> dict[str, Metric]:
    return {m.name: m for m in metrics}


percentiles, l_moments, statistics, product_moments, aad = map(_group, (_percentiles(), _l_moments(), _stats(), _product_moments(), _aad()))
all_metrics = percentiles | l_moments | statistics | product_moments

#: Filters by name. Elevation filters are made by above().
FIRST = "ReturnNumber = 1"


def return_is(k: int) -> str:
    return f"ReturnNumber = {int(k)}"


def above(column: str, value: float) -> str:
    return f"`{column}` > {float(value)!r}D"


def get_count_metrics(elev_key: str, min_ht: float, ht_break: float, compat: bool = False) -> dict[str, Metric]:
    """compat: counts above the mode of all returns compare with the mean, as in an older program."""
    low, high = above(elev_key, min_ht), above(elev_key, ht_break)
    center = "mean" if compat else "mode"

    def count(name: str, *filters: str) -> Metric:
        return Metric(name, lambda c: F.nullif(c.count(), F.lit(0).cast("long")), "int32", ("ReturnNumber",), filters)

    def beyond(name: str, what: str, *filters: str) -> Metric:
        return Metric(name, lambda c: c.count_above(what, (low,)), "int32", (elev_key,), filters)

    found = [
        count("all_count"), count("all_count_above_htbreak", high), count("all_count_above_minht", low),
        beyond("all_count_above_mean", "mean"), beyond("all_count_above_mode", center),
        count("1st_count", FIRST), count("1st_count_above_htbreak", high, FIRST),
        beyond("1st_count_above_mean", "mean", FIRST), beyond("1st_count_above_mode", "mode", FIRST),
    ]
    return _group(found + [count(f"r{k}_count", low, return_is(k)) for k in range(1, 8)])


def get_cover_metrics(elev_key: str, min_ht: float, ht_break: float, compat: bool = False) -> dict[str, Metric]:
    low, high = above(elev_key, min_ht), above(elev_key, ht_break)
    center = "mean" if compat else "mode"

    def cover(name: str, top: tuple[str, ...], bottom: tuple[str, ...]) -> Metric:
        def build(c: Cell) -> Column:
            return 100 * _ratio(F.nullif(c.also(top).count(), F.lit(0).cast("long")).cast("double"), F.nullif(c.also(bottom).count(), F.lit(0).cast("long")))

        return Metric(name, build, "float32", ("ReturnNumber",), top)

    def beyond(name: str, what: str, top: tuple[str, ...], bottom: tuple[str, ...]) -> Metric:
        def build(c: Cell) -> Column:
            return 100 * _ratio(c.also(top).count_above(what, (low,)).cast("double"), F.nullif(c.also(bottom).count(), F.lit(0).cast("long")))

        return Metric(name, build, "float32", (elev_key,), bottom)

    first = (FIRST,)
    return _group([
        cover("all_cover_above_htbreak", (high,), ()), beyond("all_cover_above_mean", "mean", (), ()), beyond("all_cover_above_mode", center, (), (low,)),
        cover("1st_cover_above_htbreak", (high, FIRST), first), beyond("1st_cover_above_mean", "mean", first, first), beyond("1st_cover_above_mode", "mode", first, first),
        replace(cover("all_1st_cover_above_htbreak", (high,), first), filters=first), beyond("all_1st_cover_above_mean", "mean", (), first), beyond("all_1st_cover_above_mode", center, (), first),
    ])


def get_strata_metrics(elev_key: str, breaks: tuple[float, ...] = STRATA_BREAKS) -> dict[str, Metric]:
    """Percent of the points in each layer; the outer ones are open."""
    from ..functions.cells import in_stratum

    edges = [None, *breaks, None]

    def layer(k: int) -> Metric:
        low, high = edges[k], edges[k + 1]
        return Metric(f"Strata-{k + 1}", lambda c: 100 * c.agg(f"stratum{low}{high}", lambda x: F.avg(F.when(x.isNotNull(), in_stratum(x, low, high).cast("double")))), attributes=(elev_key,))

    return _group(layer(k) for k in range(len(breaks) + 1))


def get_grid_metrics(elev_key: str = "Z", min_ht: float = 2, ht_break: float = 3, compat: bool = False) -> dict[str, Metric]:
    """The full preset: 74 metrics."""
    low, both, elev = above(elev_key, float(min_ht)), (elev_key, "Intensity"), (elev_key,)
    only_elev = {"profile_area", "canopy_relief_ratio", "sqmean", "cumean", "mad_median", "mad_mode", "mad_mean"}
    out = {}
    for m in (percentiles | l_moments | statistics | product_moments | aad).values():
        m = m.on(*(elev if m.name in only_elev else both))
        out[m.name] = m if m.name == "profile_area" else m.add_filter(low)
    out |= get_count_metrics(elev_key, float(min_ht), float(ht_break), compat) | get_cover_metrics(elev_key, float(min_ht), float(ht_break), compat) | get_strata_metrics(elev_key)
    return {k: replace(m, preset=(elev_key, float(min_ht), float(ht_break), compat)) for k, m in out.items()}


_BY_NAME = get_grid_metrics() | aad | all_metrics
GROUPS = {"stats": statistics, "p_moments": product_moments, "l_moments": l_moments, "percentiles": percentiles, "aad": aad, "all": all_metrics}


#: Files that user metrics were loaded from, by the module name that they have here.
_FILES: dict[str, str] = {}


def _load_file(path: str):
    if not Path(path).exists():
        raise FileNotFoundError(path)
    name = "user_metrics_" + re.sub(r"\W", "_", str(Path(path).resolve()))
    spec = importlib.util.spec_from_file_location(name, path)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    _FILES[name] = str(Path(path).resolve())
    return module


def load_user_metrics(path: str) -> list[Metric]:
    """The metrics of a Python file with a function metrics(); the file is trusted like any imported module. A
    store keeps the file's path and the functions' names, not their code."""
    found = list(_load_file(path).metrics())
    for m in found:
        if not isinstance(m, Metric):
            raise TypeError(f"{path}: {m!r} is no Metric")
    return found


def parse_metrics(text: str | None) -> list[Metric]:
    """Names of groups or metrics, grid_metrics_{elevation}_{min_ht}_{ht_break}, or .py files, comma-separated."""
    out: dict[str, Metric] = {}
    for name in (text or "grid_metrics").split(","):
        if name.endswith(".py"):
            found = load_user_metrics(name)
        elif name in GROUPS:
            found = list(GROUPS[name].values())
        elif name.startswith("grid_metric"):
            args = name.split("_")[2:]
            found = list(get_grid_metrics(*(f(a) for f, a in zip((str, float, float), args))).values())
        elif name in _BY_NAME:
            found = [all_metrics.get(name) or aad.get(name) or _BY_NAME[name]]
        else:
            raise ValueError(f"no metric or group is called {name!r}")
        out |= {m.name: m for m in found}
    return list(out.values())
