"""Operators on points and cells other than the metrics: all of them plain DataFrame plans."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cells import cell_x, cell_y, in_bounds, ranges_overlap
from ..grid import Bounds, Extents, Rect


def clip(points: DataFrame, box: Bounds, x: str = "X", y: str = "Y") -> DataFrame:
    return points.filter(in_bounds(F.col(x), F.col(y), box))


def assign_cells(points: DataFrame, extents: Extents, x: str = "X", y: str = "Y") -> DataFrame:
    """points inside extents, with their cell's xi and yi."""
    inside = clip(points, extents.bounds, x, y)
    return inside.withColumns({"xi": cell_x(F.col(x), extents.root, extents.resolution), "yi": cell_y(F.col(y), extents.root, extents.resolution)})


def list_cells(points: DataFrame, attributes: Sequence[str], keys: Sequence[str] = ("xi", "yi")) -> DataFrame:
    """Each cell's values of every attribute, in one order for all, and their number."""
    packed = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"), F.collect_list(F.struct(*attributes)).alias("_p"))
    return packed.select(*keys, "count", *[F.col("_p").getField(a).alias(a) for a in attributes])


def cell_values(points: DataFrame, values: Mapping[str, Column], keys: Sequence[str] = ("xi", "yi")) -> DataFrame:
    """points with a value of their own cell beside each, from window aggregates that share one shuffle."""
    w = Window.partitionBy(*keys)
    return points.withColumns({k: c.over(w) for k, c in values.items()})


def all_cells(spark, rect: Rect, x: str = "X", y: str = "Y") -> DataFrame:
    """Every index of rect. Rows are ranged over the executors and columns made in place, so no shuffle."""
    width = max(0, rect.x2 - rect.x1)
    rows = spark.range(rect.y1, max(rect.y1, rect.y2)).select(F.col("id").cast("int").alias(y))
    across = F.sequence(F.lit(rect.x1), F.lit(rect.x2 - 1)) if width else F.array().cast("array<int>")
    return rows.select(F.explode(across).alias(x), y)


def _row_starts(spark, rect: Rect, y: str) -> DataFrame:
    """Every Y of rect; none where it has no columns."""
    return spark.range(rect.y1, max(rect.y1, rect.y2) if rect.x2 > rect.x1 else rect.y1).select(F.col("id").cast("int").alias(y))


def _inside(cells: DataFrame, rect: Rect, x: str, y: str) -> DataFrame:
    return in_rect(cells, rect, x, y).withColumns({k: F.col(k).cast("int") for k in (x, y)})


def densify(cells: DataFrame, rect: Rect, fill: Mapping[str, object] | None = None, x: str = "X", y: str = "Y") -> DataFrame:
    """A row for each cell of rect; what has no data is null or, where fill names the column, its value.

    Only cells with data are shuffled: where they arrive, each brings along the empty ones up to the next of its row,
    and one before the first column those ahead of the first."""
    first = _row_starts(cells.sparkSession, rect, y).withColumn(x, F.lit(rect.x1 - 1))
    held = _inside(cells, rect, x, y).unionByName(first, allowMissingColumns=True)
    after = F.coalesce(F.lead(x).over(Window.partitionBy(y).orderBy(x)), F.lit(rect.x2)) - 1
    spread = held.withColumn("_after", after).withColumn("_x", F.explode(F.sequence(F.col(x), F.greatest(F.col(x), F.col("_after"))))).filter(F.col("_x") >= rect.x1)
    others = [c for c in cells.columns if c not in (x, y)]
    out = spread.select(F.col("_x").alias(x), y, *[F.when(F.col("_x") == F.col(x), F.col(f"`{c}`")).alias(c) for c in others])
    fill = {k: v for k, v in (fill or {}).items() if k in cells.columns and v is not None}
    return out.withColumns({k: F.coalesce(F.col(k), F.lit(v).cast(cells.schema[k].dataType)) for k, v in fill.items()}) if fill else out


def latest(cells: DataFrame, version: str = "time_slot", keys: Sequence[str] = ("X", "Y")) -> DataFrame:
    """Of each cell the row with the largest version. Rows are combined in each task before the shuffle."""
    best = cells.groupBy(*keys).agg(F.max_by(F.struct("*"), F.col(version)).alias("_row"))
    return best.select("_row.*")


def during(cells: DataFrame, start: Column | str, end: Column | str, first: str = "start_time", last: str = "end_time") -> DataFrame:
    """Rows whose days overlap start to end, both included."""
    day = lambda v: (F.lit(v) if isinstance(v, str) else v).cast("date")
    return cells.filter(ranges_overlap(F.col(first), F.col(last), day(start), day(end)))


def in_rect(cells: DataFrame, rect: Rect, x: str = "X", y: str = "Y") -> DataFrame:
    return cells.filter((F.col(x) >= rect.x1) & (F.col(x) < rect.x2) & (F.col(y) >= rect.y1) & (F.col(y) < rect.y2))


def outside_rects(cells: DataFrame, done: Sequence[Rect], x: str = "xi", y: str = "yi") -> DataFrame:
    """Rows of no finished rectangle."""
    for r in done:
        cells = cells.filter(~((F.col(x) >= r.x1) & (F.col(x) < r.x2) & (F.col(y) >= r.y1) & (F.col(y) < r.y2)))
    return cells


def raster_rows(cells: DataFrame, value: str, rect: Rect, nodata: object = None, x: str = "X", y: str = "Y") -> DataFrame:
    """A row for each Y of rect with the values of all X in order, as an array: long to wide by one groupBy,
    without a column per X. Only cells with data are shuffled; gaps are filled within the row."""
    empty = F.lit(nodata).cast(cells.schema[value].dataType)
    held = _inside(cells, rect, x, y).select(y, F.struct(F.col(x).alias("x"), F.coalesce(F.col(value), empty).alias("v")).alias("_c"))
    rows = held.unionByName(_row_starts(cells.sparkSession, rect, y), allowMissingColumns=True)
    packed = rows.groupBy(y).agg(F.array_sort(F.collect_list("_c")).alias("_r"))  # without the nulls of starts
    at = lambda i: F.coalesce(F.get("_r", i)["x"], F.lit(rect.x1 - 1))
    filled = F.flatten(F.transform("_r", lambda c, i: F.concat(F.array_repeat(empty, c["x"] - at(i - 1) - 1), F.array(c["v"]))))
    return packed.select(y, F.concat(filled, F.array_repeat(empty, F.lit(rect.x2 - 1) - at(F.size("_r") - 1))).alias(value))


def pivot(cells: DataFrame, value: str, columns: Sequence[int], x: str = "X", y: str = "Y") -> DataFrame:
    """A row for each Y and a column for each of the given X."""
    return cells.groupBy(y).pivot(x, list(columns)).agg(F.first(value, ignorenulls=True))


def without_outliers(rows: DataFrame, column: str, reach: float = 1.5) -> DataFrame:
    """Rows strictly within reach times the quartiles' distance of the quartiles."""
    q = rows.agg(F.percentile(column, F.array(F.lit(0.25), F.lit(0.75))).alias("_q"))
    wide = (F.col("_q")[1] - F.col("_q")[0]) * reach
    out = rows.crossJoin(F.broadcast(q))  # one row
    return out.filter((F.col(column) > F.col("_q")[0] - wide) & (F.col(column) < F.col("_q")[1] + wide)).drop("_q")


def source_bounds(points: DataFrame, x: str = "X", y: str = "Y") -> DataFrame:
    return points.agg(F.min(x).alias("minx"), F.min(y).alias("miny"), F.max(x).alias("maxx"), F.max(y).alias("maxy"))


def count_points(points: DataFrame, box: Bounds | None = None, resolution: float | None = None) -> DataFrame:
    """One row, n: the points in box; or at a resolution the squares of that side that hold any."""
    inside = clip(points, box) if box else points
    if resolution is None:
        return inside.agg(F.count(F.lit(1)).alias("n"))
    squares = inside.select(F.floor(F.col("X") / resolution).alias("a"), F.floor(F.col("Y") / resolution).alias("b")).distinct()
    return squares.agg(F.count(F.lit(1)).alias("n"))
