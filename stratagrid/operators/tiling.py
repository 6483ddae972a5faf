"""How many cells make a tile of some number of points: a quadtree over cell counts, level by level."""

from __future__ import annotations

import heapq
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..grid import Extents, Rect
from ..plans.cut import cut
from .relational import assign_cells, without_outliers

_BOX = ("x1", "x2", "y1", "y2")


def leaves(points: DataFrame, extents: Extents, point_count: int, resolution: float, depth: int, exhaustive: bool = False) -> DataFrame:
    """Leaves of the tree: x1, x2, y1, y2 (index ranges), points, cells, ended (by depth or area, not by count).
    Points are counted by cell once; each level halves the ranges of the cells that go on, and adds up again.
    exhaustive: split until the count fits, whatever the depth and area."""
    r, res = extents.rect, extents.resolution
    counts = assign_cells(points, extents).groupBy("xi", "yi").agg(F.count(F.lit(1)).alias("n"))
    level = cut(counts.select("*", *[F.lit(v).alias(k) for k, v in zip(_BOX, (r.x1, r.x2, r.y1, r.y2))]), "level")
    found = None
    wide, high = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    area = wide.cast("double") * high * res * res  # beyond an int on large grids
    for d in range(64):
        nodes = level.groupBy(*_BOX).agg(F.sum("n").alias("points"))
        small = (wide * res / 2 < res) | (high * res / 2 < res)
        fits = F.col("points") <= point_count if exhaustive else F.col("points") < point_count
        stop = F.lit(False) if exhaustive else (area < resolution**2) | F.lit(d >= depth)
        nodes = nodes.select("*", (wide.cast("long") * high).alias("cells"), (~small & ~fits & stop).alias("ended"), (small | fits | stop).alias("leaf"))
        nodes = cut(nodes, "nodes")
        done = nodes.filter("leaf").drop("leaf")
        found = done if found is None else found.unionByName(done)
        rest = nodes.filter("not leaf").select(*_BOX)
        if rest.isEmpty():
            break
        x = F.col("x1") + F.floor(wide / 2).cast("int")
        y = F.col("y1") + F.ceil(high / 2).cast("int")
        east, south = F.col("xi") >= x, F.col("yi") >= y
        level = level.join(rest, list(_BOX)).select(
            "xi", "yi", "n",
            F.when(east, x).otherwise(F.col("x1")).alias("x1"), F.when(east, F.col("x2")).otherwise(x).alias("x2"),
            F.when(south, y).otherwise(F.col("y1")).alias("y1"), F.when(south, F.col("y2")).otherwise(y).alias("y2"),
        )
        level = cut(level, "level")
    return found


def tile_sizes(found: DataFrame, point_count: int) -> DataFrame:
    """One row per suggested tile, cells: a leaf's own; where a leaf was ended, as many tiles of about
    point_count points as fit in it, and what is over."""
    each = F.ceil(F.lit(float(point_count)) / (F.col("points") / F.col("cells"))).cast("long")
    several = F.concat(F.array_repeat(each, F.floor(F.col("cells") / each).cast("int")), F.array(F.col("cells") % each))
    return found.select(F.explode(F.when(F.col("ended"), several).otherwise(F.array("cells"))).alias("cells"))


def summary(sizes: DataFrame) -> DataFrame:
    """One row: num_cells and num_tiles of all, mean, std_dev, median of those that are no outliers; the median
    is recommended. A single tile is none,
    and where quartiles are equal, so that nothing lies strictly between them, all tiles count."""
    total = sizes.agg(F.sum("cells").alias("num_cells"), F.count(F.lit(1)).alias("num_tiles"))
    numbers = [F.avg("cells").alias("mean"), F.stddev_pop("cells").alias("std_dev"), F.median("cells").alias("median")]
    kept = without_outliers(sizes, "cells").agg(*numbers)
    alone = sizes.agg(*[x.alias(k) for x, k in zip((F.avg("cells"), F.stddev_pop("cells"), F.median("cells")), ("_a", "_b", "_c"))])
    out = total.crossJoin(F.broadcast(kept)).crossJoin(F.broadcast(alone))  # one row each
    pick: list[Column] = [F.when(F.col("num_tiles") > 1, F.coalesce(k, a)).otherwise(F.col(a)).alias(k) for k, a in (("mean", "_a"), ("std_dev", "_b"), ("median", "_c"))]
    return out.select("num_cells", "num_tiles", *pick).withColumn("recommended", F.col("median"))


def chunk(points: DataFrame, extents: Extents, point_count: int = 600_000) -> list[Extents]:
    """Work units of at most point_count points, split as far as cells allow; empty ones are left out. Units,
    not points, reach the driver."""
    rows = leaves(points, extents, point_count, 0, 64, exhaustive=True).select(*_BOX).orderBy(*_BOX).collect()
    return [Extents(extents.box_of(Rect(*r)), extents.resolution, extents.alignment, extents.root) for r in rows]


def assign_workers(units: DataFrame, workers: int, size: str = "points") -> DataFrame:
    """units with a worker: sorted by size, largest first, and dealt forth and back, so that loads come near
    each other without a running total on one machine. Units are tiles, not points."""
    order = Window.orderBy(F.col(size).desc(), *_BOX)
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(2 * workers))
    return units.withColumn("worker", F.when(turn < workers, turn).otherwise(2 * workers - 1 - turn).cast("int"))


def with_blocks(cells: DataFrame, side: int, x: str = "X", y: str = "Y") -> DataFrame:
    """cells with bx and by, the block of side by side cells that each lies in."""
    return cells.withColumns({"bx": F.floor(F.col(x) / side).cast("int"), "by": F.floor(F.col(y) / side).cast("int")})


def block_name() -> Column:
    return F.concat(F.lit("x"), "bx", F.lit("y"), "by")


def block_points(cells: DataFrame, side: int, points: Column | None = None, x: str = "X", y: str = "Y") -> DataFrame:
    """block, its name, bx, by, and the points in it: rows, or the sum of a column. Counts, not estimates, as one
    combining aggregation gives them."""
    found = with_blocks(cells, side, x, y).groupBy("bx", "by").agg((F.count(F.lit(1)) if points is None else F.sum(points)).alias("points"))
    return found.select(block_name().alias("block"), "bx", "by", "points")


def units_with_points(units: DataFrame, blocks: DataFrame) -> DataFrame:
    """units, which have a block by name, with its points; 0 where no point is in it."""
    return units.join(blocks.select("block", "points"), "block", "left").withColumn("points", F.coalesce("points", F.lit(0).cast("long")))


def balanced(sizes: Sequence[float], workers: int) -> list[int]:
    """A worker for each of some units: the largest unit first, each to the least loaded worker, the first of equal
    ones. For units that a driver holds, as chunk() gives them; assign_workers() is for tables of them."""
    loads = [(0.0, w) for w in range(workers)]
    out = [0] * len(sizes)
    for k in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        load, out[k] = heapq.heappop(loads)
        heapq.heappush(loads, (load + sizes[k], out[k]))
    return out


def union_box(units: DataFrame) -> DataFrame:
    """One row: the index range around all units."""
    return units.agg(F.min("x1").alias("x1"), F.max("x2").alias("x2"), F.min("y1").alias("y1"), F.max("y2").alias("y2"))
