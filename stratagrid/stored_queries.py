"""Queries that go through a store: runs are written to one in the shared folder and read back."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import jobs
from .config import ExtractConfig, ShatterConfig, StorageConfig
from .grid import Rect
from .operators import relational, tiling
from .operators.metrics import attribute, product_moments, statistics
from .oracle import C, IN_CELLS
from .plans.cut import shared_folder
from .queries import BOX, RESOLUTION, ROOT, anchored, frame, grid
from .sources.points import lineitem_points
from .sources.store import ShardGroup, Storage, union_of

#: The first run has the points before DAY or from X = EAST on, the second run the others.
DAY, EAST = "1998-05-24", 1000
FIRST, SECOND = (datetime(1992, 1, 1), datetime(1998, 5, 23)), (datetime(1998, 5, 24), datetime(1998, 12, 31))
COLUMNS = ["count", "m_Z_mean", "m_Z_max"]
#: Cells to the side of a published block.
SIDE = 16


def stored(spark: SparkSession, sf_dir: str) -> Storage:
    """A store with both runs."""
    points = lineitem_points(spark, sf_dir)
    config = StorageConfig(f"{shared_folder(spark)}/store-{uuid.uuid4().hex}", frame(points), "", RESOLUTION, "AlignToCorner", attrs=[attribute("Z")], metrics=[product_moments["mean"], statistics["max"]])
    storage = jobs.initialize(spark, config)
    early = (F.col("Time") < DAY) | (F.col("X") >= EAST)
    for name, dates, some in (("first", FIRST, early), ("second", SECOND, ~early)):
        jobs.shatter(spark, ShatterConfig(storage.path, "lineitem", dates, name=name, lists=False, parts=2 if name == "second" else 1), points.filter(some))
    return storage


def numbered(found: DataFrame, storage: Storage) -> DataFrame:
    """Cells of a store numbered from ROOT's north-west corner, as those of the other queries are; the store counts
    from its own, which lies farther out where points do."""
    root = storage.config.extents.root
    across, down = round((ROOT.minx - root.minx) / RESOLUTION), round((root.maxy - ROOT.maxy) / RESOLUTION)
    shift = {"X": across, "x1": across, "x2": across, "Y": down, "y1": down, "y2": down}
    return found.withColumns({k: F.col(k) - v for k, v in shift.items() if k in found.columns})


def store_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest row of each cell."""
    storage = stored(spark, sf_dir)
    return numbered(storage.read(COLUMNS), storage).select("X", "Y", "time_slot", *COLUMNS)


def store_in_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    storage = stored(spark, sf_dir)
    return numbered(storage.read(COLUMNS, bounds=BOX), storage).select("X", "Y", "time_slot", *COLUMNS)


def store_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells as they were after the first run."""
    storage = stored(spark, sf_dir)
    return numbered(storage.read(COLUMNS, until=(None, int(storage.process("first").start_timestamp))), storage).select("X", "Y", "time_slot", *COLUMNS)


def store_by_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of runs whose dates meet those of the second one only."""
    storage = stored(spark, sf_dir)
    return numbered(storage.read(COLUMNS, dates=(datetime(1998, 6, 1), datetime(1998, 7, 1))), storage).select("X", "Y", "time_slot", *COLUMNS)


def store_after_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    storage = stored(spark, sf_dir)
    jobs.delete(spark, storage.path, "second")
    return numbered(storage.read(COLUMNS), storage).select("X", "Y", "time_slot", *COLUMNS)


def store_after_restart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second run again, now with all points."""
    storage = stored(spark, sf_dir)
    jobs.restart(spark, storage.path, "second", lineitem_points(spark, sf_dir))
    return numbered(storage.read(COLUMNS), storage).select("X", "Y", "time_slot", *COLUMNS)


def store_consolidated(spark: SparkSession, sf_dir: str) -> DataFrame:
    storage = stored(spark, sf_dir)
    jobs.consolidate(spark, storage.path, 2)
    return numbered(storage.read(COLUMNS), storage).select("X", "Y", "time_slot", *COLUMNS)


def store_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run of four bands whose record says that a part of the cells is finished."""
    storage = stored(spark, sf_dir)
    whole = storage.config.extents.root
    down, across = int(whole.maxy - 20000) // RESOLUTION, int(-whole.minx) // RESOLUTION
    done = [[[across, across + 4], [down + 190, down + 194]]]
    config = ShatterConfig(storage.path, "lineitem", FIRST, name="again", lists=False, parts=4, mbr=done, time_slot=storage.reserve_time_slot())
    storage.save_process(config)
    jobs.resume(spark, storage.path, "again", lineitem_points(spark, sf_dir))
    return numbered(storage.all_rows().filter(F.col("time_slot") == config.time_slot), storage).select("X", "Y", "count")


def store_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir).history_frame().select("name", "point_count", "finished", "time_slot")


def store_runs_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs whose dates meet a month and whose box meets a box."""
    return stored(spark, sf_dir).runs_at((datetime(1998, 6, 1), datetime(1998, 7, 1)), BOX).select("name", "time_slot")


def store_published(spark: SparkSession, sf_dir: str) -> DataFrame:
    storage = stored(spark, sf_dir)
    uri = f"{storage.path}-published"
    storage.publish(uri, storage.process("second").time_slot)
    return numbered(spark.read.parquet(uri), storage).select("X", "Y", *COLUMNS)


def store_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each part of the runs holds; the second run has two."""
    storage = stored(spark, sf_dir)
    return numbered(storage.fragments(), storage).select("time_slot", "part", "cells", "x1", "x2", "y1", "y2")


def store_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All points as a run that is written to a stage and published as a shard in blocks of SIDE x SIDE cells."""
    points = lineitem_points(spark, sf_dir)
    at = f"{shared_folder(spark)}/store-{uuid.uuid4().hex}"
    make = lambda name: StorageConfig(f"{at}/{name}", frame(points), "", RESOLUTION, "AlignToCorner", attrs=[attribute("Z")], metrics=[product_moments["mean"], statistics["max"]])
    group = ShardGroup.create(spark, make("group"))
    storage = jobs.initialize(spark, make("seed"))
    jobs.shatter(spark, ShatterConfig(
        storage.path, "lineitem", FIRST, name="whole", lists=False, processing_strategy="macro-v3-stage-push", tile_size=16, read_group_size=64,
        stage_dir=f"{at}/stages", publish_uri=group.path, shard_side_groups=SIDE // 8, shard_target_points=1000,
    ), points)
    blocks = tiling.with_blocks(numbered(group.read_shard("whole", COLUMNS), storage), SIDE).withColumn("block", tiling.block_name())
    return blocks.select("block", "X", "Y", *COLUMNS)


def shard_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The points of each block of the grid, from the table of the blocks that have any."""
    points = lineitem_points(spark, sf_dir)
    whole = anchored(grid(points))
    rect = whole.rect
    found = tiling.block_points(relational.assign_cells(points, whole), SIDE, x="xi", y="yi")
    units = relational.all_cells(spark, Rect(rect.x1 // SIDE, -(-rect.x2 // SIDE), rect.y1 // SIDE, -(-rect.y2 // SIDE)), "bx", "by").withColumn("block", tiling.block_name())
    return tiling.units_with_points(units.select("block"), found)


def store_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two stores on one grid as one: the newer slot of each cell, whichever store has it."""
    one, two = stored(spark, sf_dir), stored(spark, sf_dir)
    jobs.delete(spark, one.path, "second")
    return numbered(union_of([one, two], columns=COLUMNS), one).select("X", "Y", "time_slot", *COLUMNS)


def store_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells that extract() makes a raster of."""
    storage = stored(spark, sf_dir)
    return numbered(jobs.extract_cells(spark, ExtractConfig(storage.path, "", ["Z"], ["max"], BOX)), storage).select("X", "Y", "m_Z_max")


_EARLY = f"(T < '{DAY}' OR X >= {EAST})"
_MADE = "count(*) AS count, (CASE WHEN max(abs(Z)) > 0 THEN avg(Z) END)::FLOAT AS m_Z_mean, max(Z)::FLOAT AS m_Z_max"
_ROWS = f"{C}, r AS (SELECT xi AS X, yi AS Y, CASE WHEN {_EARLY} THEN 1 ELSE 2 END AS time_slot, {_MADE} FROM c GROUP BY ALL)"
_NEWEST = "(SELECT *, row_number() OVER (PARTITION BY X, Y ORDER BY time_slot DESC) AS k FROM r) WHERE k = 1"
_ALL = "X, Y, time_slot, count, m_Z_mean, m_Z_max"
_CELLS = f"WITH {_ROWS} SELECT {_ALL} FROM {_NEWEST}"
_BOXED = IN_CELLS.replace("X", "c.X").replace("Y", "c.Y")
_IN_BOX = f"{C}, r AS (SELECT xi AS X, yi AS Y, CASE WHEN {_EARLY} THEN 1 ELSE 2 END AS time_slot, {_MADE} FROM c WHERE {_BOXED} GROUP BY ALL)"

ORACLE_SQL = {
    "store_cells": _CELLS,
    "store_in_box": f"WITH {_IN_BOX} SELECT {_ALL} FROM {_NEWEST}",
    "store_as_of": f"WITH {_ROWS} SELECT {_ALL} FROM r WHERE time_slot = 1",
    "store_by_date": f"WITH {_ROWS} SELECT {_ALL} FROM r WHERE time_slot = 2",
    "store_after_delete": f"WITH {_ROWS} SELECT {_ALL} FROM r WHERE time_slot = 1",
    "store_after_restart": f"WITH {C} SELECT xi AS X, yi AS Y, 2 AS time_slot, {_MADE} FROM c GROUP BY xi, yi",
    "store_consolidated": _CELLS,
    "store_resumed": f"WITH {C} SELECT xi AS X, yi AS Y, count(*) AS count FROM c WHERE NOT (xi < 5 AND yi >= 190 AND yi < 195) GROUP BY xi, yi",
    "store_history": f"WITH {C} SELECT CASE WHEN k = 1 THEN 'first' ELSE 'second' END AS name, (SELECT count(*) FROM c WHERE {_EARLY} = (k = 1)) AS point_count, true AS finished, k::INT AS time_slot FROM range(1, 3) AS t(k)",
    "store_runs_at": "SELECT 'second' AS name, 2 AS time_slot",
    "store_published": f"WITH {_ROWS} SELECT X, Y, count, m_Z_mean, m_Z_max FROM r WHERE time_slot = 2",
    "store_fragments": f"WITH {_ROWS} SELECT time_slot, part, count(*) AS cells, min(X) AS x1, max(X) AS x2, min(Y) AS y1, max(Y) AS y2 FROM (SELECT *, CASE WHEN time_slot = 2 AND Y >= 100 THEN 1 ELSE 0 END AS part FROM r) GROUP BY time_slot, part",
    "store_shards": f"WITH {C} SELECT 'x' || (xi // {SIDE}) || 'y' || (yi // {SIDE}) AS block, xi AS X, yi AS Y, {_MADE} FROM c GROUP BY xi, yi",
    "shard_points": f"WITH {C}, n AS (SELECT 'x' || (xi // {SIDE}) || 'y' || (yi // {SIDE}) AS block, count(*) AS points FROM c GROUP BY 1) SELECT 'x' || a || 'y' || b AS block, coalesce(points, 0) AS points FROM range({-(-200 // SIDE)}) AS s(a) CROSS JOIN range({-(-200 // SIDE)}) AS t(b) LEFT JOIN n ON n.block = 'x' || a || 'y' || b",
    "store_union": _CELLS,
    "store_extract": f"WITH {_IN_BOX} SELECT X, Y, m_Z_max FROM {_NEWEST}",
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    store_cells, store_in_box, store_as_of, store_by_date, store_after_delete, store_after_restart, store_consolidated, store_resumed, store_history, store_runs_at,
    store_published, store_fragments, store_shards, shard_points, store_union, store_extract,
)}
