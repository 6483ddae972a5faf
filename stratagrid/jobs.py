"""The verbs: initialize, scan, shatter, info, extract, delete, restart, resume."""

from __future__ import annotations

import logging
import time
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import raster
from .config import ExtractConfig, ShatterConfig, StorageConfig
from .grid import Bounds, Extents, Rect
from .operators import relational, tiling
from .plans.fused import cell_metrics, outputs
from .sources.points import PointSource
from .sources.store import ShardGroup, Storage

log = logging.getLogger("stratagrid")


def initialize(spark: SparkSession, config: StorageConfig) -> Storage:
    return Storage.create(spark, config)


def _points(spark: SparkSession, source, box: Bounds) -> DataFrame:
    """From a DataFrame, a PointSource or a path."""
    if isinstance(source, DataFrame):
        return relational.clip(source, box)
    return (source if isinstance(source, PointSource) else PointSource.of(source, spark)).read(spark, box)


def _extents(storage: Storage, bounds: Bounds | None) -> Extents | None:
    c, whole = storage.config, storage.config.extents
    if bounds is None:
        return whole
    box = bounds.aligned(c.resolution, c.alignment).shared(whole.bounds)
    return Extents(box, c.resolution, c.alignment, whole.root) if box else None


def scan(spark: SparkSession, store: str, source, bounds: Bounds | None = None, point_count: int = 600_000, resolution: float = 100, depth: int = 6) -> dict:
    """How many cells to put in a tile."""
    storage = Storage.from_db(spark, store)
    extents = _extents(storage, bounds)
    points = _points(spark, source, extents.bounds)
    found = tiling.leaves(points, extents, point_count, resolution, depth)
    row = tiling.summary(tiling.tile_sizes(found, point_count)).first()
    total = found.agg(F.sum("points")).first()[0] or 0
    out = {
        "pc_info": {"storage_bounds": storage.config.root.to_json(), "data_bounds": extents.bounds.to_json(), "count": total},
        "tile_info": row.asDict(),
    }
    log.info("%s", out)
    return out


def bands(rect: Rect, parts: int) -> list[Rect]:
    """rect in so many runs of rows, or as many as it has rows."""
    rows = rect.y2 - rect.y1
    edges = [rect.y1 + rows * k // min(parts, rows) for k in range(min(parts, rows) + 1)] if rows else []
    return [Rect(rect.x1, rect.x2, a, b) for a, b in zip(edges, edges[1:])]


def shatter(spark: SparkSession, config: ShatterConfig, source=None) -> int:
    """Add the metrics of a source's points to the store, as one run; the number of points. Each of config.parts
    is recorded when it is written. What the record says is finished isn't done again; a part that was written and
    not recorded is replaced."""
    storage = Storage.from_db(spark, config.store)
    extents = _extents(storage, config.bounds)
    config.time_slot = config.time_slot or storage.reserve_time_slot()
    config.start_timestamp = time.time() * 1000
    storage.save_process(config)
    if extents is None:
        return _finish(storage, config, 0, None)
    home = _stage(storage, config) if config.stage_dir else storage
    names = storage.config.attribute_names
    done = [Rect(x1, x2 + 1, y1, y2 + 1) for (x1, x2), (y1, y2) in config.mbr]
    for part, band in enumerate(bands(extents.rect, config.parts)):
        if any(d.x1 <= band.x1 and d.x2 >= band.x2 and d.y1 <= band.y1 and d.y2 >= band.y2 for d in done):
            continue
        box = extents.bounds if config.parts == 1 else extents.box_of(band)
        points = relational.in_rect(relational.assign_cells(_points(spark, source if source is not None else config.filename, box), extents), band, "xi", "yi")
        cells = cell_metrics(relational.outside_rects(points, done), storage.config.metrics, names, lists=config.lists)
        began = time.time()
        home.write(cells, config.time_slot, config.date, int(config.start_timestamp), part)
        config.timings = [*config.timings, {"phase": "cells", "part": part, "seconds": time.time() - began}]
        config.mbr = [*config.mbr, [[band.x1, band.x2 - 1], [band.y1, band.y2 - 1]]]
        storage.save_process(config)
    written = home.all_rows().filter(F.col("time_slot") == config.time_slot).agg(F.sum("count")).first()[0] or 0
    if config.publish_uri:
        began = time.time()
        if config.stage_dir:
            home.set_stage_state("written", points=int(written))
            home.consolidate_by_plan(config.stage_file_mb << 20)
            home.set_stage_state("consolidated", points=int(written))
        group = ShardGroup.at(spark, config.publish_uri)
        if group:
            group.publish_from(home, config.time_slot, config.name, config.shard_side, config.shard_target_points)
        else:
            home.publish(config.publish_uri, config.time_slot)
        if config.stage_dir:
            home.set_stage_state("published", points=int(written), uri=config.publish_uri)
        config.timings = [*config.timings, {"phase": "publish", "part": 0, "seconds": time.time() - began}]
    return _finish(storage, config, int(written), extents)


def _stage(storage: Storage, config: ShatterConfig) -> Storage:
    """The run's stage; that of a run that broke off is taken up again."""
    path = f"{config.stage_dir.rstrip('/')}/{config.name}"
    return Storage.from_db(storage.spark, path) if storage.files.exists(f"{path}/config.json") else storage.create_stage(path)


def _finish(storage: Storage, config: ShatterConfig, points: int, extents: Extents | None) -> int:
    config.point_count, config.finished, config.end_timestamp = points, True, time.time() * 1000
    if extents is not None:
        r = extents.rect
        config.mbr = [[[r.x1, r.x2 - 1], [r.y1, r.y2 - 1]]]
    storage.save_process(config)
    return points


def info(spark: SparkSession, store: str | Storage, dates=None, bounds: Bounds | None = None, name: str | None = None, concise: bool = False) -> dict:
    storage = store if isinstance(store, Storage) else Storage.from_db(spark, store)
    found = storage.config.to_json()
    if concise:
        found = {k: v for k, v in found.items() if k not in ("attrs", "metrics")}
    return {"attributes": [a.to_json() for a in storage.config.attrs], "metrics": [m.to_json() for m in storage.config.metrics], "metadata": found, "history": storage.history(dates, bounds, name, concise)}


def extract_cells(spark: SparkSession, config: ExtractConfig) -> DataFrame:
    """X, Y and the chosen columns of the newest cells."""
    storage = Storage.from_db(spark, config.store)
    names = storage.config.derived_names(config.metrics, config.attrs)
    return storage.read(names, config.bounds, config.date)


def extract(spark: SparkSession, config: ExtractConfig) -> list[str]:
    """Write a raster for each column; the paths. The frame is the whole of the bounds, so the geotransform
    holds whatever cells there are."""
    storage = Storage.from_db(spark, config.store)
    extents = _extents(storage, config.bounds)
    if extents is None:
        raise ValueError("the bounds don't meet the store's")
    empty, c, at = storage.no_data(), storage.config, storage.files.qualified(config.out_dir.rstrip("/"))
    names = c.derived_names(config.metrics, config.attrs)
    kinds = {m.entry_name(a): m.dtype for m, a in outputs(c.metrics, c.attribute_names)}
    out = raster.write(extract_cells(spark, config), names, kinds, empty, extents, c.crs, at, config.form)
    about = raster.gdal_metadata(names, kinds, extents.rect, extents.bounds, c.resolution, c.crs, empty)
    storage.files.write(f"{at}/bands.aux.xml", about)
    return out


def timings(spark: SparkSession, store: str) -> DataFrame:
    """Of each run and phase: how many parts, their seconds together and the longest."""
    storage = Storage.from_db(spark, store)
    rows = [(p.name, t["phase"], t["part"], float(t["seconds"])) for p in storage.processes() for t in p.timings]
    found = spark.createDataFrame(rows, "name string, phase string, part int, seconds double")
    return found.groupBy("name", "phase").agg(F.count(F.lit(1)).alias("parts"), F.sum("seconds").alias("seconds"), F.max("seconds").alias("longest"))


def delete(spark: SparkSession, store: str, name: str) -> ShatterConfig:
    """Drop a run's cells; older runs show through again. Its record stays, unfinished."""
    storage = Storage.from_db(spark, store)
    run = storage.process(name)
    storage.drop_slot(run.time_slot)
    run.finished, run.mbr, run.point_count, run.timings = False, [], 0, []
    storage.save_process(run)
    return run


def restart(spark: SparkSession, store: str, name: str, source=None) -> int:
    """Delete and run again with the same settings."""
    run = delete(spark, store, name)
    return shatter(spark, run, source)


def resume(spark: SparkSession, store: str, name: str, source=None) -> int:
    """Run what is outside the finished rectangles of a run."""
    run = Storage.from_db(spark, store).process(name)
    return run.point_count if run.finished else shatter(spark, run, source)


def consolidate(spark: SparkSession, store: str, files: int | None = None, between: tuple[int | None, int | None] = (None, None)) -> None:
    """All runs, or those that started between two epoch milliseconds."""
    storage = Storage.from_db(spark, store)
    storage.vacuum()
    low, high = between
    for p in storage.processes():
        at = p.start_timestamp
        if (low is not None and (at is None or at < low)) or (high is not None and (at is None or at > high)):
            continue
        if storage.files.exists(f"{storage.path}/cells/time_slot={p.time_slot}"):
            storage.consolidate(p.time_slot, files)


def as_of(spark: SparkSession, store: str, first: datetime | None, last: datetime | None) -> DataFrame:
    """The cells as runs between two moments have left them."""
    ms = lambda d: None if d is None else int(d.timestamp() * 1000)
    return Storage.from_db(spark, store).read(until=(ms(first), ms(last)))
