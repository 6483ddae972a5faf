"""Command line: stratagrid -d STORE VERB ..."""

from __future__ import annotations

import argparse
import json
import logging

from . import jobs
from .config import ExtractConfig, ShatterConfig, StorageConfig, parse_attributes
from .grid import Bounds
from .operators.metrics import parse_metrics


SECTIONS = ("history", "metadata", "attributes", "metrics")


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="stratagrid", description=__doc__)
    out.add_argument("--database", "-d", required=True)
    out.add_argument("--master", default=None)
    out.add_argument("--debug", action="store_true")
    out.add_argument("--log-file", default=None)
    verbs = out.add_subparsers(dest="verb", required=True)

    v = verbs.add_parser("initialize")
    v.add_argument("--bounds", type=Bounds.from_string, required=True)
    v.add_argument("--crs", default="")
    v.add_argument("--attributes", "-a", type=parse_attributes, default=parse_attributes(None))
    v.add_argument("--metrics", "-m", default="grid_metrics")
    v.add_argument("--resolution", type=float, default=30.0)
    v.add_argument("--alignment", default="AlignToCenter")
    v.add_argument("--xsize", type=int, default=1000)
    v.add_argument("--ysize", type=int, default=1000)

    v = verbs.add_parser("scan")
    v.add_argument("pointcloud")
    v.add_argument("--bounds", type=Bounds.from_string)
    v.add_argument("--resolution", type=float, default=100)
    v.add_argument("--point_count", type=int, default=600_000)
    v.add_argument("--depth", type=int, default=6)

    v = verbs.add_parser("shatter")
    v.add_argument("--parts", type=int, default=1)
    v.add_argument("pointcloud")
    v.add_argument("--bounds", type=Bounds.from_string)
    v.add_argument("--tilesize", type=int)
    v.add_argument("--processing-strategy", default="leaf-v1")
    v.add_argument("--read-group-size", type=int)
    v.add_argument("--processing-halo-m", type=float)
    v.add_argument("--publish-uri")
    v.add_argument("--stage-dir")
    v.add_argument("--stage-file-mb", type=int, default=300)
    v.add_argument("--shard-side-groups", type=int, default=4)
    v.add_argument("--shard-target-points", type=int)
    v.add_argument("--no-lists", action="store_true")
    dates = v.add_mutually_exclusive_group(required=True)
    dates.add_argument("--date")
    dates.add_argument("--dates", nargs=2)

    v = verbs.add_parser("extract")
    v.add_argument("--outdir", "-o", required=True)
    v.add_argument("--attributes", "-a")
    v.add_argument("--metrics", "-m")
    v.add_argument("--bounds", type=Bounds.from_string)
    v.add_argument("--date")
    v.add_argument("--dates", nargs=2)

    v.add_argument("--format", choices=("tif", "asc"), default="tif")

    v = verbs.add_parser("info")
    v.add_argument("--bounds", type=Bounds.from_string)
    v.add_argument("--date")
    v.add_argument("--dates", nargs=2)
    v.add_argument("--name")
    v.add_argument("--concise", action="store_true")
    for section in SECTIONS:
        v.add_argument(f"--{section}", action="store_true")

    for verb in ("delete", "restart", "resume"):
        verbs.add_parser(verb).add_argument("--id", "--task_id", dest="id", required=True)
    verbs.add_parser("consolidate").add_argument("--files", type=int)
    return out


def run(args: argparse.Namespace, spark):
    store = args.database
    if args.verb == "initialize":
        return jobs.initialize(spark, StorageConfig(store, args.bounds, args.crs, args.resolution, args.alignment, args.xsize, args.ysize, args.attributes, parse_metrics(args.metrics))).path
    if args.verb == "scan":
        return jobs.scan(spark, store, args.pointcloud, args.bounds, args.point_count, args.resolution, args.depth)
    if args.verb == "shatter":
        return jobs.shatter(spark, ShatterConfig(store, args.pointcloud, args.dates or args.date, args.bounds, tile_size=args.tilesize, processing_strategy=args.processing_strategy, read_group_size=args.read_group_size, processing_halo_m=args.processing_halo_m, publish_uri=args.publish_uri, stage_dir=args.stage_dir, stage_file_mb=args.stage_file_mb, shard_side_groups=args.shard_side_groups, shard_target_points=args.shard_target_points, lists=not args.no_lists, parts=args.parts))
    if args.verb == "extract":
        split = lambda x: x.split(",") if x else None
        return jobs.extract(spark, ExtractConfig(store, args.outdir, split(args.attributes), split(args.metrics), args.bounds, args.dates or args.date, args.format))
    if args.verb == "info":
        from .config import date_range

        dates = args.dates or args.date
        found = jobs.info(spark, store, date_range(dates) if dates else None, args.bounds, args.name, args.concise)
        chosen = [k for k in SECTIONS if getattr(args, k)]
        return {k: found[k] for k in chosen} if chosen else found
    if args.verb == "consolidate":
        return jobs.consolidate(spark, store, args.files)
    done = getattr(jobs, args.verb)(spark, store, args.id)
    return done.to_json() if args.verb == "delete" else done


def main(argv: list[str] | None = None, spark=None):
    args = parser().parse_args(argv)
    logging.basicConfig(level=logging.DEBUG if args.debug else logging.INFO, filename=args.log_file)
    if spark is None:
        from pyspark.sql import SparkSession

        builder = SparkSession.builder.appName("stratagrid")
        spark = (builder.master(args.master) if args.master else builder).getOrCreate()
    out = run(args, spark)
    print(json.dumps(out, indent=2, default=str))
    return out


if __name__ == "__main__":
    main()
