"""Point sources: tables of points with X, Y and attribute columns."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.cells import boxes_meet
from ..grid import Bounds
from ..operators.relational import clip, count_points, source_bounds
from . import las

#: Formats that Spark reads by itself, LAS files, and "tindex", an index of Parquet or LAS files.
FORMATS = ("parquet", "orc", "csv", "json", "avro", "table", "las", "tindex")


@dataclass
class PointSource:
    """One reader and a chain of transforms after it. A transform maps a DataFrame to a DataFrame, so it can
    filter and derive, but not write."""

    location: str
    format: str = "parquet"
    options: dict[str, str] = field(default_factory=dict)
    transforms: tuple[Callable[[DataFrame], DataFrame], ...] = ()
    ignore_corrupt: bool = False

    def __post_init__(self) -> None:
        if self.format not in FORMATS:
            raise ValueError(f"{self.format} is none of {', '.join(FORMATS)}")

    @classmethod
    def of(cls, location: str, spark: SparkSession | None = None) -> PointSource:
        """From a path, by its ending; a .json file that holds a pipeline names its one reader."""
        if location.endswith(".json") and spark is not None:
            text = "\n".join(r.value for r in spark.read.text(location, wholetext=True).collect())
            try:
                found = json.loads(text)
            except json.JSONDecodeError:
                return cls(location, "json")
            if isinstance(found, dict) and "pipeline" in found:
                return cls.from_pipeline(found["pipeline"])
        ending = location.rstrip("/").rpartition(".")[2].lower()
        return cls(location, ending if ending in FORMATS else "parquet")

    @classmethod
    def from_pipeline(cls, stages: list) -> PointSource:
        """A list of stages: one reader first, then SQL filters or projections; writers are left out."""
        stages = [{"type": "readers.parquet", "filename": s} if isinstance(s, str) else s for s in stages]
        readers = [s for s in stages if s.get("type", "").startswith("readers.")]
        if len(readers) != 1 or stages[0] is not readers[0]:
            raise ValueError("a pipeline has exactly one reader, and it comes first")
        transforms = []
        for s in stages[1:]:
            kind = s.get("type", "")
            if kind == "filters.where":
                transforms.append(lambda df, e=s["expression"]: df.filter(e))
            elif kind == "filters.assign":
                transforms.append(lambda df, v=dict(s["value"]): df.withColumns({k: F.expr(e) for k, e in v.items()}))
            elif not kind.startswith("writers."):
                raise ValueError(f"unknown stage {kind!r}")
        return cls(readers[0]["filename"], readers[0]["type"].partition(".")[2], dict(readers[0].get("options", {})), tuple(transforms))

    def read(self, spark: SparkSession, box: Bounds | None = None) -> DataFrame:
        """The points, inside box if one is given. The comparison reaches the scan; columns are pruned by what
        is used of them."""
        options = self.options | ({"ignoreCorruptFiles": "true"} if self.ignore_corrupt else {})
        if self.format == "tindex":
            out = self._indexed(spark, box, options)
        elif self.format == "las":
            out = self._las(spark, self.location, box)
        elif self.format == "table":
            out = spark.read.table(self.location)
        else:
            out = spark.read.format(self.format).options(**options).load(self.location)
        for f in self.transforms:
            out = out.transform(f)
        return clip(out, box) if box else out

    def _indexed(self, spark: SparkSession, box: Bounds | None, options: dict[str, str]) -> DataFrame:
        """The location is a table of (location, minx, miny, maxx, maxy), one row per file; files whose box
        doesn't meet the query's are not opened. File names reach the driver, as they do for any scan."""
        index = spark.read.parquet(self.location)
        if box:
            index = index.filter(boxes_meet(box, *[F.col(c) for c in ("minx", "miny", "maxx", "maxy")]))
        paths = [r.location for r in index.select("location").distinct().orderBy("location").collect()]
        if not paths:
            raise ValueError("no file of the index meets the box")
        if all(p.lower().endswith(".las") for p in paths):
            return self._las(spark, "\n".join(paths), box)
        return spark.read.options(**options).parquet(*paths)

    def _las(self, spark: SparkSession, location: str, box: Bounds | None) -> DataFrame:
        """box only keeps files from being read: transforms may move points, which are clipped after them."""
        spark.dataSource.register(las.LasSource)
        return spark.read.format("las").options(path=location, box=box.to_string() if box and not self.transforms else "").load()

    def bounds(self, spark: SparkSession) -> Bounds:
        """Of LAS files as they are, from their headers."""
        if self.format == "las" and not self.transforms:
            return las.extent(self.location)
        row = source_bounds(self.read(spark)).first()
        return Bounds(*map(float, row))

    def count(self, spark: SparkSession, box: Bounds | None = None) -> int:
        return count_points(self.read(spark, box)).first().n

    def estimate_count(self, spark: SparkSession, box: Bounds | None = None, resolution: float | None = None) -> int:
        """With a resolution, what a coarse reading would see: a point for each square that has any. Without one,
        LAS files are counted by the headers of those that meet the box."""
        if self.format == "las" and resolution is None and not self.transforms:
            return sum(h.points for h in las.headers(self.location, box))
        return count_points(self.read(spark, box), None, resolution).first().n


def lineitem_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A point cloud from the lineitem table: part and supplier give the place, quantity the height, price the
    intensity, the line number the return."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return rows.select(
        F.col("l_partkey").cast("double").alias("X"),
        (F.col("l_suppkey") * 20).cast("double").alias("Y"),
        F.col("l_quantity").alias("Z"),
        F.col("l_extendedprice").alias("Intensity"),
        F.col("l_linenumber").alias("ReturnNumber"),
        F.col("l_orderkey").alias("OrderKey"),
        F.col("l_shipdate").alias("Time"),
    )


def with_number_of_returns(points: DataFrame, pulse: str = "OrderKey") -> DataFrame:
    """How many returns each point's pulse has."""
    return points.withColumn("NumberOfReturns", F.count(F.lit(1)).over(Window.partitionBy(pulse)).cast("int"))


def event_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cloud from the events table: user by day, with the value as height."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    return rows.select(F.col("user_id").cast("double").alias("X"), F.unix_date(F.col("ts").cast("date")).cast("double").alias("Y"), F.col("value").alias("Z"), F.col("ts").alias("Time"))
