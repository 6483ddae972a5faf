"""The store of cells: Parquet partitions by time slot, and JSON files beside them.

Layout: config.json; processes/{slot}.json, one record per run; cells/time_slot={slot}/part={part}/. A run appends
its own partition, so runs don't overwrite each other: readers take the newest row of each cell. A part of a run is
replaced as a whole, so writing it again doesn't count anything twice. All files go through the Hadoop file system
of the session.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ShatterConfig, StorageConfig
from ..functions.cells import boxes_meet, range_encloses, ranges_overlap
from ..grid import Bounds, Extents, Rect
from ..operators import relational, tiling
from ..operators.metrics import DTYPES
from ..plans.fused import outputs


#: Bytes of a file that consolidation writes, about.
FILE_BYTES = 128 << 20


class Files:
    """Small text files on whatever file system the session knows."""

    def __init__(self, spark: SparkSession) -> None:
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        where = self._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self._conf), where

    def qualified(self, path: str) -> str:
        """path with its file system's scheme, as readers outside the JVM want it."""
        fs, where = self._at(path)
        out = fs.makeQualified(where).toString()
        return "file://" + out.removeprefix("file:") if out.startswith("file:/") and not out.startswith("file://") else out

    def exists(self, path: str) -> bool:
        fs, where = self._at(path)
        return fs.exists(where)

    def write(self, path: str, text: str) -> None:
        fs, where = self._at(path)
        out = fs.create(where, True)
        try:
            out.write(bytearray(text, "utf-8"))
        finally:
            out.close()

    def read(self, path: str) -> str:
        fs, where = self._at(path)
        source = fs.open(where)
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(source)).decode("utf-8")
        finally:
            source.close()

    def names(self, path: str) -> list[str]:
        fs, where = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []

    def delete(self, path: str) -> None:
        fs, where = self._at(path)
        fs.delete(where, True)

    def size(self, path: str) -> int:
        """Bytes of all files below."""
        fs, where = self._at(path)
        return fs.getContentSummary(where).getLength()

    def rename(self, path: str, to: str) -> None:
        fs, where = self._at(path)
        if not fs.rename(where, self._jvm.org.apache.hadoop.fs.Path(to)):
            raise OSError(f"{path} could not become {to}")


class Storage:
    def __init__(self, spark: SparkSession, config: StorageConfig) -> None:
        self.spark, self.config, self.files = spark, config, Files(spark)
        self.path = config.store.rstrip("/")

    @classmethod
    def create(cls, spark: SparkSession, config: StorageConfig) -> Storage:
        out = cls(spark, config)
        if out.files.exists(f"{out.path}/config.json"):
            raise FileExistsError(out.path)
        out.save_config()
        return out

    @classmethod
    def from_db(cls, spark: SparkSession, path: str) -> Storage:
        files = Files(spark)
        if not files.exists(f"{path.rstrip('/')}/config.json"):
            raise FileNotFoundError(f"{path} holds no store")
        config = StorageConfig.from_string(files.read(f"{path.rstrip('/')}/config.json"))
        config.store = path
        return (ShardGroup if files.exists(f"{path.rstrip('/')}/group.json") else cls)(spark, config)

    # Metadata

    def save_config(self) -> None:
        self.save_metadata("config", json.dumps(self.config.to_json()))

    def save_metadata(self, key: str, text: str) -> None:
        self.files.write(f"{self.path}/{key}.json", text)

    def get_metadata(self, key: str, default: str | None = None) -> str | None:
        at = f"{self.path}/{key}.json"
        return self.files.read(at) if self.files.exists(at) else default

    def reserve_time_slot(self) -> int:
        """1, 2, 3, ...; one driver at a time."""
        self.config = StorageConfig.from_string(self.get_metadata("config")) if self.get_metadata("config") else self.config
        self.config.store = self.path
        slot = self.config.next_time_slot
        self.config.next_time_slot += 1
        self.save_config()
        return slot

    def save_process(self, run: ShatterConfig) -> None:
        self.save_metadata(f"processes/{run.time_slot:09d}", json.dumps(run.to_json()))

    def processes(self) -> list[ShatterConfig]:
        names = self.files.names(f"{self.path}/processes")
        return [ShatterConfig.from_dict(json.loads(self.files.read(f"{self.path}/processes/{n}"))) for n in names if n.endswith(".json")]

    def process(self, name: str) -> ShatterConfig:
        found = [p for p in self.processes() if p.name == str(name)]
        if not found:
            raise KeyError(f"no process is called {name}")
        if len(found) > 1:
            raise ValueError(f"{len(found)} processes are called {name}")
        return found[0]

    def history(self, dates=None, bounds: Bounds | None = None, name: str | None = None, concise: bool = False) -> list[dict]:
        """Records whose dates overlap, whose box meets bounds and that have the name."""
        out = []
        for p in self.processes():
            box = p.bounds or self.config.root
            if (dates and (p.date[0] > dates[1] or p.date[1] < dates[0])) or (bounds and box.disjoint(bounds)) or (name and p.name != str(name)):
                continue
            found = p.to_json()
            out.append({k: found[k] for k in ("name", "filename", "date", "bounds", "point_count", "finished", "time_slot")} if concise else found)
        return out

    def history_frame(self) -> DataFrame:
        """The processes as a table, one row each."""
        kinds = "name string, filename string, first timestamp, last timestamp, minx double, miny double, maxx double, maxy double, point_count long, finished boolean, time_slot int, start_timestamp double, end_timestamp double"
        rows = [(p.name, p.filename, *p.date, *map(float, (p.bounds or self.config.root).get()), p.point_count, p.finished, p.time_slot, p.start_timestamp, p.end_timestamp) for p in self.processes()]
        return self.spark.createDataFrame(rows, kinds)

    def runs_at(self, dates, bounds: Bounds | None = None, encompass: bool = False) -> DataFrame:
        """Runs whose dates overlap, or with encompass enclose, the given ones, and whose box meets bounds."""
        test = range_encloses if encompass else ranges_overlap
        rows = self.history_frame()
        rows = rows.filter(test(F.col("first"), F.col("last"), F.lit(dates[0]), F.lit(dates[1])))
        return rows.filter(boxes_meet(bounds, *[F.col(c) for c in ("minx", "miny", "maxx", "maxy")])) if bounds else rows

    # Cells

    def schema_ddl(self) -> str:
        c = self.config
        fixed = "X int, Y int, count long, start_time date, end_time date, written long"
        lists = [f"`{a.name}` array<double>" for a in c.attrs]
        values = [f"`{m.entry_name(a)}` {m.spark_type or 'array<double>'}" for m, a in outputs(c.metrics, c.attribute_names)]
        return ", ".join([fixed, *lists, *values])

    def _empty(self) -> DataFrame:
        return self.spark.createDataFrame([], self.schema_ddl()).withColumn("time_slot", F.lit(0))

    def _banded(self, rows: DataFrame, files: int) -> DataFrame:
        """Rows by runs of whole tiles, row by row of the grid, a run to a file, in order inside: a small box lies in
        few files, and skips row groups there. Where a tile goes follows from its place alone, so nothing is
        sampled; a tile has so many cells at most, so no file grows with the points."""
        c, rect = self.config, self.config.extents.rect
        across, down = -(-(rect.x2 - rect.x1) // c.xsize), -(-(rect.y2 - rect.y1) // c.ysize)
        files = max(1, min(files, across * down))
        x, y = F.floor(F.col("X") / c.xsize), F.floor(F.col("Y") / c.ysize)
        band = F.floor((y * across + x) * files / (across * down)).cast("int")
        return rows.repartitionById(files, F.greatest(F.lit(0), F.least(F.lit(files - 1), band))).sortWithinPartitions(y, x, "Y", "X")

    def write(self, cells: DataFrame, slot: int, dates, written: int, part: int = 0) -> None:
        """Cells with xi, yi and any of the store's columns, as a part of the partition of a time slot. Writing a
        part again replaces it and nothing else."""
        schema = self.spark.createDataFrame([], self.schema_ddl()).schema
        rows = cells.withColumnRenamed("xi", "X").withColumnRenamed("yi", "Y")
        rows = rows.withColumns({"start_time": F.lit(dates[0].date()), "end_time": F.lit(dates[1].date()), "written": F.lit(int(written))})
        rows = rows.select(*[(F.col(f"`{s.name}`") if s.name in rows.columns else F.lit(None)).cast(s.dataType).alias(s.name) for s in schema])
        files = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self._banded(rows, files).write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/cells/time_slot={slot}/part={part}")

    def all_rows(self, until: tuple[int | None, int | None] = (None, None)) -> DataFrame:
        """Every row of every run, with its time_slot; until: only those written between two epoch milliseconds."""
        rows = self._empty()
        if self.files.names(f"{self.path}/cells"):
            found = self.spark.read.option("basePath", f"{self.path}/cells").schema(self.schema_ddl() + ", time_slot int, part int")
            rows = found.parquet(f"{self.path}/cells").drop("part")
        for slot in self._set_aside():
            rows = rows.unionByName(self.spark.read.schema(self.schema_ddl() + ", part int").parquet(f"{self.path}/_old-{slot}").drop("part").withColumn("time_slot", F.lit(slot)))
        low, high = until
        rows = rows.filter(F.col("written") >= low) if low is not None else rows
        return rows.filter(F.col("written") <= high) if high is not None else rows

    def _rect(self, bounds: Bounds) -> Rect:
        return Extents.within(bounds, self.config.resolution, self.config.alignment, self.config.extents.root).rect

    def read(self, columns: Sequence[str] | None = None, bounds: Bounds | None = None, dates=None, until=(None, None)) -> DataFrame:
        """The newest row of each cell, in bounds and among the runs whose dates overlap."""
        rows = self.all_rows(until)
        if bounds:
            rows = relational.in_rect(rows, self._rect(bounds))
        if dates:
            rows = relational.during(rows, dates[0].strftime("%Y-%m-%d"), dates[1].strftime("%Y-%m-%d"))
        if columns is not None:
            rows = rows.select("X", "Y", "time_slot", *[f"`{c}`" for c in columns])
        return relational.latest(rows)

    def no_data(self) -> dict[str, object]:
        """What stands for null in files, by column."""
        return {m.entry_name(a): DTYPES[m.dtype][1] for m, a in outputs(self.config.metrics, self.config.attribute_names)} | {"count": 0}

    def drop_slot(self, slot: int) -> None:
        self.files.delete(f"{self.path}/cells/time_slot={slot}")

    def fragments(self) -> DataFrame:
        """One row per part of a run: time_slot, part, files, bytes, cells, the index ranges around them and when they
        were written. Of the cells only X, Y and the time are read."""
        if not self.files.names(f"{self.path}/cells"):
            kinds = "time_slot int, part int, files long, bytes long, cells long, x1 int, x2 int, y1 int, y2 int, written long"
            return self.spark.createDataFrame([], kinds)
        rows = self.spark.read.option("basePath", f"{self.path}/cells").schema(self.schema_ddl() + ", time_slot int, part int").parquet(f"{self.path}/cells")
        edges = [f(c).alias(k) for k, f, c in (("x1", F.min, "X"), ("x2", F.max, "X"), ("y1", F.min, "Y"), ("y2", F.max, "Y"), ("written", F.max, "written"))]
        one = rows.groupBy("time_slot", "part", F.col("_metadata.file_path").alias("_f")).agg(F.max("_metadata.file_size").alias("_b"), F.count(F.lit(1)).alias("_n"), *edges)
        again = [f(c).alias(c) for c, f in (("x1", F.min), ("x2", F.max), ("y1", F.min), ("y2", F.max), ("written", F.max))]
        return one.groupBy("time_slot", "part").agg(F.count(F.lit(1)).alias("files"), F.sum("_b").alias("bytes"), F.sum("_n").alias("cells"), *again)

    def consolidation_plan(self, file_bytes: int = FILE_BYTES) -> list[dict]:
        """The runs that more files, or more parts, hold than files of file_bytes would: what they have and the files
        that they would have. Runs, not cells, reach the driver."""
        if file_bytes < 1:
            raise ValueError("file_bytes is positive")
        found = self.fragments().groupBy("time_slot").agg(F.sort_array(F.collect_list("part")).alias("parts"), F.sum("files").alias("files"), F.sum("bytes").alias("bytes"))
        out = []
        for r in found.orderBy("time_slot").collect():
            wanted = -(-r["bytes"] // file_bytes)
            if r["files"] > wanted:
                out.append({"time_slot": r["time_slot"], "parts": r["parts"], "files": r["files"], "bytes": r["bytes"], "wanted": wanted})
        return out

    def consolidate_by_plan(self, file_bytes: int = FILE_BYTES) -> int:
        """Consolidate what the plan names; how many runs that were. A run is written anew whole, so no step makes
        another one stale."""
        plan = self.consolidation_plan(file_bytes)
        for step in plan:
            self.consolidate(step["time_slot"], step["wanted"])
        return len(plan)

    # Stages: a store that a run is written to before it is published

    def create_stage(self, path: str) -> Storage:
        """An empty store with the same settings at a path where there is none."""
        found = StorageConfig.from_string(json.dumps(self.config.to_json()))
        found.store = path
        return Storage.create(self.spark, found)

    def set_stage_state(self, state: str, **details) -> None:
        self.save_metadata("stage", json.dumps({"state": state, **details}, sort_keys=True))

    def stage_state(self) -> dict | None:
        found = self.get_metadata("stage")
        return json.loads(found) if found else None

    def _set_aside(self) -> list[int]:
        """Slots whose partition a consolidation that broke off has moved away and not yet put back."""
        aside = [int(n.removeprefix("_old-")) for n in self.files.names(self.path) if n.startswith("_old-")]
        return [n for n in aside if not self.files.exists(f"{self.path}/cells/time_slot={n}")]

    def consolidate(self, slot: int, files: int | None = None) -> None:
        """Write a partition anew in so many files, or in files of about FILE_BYTES. The old one is moved aside, the
        new one put in its place, and the old one deleted only then: whenever that breaks off, a whole one is left,
        which readers find and vacuum() puts back."""
        self.vacuum()
        old, new, aside = f"{self.path}/cells/time_slot={slot}", f"{self.path}/_compact-{slot}", f"{self.path}/_old-{slot}"
        files = files or -(-self.files.size(old) // FILE_BYTES)
        rows = self.spark.read.schema(self.schema_ddl() + ", part int").parquet(old).drop("part")
        self._banded(rows, files).write.mode("overwrite").option("compression", "zstd").parquet(f"{new}/part=0")
        self.files.rename(old, aside)
        self.files.rename(new, old)
        self.files.delete(aside)

    def vacuum(self) -> None:
        """Put back what broken-off consolidations have moved aside, and remove what else they left. Not while one
        is running."""
        for slot in self._set_aside():
            self.files.rename(f"{self.path}/_old-{slot}", f"{self.path}/cells/time_slot={slot}")
        for name in self.files.names(self.path):
            if name.startswith(("_compact-", "_old-")):
                self.files.delete(f"{self.path}/{name}")

    def publish(self, uri: str, slot: int) -> None:
        """The populated cells of a run as a table of their own, which must not exist yet."""
        rows = self.spark.read.parquet(f"{self.path}/cells/time_slot={slot}").drop("part").filter("count > 0")
        if rows.isEmpty():
            raise ValueError("there is nothing to publish")
        rows.withColumn("time_slot", F.lit(slot)).write.mode("errorifexists").parquet(uri)


class ShardGroup(Storage):
    """Published runs beside each other, one table to a shard, read as one store. A shard is published once and
    not changed; of a cell in several, the newest slot's row counts."""

    @classmethod
    def create(cls, spark: SparkSession, config: StorageConfig) -> ShardGroup:
        out = super().create(spark, config)
        out.save_metadata("group", "{}")
        return out

    @classmethod
    def at(cls, spark: SparkSession, path: str) -> ShardGroup | None:
        """The group at path, if there is one."""
        return cls.from_db(spark, path) if Files(spark).exists(f"{path.rstrip('/')}/group.json") else None

    def shards(self) -> list[str]:
        """Those that are published as a whole."""
        at = f"{self.path}/shards"
        return [n.removeprefix("shard=") for n in self.files.names(at) if n.startswith("shard=") and self.files.exists(f"{at}/{n}/_SUCCESS")]

    def publish_from(self, storage: Storage, slot: int, name: str, side: int | None = None, most: int | None = None) -> None:
        """A run of a store on the same grid as a shard. side: in blocks of so many cells a side, dealt to tasks
        whole, or in bands where a block has more than most points."""
        mine, theirs = self.config, storage.config
        if (mine.root, mine.resolution, mine.alignment) != (theirs.root, theirs.resolution, theirs.alignment):
            raise ValueError("a shard lies on the grid of its group")
        at = f"{self.path}/shards/shard={name}"
        if self.files.exists(at) and name not in self.shards():
            self.files.delete(at)  # of a job that broke off
        if side is None:
            return storage.publish(at, slot)
        rows = self.spark.read.parquet(f"{storage.path}/cells/time_slot={slot}").drop("part").filter("count > 0")
        if rows.isEmpty():
            raise ValueError("there is nothing to publish")
        rows, bands = tiling.with_blocks(rows.withColumn("time_slot", F.lit(slot)), side), F.lit(1)
        if most is not None:
            split = tiling.block_points(rows, side, F.col("count")).filter(F.col("points") > most)
            split = split.select("bx", "by", F.least(F.ceil(F.col("points") / most), F.lit(side)).cast("int").alias("_parts"))
            rows, bands = rows.join(split, ["bx", "by"], "left"), F.coalesce("_parts", F.lit(1))
        band = F.floor(F.pmod(F.col("Y"), F.lit(side)) * bands / side)
        rows = rows.repartition("bx", "by", band).sortWithinPartitions("bx", "by", "Y", "X").withColumn("block", tiling.block_name())
        rows.drop("bx", "by", "_parts").write.mode("errorifexists").partitionBy("block").parquet(at)

    def blocks(self, shard: str) -> list[str]:
        """The names of a shard's blocks, if it was published in blocks."""
        return [n.removeprefix("block=") for n in self.files.names(f"{self.path}/shards/shard={shard}") if n.startswith("block=")]

    def all_rows(self, until: tuple[int | None, int | None] = (None, None), shard: str | None = None) -> DataFrame:
        """Rows of all shards, or of one."""
        names = self.shards() if shard is None else [shard]
        if not names:
            raise ValueError(f"{self.path} has no shards yet")
        rows = None
        whole = [n for n in names if not self.blocks(n)]
        for found in ([whole] if whole else []) + [[n] for n in names if n not in whole]:
            some = self.spark.read.schema(self.schema_ddl() + ", time_slot int").parquet(*[f"{self.path}/shards/shard={n}" for n in found]).drop("block")
            rows = some if rows is None else rows.unionByName(some)
        low, high = until
        rows = rows.filter(F.col("written") >= low) if low is not None else rows
        return rows.filter(F.col("written") <= high) if high is not None else rows

    def read_shard(self, shard: str, columns: Sequence[str] | None = None, bounds: Bounds | None = None) -> DataFrame:
        """The cells of one shard, in bounds."""
        rows = self.all_rows(shard=shard)
        rows = relational.in_rect(rows, self._rect(bounds)) if bounds else rows
        return rows.select("X", "Y", "time_slot", *[f"`{c}`" for c in columns]) if columns is not None else rows

    def write(self, *_, **__) -> None:
        raise ValueError("the shards of a group are published, not written")


def union_of(stores: Sequence[Storage], **query) -> DataFrame:
    """The cells of several stores on one grid; of a cell in more than one, the newest."""
    out = None
    for s in stores:
        rows = s.read(**query)
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return relational.latest(out)
