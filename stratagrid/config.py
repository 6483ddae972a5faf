"""Settings of a store and of the jobs on it; all of them go to JSON and back."""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import asdict, dataclass, field
from datetime import datetime, timezone

from . import __version__
from .grid import Bounds, Extents, alignment_of
from .operators.metrics import DEFAULT_ATTRIBUTES, Attribute, Metric, attribute, get_grid_metrics, parse_metrics

DATE_FORMAT = "%Y-%m-%dT%H:%M:%SZ"


def _moment(value) -> datetime:
    if isinstance(value, datetime):
        return value
    return datetime.strptime(value, DATE_FORMAT) if "T" in value else datetime.strptime(value, "%Y-%m-%d")


def date_range(value) -> tuple[datetime, datetime]:
    """One moment stands for a range of its own."""
    found = tuple(map(_moment, [value] if isinstance(value, (str, datetime)) else value))
    if len(found) not in (1, 2):
        raise ValueError(f"a date range has 1 or 2 values, not {len(found)}")
    return found[0], found[-1]


@dataclass
class StorageConfig:
    store: str
    root: Bounds
    crs: str = ""
    resolution: float = 30.0
    alignment: str = "AlignToCenter"
    xsize: int = 1000
    ysize: int = 1000
    attrs: list[Attribute] = field(default_factory=lambda: [attribute(a) for a in DEFAULT_ATTRIBUTES])
    metrics: list[Metric] = field(default_factory=lambda: list(get_grid_metrics().values()))
    next_time_slot: int = 1
    version: str = __version__

    def __post_init__(self) -> None:
        self.root = Bounds.of(self.root)
        alignment_of(self.alignment)
        if self.resolution <= 0:
            raise ValueError("the resolution is positive")
        if "4326" in self.crs or self.crs.upper().startswith("GEOG"):
            raise ValueError("the coordinate system must be projected")
        rect = self.extents.rect
        # A tile is no larger than the grid with its spare row and column.
        self.xsize, self.ysize = min(int(self.xsize), rect.x2 - rect.x1 + 1), min(int(self.ysize), rect.y2 - rect.y1 + 1)
        names = {a.name for a in self.attrs}
        for m in self.metrics:
            for need in m.attributes:
                if need not in names:
                    raise ValueError(f"Missing required dependency, {need}, of {m.name}")

    @property
    def extents(self) -> Extents:
        return Extents.of_root(self.root, self.resolution, self.alignment)

    @property
    def attribute_names(self) -> list[str]:
        return [a.name for a in self.attrs]

    def derived_names(self, metrics: list[str] | None = None, attributes: list[str] | None = None) -> list[str]:
        """The columns of these metrics on these attributes, all by default."""
        from .plans.fused import outputs

        chosen = [a for a in self.attribute_names if attributes is None or a in attributes]
        return [m.entry_name(a) for m, a in outputs([m for m in self.metrics if metrics is None or m.name in metrics], chosen)]

    def get_metrics(self, names: list[str]) -> list[Metric]:
        known = {m.name: m for m in self.metrics}
        return [known[n] for n in names]

    def get_attributes(self, names: list[str]) -> list[Attribute]:
        known = {a.name: a for a in self.attrs}
        return [known[n] for n in names]

    def to_json(self) -> dict:
        out = {k: getattr(self, k) for k in ("store", "crs", "resolution", "alignment", "xsize", "ysize", "next_time_slot", "version")}
        return out | {"root": self.root.to_json(), "attrs": [a.to_json() for a in self.attrs], "metrics": [m.to_json() for m in self.metrics]}

    @classmethod
    def from_dict(cls, found: dict) -> StorageConfig:
        found = dict(found)
        return cls(attrs=[Attribute.from_dict(a) for a in found.pop("attrs")], metrics=[Metric.from_dict(m) for m in found.pop("metrics")], **found)

    @classmethod
    def from_string(cls, text: str) -> StorageConfig:
        return cls.from_dict(json.loads(text))


STRATEGIES = ("leaf-v1", "macro-v2", "macro-v3-stage-push")


@dataclass
class ShatterConfig:
    """One run that adds points to a store. The strategies name how an older program split its work; here they
    all run as one plan, and are checked and kept for the record."""

    store: str
    filename: str
    date: tuple[datetime, datetime]
    bounds: Bounds | None = None
    name: str = field(default_factory=lambda: str(uuid.uuid4()))
    tile_size: int | None = None
    processing_strategy: str = "leaf-v1"
    read_group_size: int | None = None
    processing_halo_m: float | None = None
    tile_point_count: int = 600_000
    publish_uri: str | None = None
    #: Where the run is written before it is published; the store then keeps its record only.
    stage_dir: str | None = None
    #: About the size of a stage's files, once consolidated.
    stage_file_mb: int = 300
    #: Of published shards: how many read groups to a block's side, and the points beyond which a block is split.
    shard_side_groups: int = 4
    shard_target_points: int | None = None
    lists: bool = True
    #: Bands of the grid that are written and recorded one after another, so that a resumed run skips finished ones.
    parts: int = 1
    mbr: list = field(default_factory=list)
    #: phase, part and seconds of what the run has written.
    timings: list = field(default_factory=list)
    start_timestamp: float | None = None
    end_timestamp: float | None = None
    point_count: int = 0
    finished: bool = False
    time_slot: int = 0
    version: str = __version__

    def __post_init__(self) -> None:
        self.date = date_range(self.date)
        self.bounds = Bounds.of(self.bounds) if self.bounds is not None else None
        self.tile_size = int(self.tile_size) if self.tile_size is not None else None
        self.read_group_size = int(self.read_group_size) if self.read_group_size is not None else None
        if self.parts < 1:
            raise ValueError("parts is positive")
        if self.processing_strategy not in STRATEGIES:
            raise ValueError(f"processing_strategy is one of {', '.join(STRATEGIES)}")
        if self.processing_halo_m is not None and self.processing_halo_m < 0:
            raise ValueError("processing_halo_m is not negative")
        if self.processing_strategy != STRATEGIES[0]:
            if not self.tile_size or not self.read_group_size or min(self.tile_size, self.read_group_size) < 1:
                raise ValueError("macro strategies need a positive tile_size and read_group_size")
            tile, group = math.isqrt(self.tile_size), math.isqrt(self.read_group_size)
            if tile * tile != self.tile_size or group * group != self.read_group_size:
                raise ValueError("tile_size and read_group_size are squares")
            if group < tile or group % tile:
                raise ValueError("the side of read_group_size is a multiple of that of tile_size")
        if self.processing_strategy == STRATEGIES[2] and (not self.publish_uri or self.publish_uri == self.store):
            raise ValueError(f"{STRATEGIES[2]} needs a publish_uri that is not the store")
        if self.stage_dir and (not self.publish_uri or self.stage_dir in (self.store, self.publish_uri)):
            raise ValueError("stage_dir needs a publish_uri and is neither that nor the store")
        if min(self.stage_file_mb, self.shard_side_groups, self.shard_target_points or 1) < 1 or self.shard_target_points == 0:
            raise ValueError("stage_file_mb, shard_side_groups and shard_target_points are positive")

    @property
    def shard_side(self) -> int | None:
        """Cells to the side of a published block; none where the strategy has no read groups."""
        return math.isqrt(self.read_group_size) * self.shard_side_groups if self.processing_strategy == STRATEGIES[2] else None

    def to_json(self) -> dict:
        out = asdict(self)
        return out | {"date": [d.strftime(DATE_FORMAT) for d in self.date], "bounds": self.bounds.to_json() if self.bounds else None}

    @classmethod
    def from_dict(cls, found: dict) -> ShatterConfig:
        return cls(**found)


@dataclass
class ExtractConfig:
    store: str
    out_dir: str
    attrs: list[str] | None = None
    metrics: list[str] | None = None
    bounds: Bounds | None = None
    date: tuple[datetime, datetime] | None = None
    #: "tif" or "asc".
    form: str = "tif"

    def __post_init__(self) -> None:
        self.bounds = Bounds.of(self.bounds) if self.bounds is not None else None
        # All that was ever stored, unless dates are given.
        self.date = date_range(self.date) if self.date else (datetime(1970, 1, 1), datetime.now(timezone.utc).replace(tzinfo=None))


def parse_attributes(text: str | None) -> list[Attribute]:
    return [attribute(a.strip()) for a in (text or ",".join(DEFAULT_ATTRIBUTES)).split(",")]


__all__ = ["StorageConfig", "ShatterConfig", "ExtractConfig", "date_range", "parse_attributes", "parse_metrics"]
