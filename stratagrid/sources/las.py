"""LAS point files as a Spark source, from the public description of the format: versions 1.0 to 1.4, point formats
0 to 10, uncompressed. Files are cut into runs of points, so a large one is read by many tasks; files whose header
lies outside the box asked for are not read. Compressed points (LAZ, COPC) are refused, since no decoder is at hand.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..grid import Bounds

#: Points of a task, and of a batch inside it.
RUN, BATCH = 4_000_000, 65_536
SCHEMA = "X double, Y double, Z double, Intensity int, ReturnNumber int, NumberOfReturns int, Classification int, ScanAngle float, UserData int, PointSourceId int, GpsTime double"
#: Bytes that each point format takes at least, as the format fixes them.
LENGTHS = (20, 28, 26, 34, 57, 63, 30, 36, 38, 59, 67)


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of an address, and the path in it."""
    if "://" in uri:
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), uri.removeprefix("file:")


@dataclass(frozen=True)
class Header:
    uri: str
    start: int
    form: int
    length: int
    points: int
    scale: tuple[float, ...]
    shift: tuple[float, ...]
    box: Bounds


def header(uri: str) -> Header:
    """What reading needs of a file's first bytes."""
    system, path = opened(uri)
    with system.open_input_file(path) as f:
        data = f.read(375)
    if len(data) < 227 or data[:4] != b"LASF":
        raise ValueError(f"{uri} is no LAS file")
    start, = struct.unpack_from("<I", data, 96)
    form, length, points = struct.unpack_from("<BHI", data, 104)
    if form & 0x80 or form & 0x3F >= len(LENGTHS):
        raise ValueError(f"{uri} has compressed points or an unknown point format, {form}")
    if length < LENGTHS[form]:
        raise ValueError(f"{uri}: points of format {form} don't fit in {length} bytes")
    if data[24:26] >= b"\x01\x04" and len(data) >= 255:
        points = struct.unpack_from("<Q", data, 247)[0] or points
    numbers = struct.unpack_from("<12d", data, 131)
    box = Bounds(numbers[7], numbers[9], numbers[6], numbers[8])
    return Header(uri, start, form, length, points, numbers[:3], numbers[3:6], box)


def _meets(found: Header, box: Bounds | None) -> bool:
    """Points on the edges of a header's box are inside it."""
    b = found.box
    return box is None or not (b.minx >= box.maxx or b.maxx < box.minx or b.miny >= box.maxy or b.maxy < box.miny)


def files_of(location: str) -> list[str]:
    """The .las files of a folder, or the file itself; several addresses are set apart by line ends."""
    out = []
    for uri in location.split("\n"):
        system, path = opened(uri)
        if system.get_file_info(path).type == fs.FileType.Directory:
            found = system.get_file_info(fs.FileSelector(path, recursive=True))
            head = uri[: len(uri) - len(path)] if uri.endswith(path) else ""
            out += sorted(head + i.path for i in found if i.path.lower().endswith(".las"))
        else:
            out.append(uri)
    return out


def headers(location: str, box: Bounds | None = None) -> list[Header]:
    """Headers of the files that meet the box: a few hundred bytes of each file, read by a few threads."""
    with ThreadPoolExecutor(16) as pool:
        return [h for h in pool.map(header, files_of(location)) if _meets(h, box)]


def extent(location: str) -> Bounds:
    boxes = [h.box for h in headers(location) if h.points]
    return Bounds(min(b.minx for b in boxes), min(b.miny for b in boxes), max(b.maxx for b in boxes), max(b.maxy for b in boxes))


def point_type(form: int, length: int) -> np.dtype:
    fields = {"x": ("<i4", 0), "y": ("<i4", 4), "z": ("<i4", 8), "intensity": ("<u2", 12), "returns": ("u1", 14)}
    if form < 6:
        fields |= {"class": ("u1", 15), "angle": ("i1", 16), "user": ("u1", 17), "source": ("<u2", 18)}
        fields |= {"time": ("<f8", 20)} if form in (1, 3, 4, 5) else {}
    else:
        fields |= {"class": ("u1", 16), "user": ("u1", 17), "angle": ("<i2", 18), "source": ("<u2", 20), "time": ("<f8", 22)}
    return np.dtype({"names": list(fields), "formats": [f for f, _ in fields.values()], "offsets": [o for _, o in fields.values()], "itemsize": length})


def columns(rows: np.ndarray, h: Header) -> list[pa.Array]:
    old = h.form < 6
    bits = 3 if old else 4
    returns = rows["returns"].astype(np.int32)
    values = [rows[k] * h.scale[i] + h.shift[i] for i, k in enumerate("xyz")]
    values += [rows["intensity"], returns & ((1 << bits) - 1), (returns >> bits) & ((1 << bits) - 1), rows["class"] & 31 if old else rows["class"]]
    values += [rows["angle"] * (1.0 if old else 0.006), rows["user"], rows["source"]]
    kinds = [np.float64] * 3 + [np.int32] * 4 + [np.float32] + [np.int32] * 2
    out = [pa.array(np.ascontiguousarray(v, dtype=k)) for v, k in zip(values, kinds)]
    return [*out, pa.array(np.ascontiguousarray(rows["time"])) if "time" in rows.dtype.names else pa.nulls(len(rows), pa.float64())]


@dataclass
class Run(InputPartition):
    header: Header
    first: int
    last: int


class LasReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.location = options["path"]
        self.box = Bounds.from_string(options["box"]) if options.get("box") else None

    def partitions(self) -> list[Run]:
        found = [Run(h, k, min(k + RUN, h.points)) for h in headers(self.location, self.box) for k in range(0, h.points, RUN)]
        return found or [Run(None, 0, 0)]

    def read(self, run: Run) -> Iterator[pa.RecordBatch]:
        h = run.header
        if h is None:
            return
        kind, names = point_type(h.form, h.length), [c.split()[0] for c in SCHEMA.split(", ")]
        system, path = opened(h.uri)
        with system.open_input_file(path) as f:
            f.seek(h.start + run.first * h.length)
            for k in range(run.first, run.last, BATCH):
                n = min(BATCH, run.last - k)
                data = f.read(n * h.length)
                if len(data) < n * h.length:
                    raise ValueError(f"{h.uri} ends before its {h.points} points")
                rows = np.frombuffer(data, dtype=kind)
                yield pa.RecordBatch.from_arrays(columns(rows, h), names=names)


class LasSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "las"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> LasReader:
        return LasReader(dict(self.options))
