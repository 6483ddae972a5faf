"""Files of one value per cell: GeoTIFF or ESRI ASCII grids with a JSON header beside each. North is up."""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .grid import Bounds, Extents, Rect
from .operators.relational import in_rect
from .sources.las import opened

#: Cells of a block. A larger raster becomes several files, each written by the task that has its cells.
BLOCK_CELLS = 1 << 16
FORMS = ("tif", "asc")
#: Types of bands by those of metrics, for files that lack small signed and long ones.
KINDS = {"float32": "Float32", "float64": "Float64", "int8": "Int16", "int16": "Int16", "int32": "Int32", "int64": "Float64", "uint8": "Byte", "uint16": "UInt16", "uint32": "UInt32"}


def _steps(rect: Rect) -> tuple[int, int, int]:
    """Of blocks: how wide, how high, and how many beside each other."""
    wide = max(1, min(rect.x2 - rect.x1, BLOCK_CELLS))
    return wide, max(1, BLOCK_CELLS // wide), -(-(rect.x2 - rect.x1) // wide)


def blocks(rect: Rect) -> Iterator[Rect]:
    """rect in runs of whole rows from the north, or of pieces of rows where one is too long."""
    wide, high, _ = _steps(rect)
    for y in range(rect.y1, rect.y2, high):
        for x in range(rect.x1, rect.x2, wide):
            yield Rect(x, min(x + wide, rect.x2), y, min(y + high, rect.y2))


def filled(found: pd.DataFrame, name: str, rect: Rect, empty: float) -> np.ndarray:
    """A column's values over all of rect, rows from the north; cells without data have empty."""
    array = np.full((rect.y2 - rect.y1, rect.x2 - rect.x1), empty, dtype=np.float64)
    values = found[name].to_numpy(dtype=np.float64, na_value=np.nan)
    array[found["Y"].to_numpy(dtype=np.int64) - rect.y1, found["X"].to_numpy(dtype=np.int64) - rect.x1] = np.where(np.isnan(values), empty, values)
    return array


def save(uri: str, data: bytes) -> None:
    """Written under another name first, so that a task which is lost or tried again leaves no part of a file."""
    system, path = opened(uri)
    made = f"{path}.{uuid.uuid4().hex}"
    with system.open_output_stream(made) as out:
        out.write(data)
    system.move(made, path)


def write(cells: DataFrame, names: Sequence[str], dtypes: Mapping[str, str], nodata: Mapping[str, object], extents: Extents, crs: str, out_dir: str, form: str = "tif") -> list[str]:
    """A file for each name and block of extents, by the tasks that have the blocks' cells; the paths. Cells are
    dealt by block, and a row without a place stands for each block, so that blocks without cells are written too."""
    if form not in FORMS:
        raise ValueError(f"{form} is none of {', '.join(FORMS)}")
    spark, rect, names = cells.sparkSession, extents.rect, list(names)
    parts, (wide, high, across) = list(blocks(rect)), _steps(rect)
    spread = F.floor((F.col("Y") - rect.y1) / high) * across + F.floor((F.col("X") - rect.x1) / wide)
    rows = in_rect(cells.select("X", "Y", *[F.col(f"`{n}`") for n in names]), rect).withColumn("__block", spread.cast("long"))
    frames = spark.range(len(parts)).select(*[F.lit(None).cast(t.dataType).alias(t.name) for t in rows.schema[:-1]], F.col("id").alias("__block"))
    resolution, corner, several, dtypes = extents.resolution, extents.root, len(parts) > 1, {n: KINDS.get(dtypes[n], "Float64").lower() for n in names}

    def run(found: pd.DataFrame) -> pd.DataFrame:
        k = int(found["__block"].iloc[0])
        y, x = rect.y1 + k // across * high, rect.x1 + k % across * wide
        part = Rect(x, min(x + wide, rect.x2), y, min(y + high, rect.y2))
        box = Bounds(corner.minx + part.x1 * resolution, corner.maxy - part.y2 * resolution, corner.minx + part.x2 * resolution, corner.maxy - part.y1 * resolution)
        found = found[found["X"].notna()]
        for name in names:
            empty = np.nan if nodata[name] is None else nodata[name]
            array = filled(found, name, part, empty)
            at = f"{out_dir}/{name}" + (f"_{k}" if several else "")
            about = header(box, part, resolution, nodata[name], crs, name)
            kind = {"byte": "uint8"}.get(dtypes[name], dtypes[name])
            save(f"{at}.{form}", tiff(array.astype(kind), box, resolution, nodata[name], crs) if form == "tif" else ascii_grid(array, box, about))
            save(f"{at}.json", json.dumps(about).encode())
        return pd.DataFrame({"block": [k]})

    opened(out_dir)[0].create_dir(opened(out_dir)[1], recursive=True)
    done = rows.unionByName(frames).groupBy("__block").applyInPandas(run, "block long").count()
    assert done == len(parts)
    return [f"{out_dir}/{n}" + (f"_{k}" if several else "") + f".{form}" for k in range(len(parts)) for n in names]


def tiff(array: np.ndarray, box: Bounds, resolution: float, nodata, crs: str) -> bytes:
    """One band in one deflated strip, with its place and coordinate system as GeoTIFF tags."""
    height, width = array.shape
    data = zlib.compress(np.ascontiguousarray(array, dtype=array.dtype.newbyteorder("<")).tobytes(), 6)
    keys = [(1024, 0, 1, 1), (1025, 0, 1, 1)]  # projected; pixels are areas
    if crs.upper().startswith("EPSG:") and crs[5:].isdigit():
        keys.append((3072, 0, 1, int(crs[5:])))
    geo = [1, 1, 0, len(keys), *[v for k in keys for v in k]]
    short, long, double = ((lambda *v, t=t: (f"<{len(v)}{t}", v)) for t in "HId")
    tags = {
        256: short(width) if width < 1 << 16 else long(width), 257: short(height) if height < 1 << 16 else long(height), 258: short(array.dtype.itemsize * 8), 259: short(8), 262: short(1),
        273: long(0), 277: short(1), 278: long(height), 279: long(len(data)), 339: short({"u": 1, "i": 2, "f": 3}[array.dtype.kind]),
        33550: double(resolution, resolution, 0.0), 33922: double(0.0, 0.0, 0.0, box.minx, box.maxy, 0.0), 34735: short(*geo),
    }
    if nodata is not None:
        text = f"{nodata}\0".encode()
        tags[42113] = (f"<{len(text)}s", (text,))
    after = 8 + 2 + 12 * len(tags) + 4
    more = sum(n + n % 2 for f, _ in tags.values() if (n := struct.calcsize(f)) > 4)
    tags[273] = long(after + more)
    entries, extra = b"", b""
    for tag, (form, values) in sorted(tags.items()):
        packed = struct.pack(form, *values)
        kind = {"H": 3, "I": 4, "d": 12, "s": 2}[form[-1]]
        count = len(packed) if kind == 2 else len(values)
        entries += struct.pack("<HHI", tag, kind, count)
        if len(packed) <= 4:
            entries += packed.ljust(4, b"\0")
        else:
            entries += struct.pack("<I", after + len(extra))
            extra += packed + b"\0" * (len(packed) % 2)
    return struct.pack("<2sHIH", b"II", 42, 8, len(tags)) + entries + struct.pack("<I", 0) + extra + data


def ascii_grid(array: np.ndarray, box: Bounds, about: dict) -> bytes:
    import io

    text = io.StringIO()
    text.write(f"ncols {array.shape[1]}\nnrows {array.shape[0]}\nxllcorner {box.minx}\nyllcorner {box.miny}\ncellsize {about['geotransform'][1]}\nNODATA_value {about['nodata']}\n")
    np.savetxt(text, array, fmt="%.9g")
    return text.getvalue().encode()


def header(box: Bounds, rect: Rect, resolution: float, nodata, crs: str, name: str) -> dict:
    return {"name": name, "crs": crs, "nodata": nodata, "width": rect.x2 - rect.x1, "height": rect.y2 - rect.y1, "geotransform": [box.minx, resolution, 0.0, box.maxy, 0.0, -resolution]}


def gdal_metadata(names: Sequence[str], dtypes: Mapping[str, str], rect: Rect, box: Bounds, resolution: float, crs: str, nodata: Mapping[str, object]) -> str:
    """A sidecar that describes the bands by place, in the XML that raster tools read."""
    import xml.etree.ElementTree as ET

    top = ET.Element("PAMDataset", rasterXSize=str(rect.x2 - rect.x1), rasterYSize=str(rect.y2 - rect.y1))
    if crs:
        ET.SubElement(top, "SRS").text = crs
    ET.SubElement(top, "GeoTransform").text = ", ".join(str(v) for v in (box.minx, resolution, 0.0, box.maxy, 0.0, -resolution))
    for k, name in enumerate(names, 1):
        band = ET.SubElement(top, "PAMRasterBand", band=str(k), dataType=KINDS.get(dtypes[name], "Float64"))
        ET.SubElement(band, "Description").text = name
        if nodata[name] is not None:
            ET.SubElement(band, "NoDataValue").text = str(nodata[name])
    return ET.tostring(top, encoding="unicode")
