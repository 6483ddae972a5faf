"""Boxes in map units and rectangles of cell indices. Plain values, no Spark: the planner's arithmetic."""

from __future__ import annotations

import ast
import json
import math
from collections.abc import Iterator
from dataclasses import dataclass

CORNER, CENTER = "aligntocorner", "aligntocenter"
_NAMES = {"aligntocorner": CORNER, "pixelisarea": CORNER, "aligntocenter": CENTER, "pixelispoint": CENTER}


def alignment_of(name: str) -> str:
    try:
        return _NAMES[name.lower()]
    except KeyError:
        raise ValueError(f"unknown alignment {name!r}; known are {sorted(_NAMES)}") from None


@dataclass(frozen=True)
class Bounds:
    minx: float
    miny: float
    maxx: float
    maxy: float

    @classmethod
    def from_string(cls, text: str) -> Bounds:
        """Accepts [x0,y0,x1,y1], [x0,y0,z0,x1,y1,z1], an object with minx, miny, maxx and maxy, and
        ([x0,x1],[y0,y1]) with or without a third range. Heights are ignored."""
        text = text.strip()
        if text.startswith("("):
            x, y, *_ = ast.literal_eval(text)
            return cls(float(x[0]), float(y[0]), float(x[1]), float(y[1]))
        try:
            found = json.loads(text)
        except json.JSONDecodeError as e:
            raise ValueError(f"not a box: {text!r}") from e
        return cls.of(found)

    @classmethod
    def of(cls, found) -> Bounds:
        if isinstance(found, Bounds):
            return found
        if isinstance(found, str):
            return cls.from_string(found)
        if isinstance(found, dict):
            return cls(*(float(found[k]) for k in ("minx", "miny", "maxx", "maxy")))
        if len(found) not in (4, 6):
            raise ValueError("a box has 4 or 6 numbers")
        half = len(found) // 2
        return cls(*map(float, (found[0], found[1], found[half], found[half + 1])))

    def get(self) -> list[float]:
        return [self.minx, self.miny, self.maxx, self.maxy]

    to_json = get

    def to_string(self) -> str:
        return str(self.get())

    def bisect(self) -> list[Bounds]:
        """Four quarters: lower left, lower right, top left, top right."""
        x, y = (self.minx + self.maxx) / 2, (self.miny + self.maxy) / 2
        return [Bounds(a, b, c, d) for b, d in ((self.miny, y), (y, self.maxy)) for a, c in ((self.minx, x), (x, self.maxx))]

    def disjoint(self, other: Bounds) -> bool:
        """Boxes that only touch share no cell."""
        return other.minx >= self.maxx or other.maxx <= self.minx or other.miny >= self.maxy or other.maxy <= self.miny

    def shared(self, other: Bounds) -> Bounds | None:
        if self.disjoint(other):
            return None
        return Bounds(max(self.minx, other.minx), max(self.miny, other.miny), min(self.maxx, other.maxx), min(self.maxy, other.maxy))

    def aligned(self, resolution: float, alignment: str) -> Bounds:
        """The least box around this one whose edges lie on cell lines: multiples of the resolution, or half a
        cell off them where points mark cell centers."""
        shift = 0.0 if alignment_of(alignment) == CORNER else resolution / 2
        down = lambda v: math.floor((v - shift) / resolution) * resolution + shift
        up = lambda v: math.ceil((v - shift) / resolution) * resolution + shift
        return Bounds(down(self.minx), down(self.miny), up(self.maxx), up(self.maxy))


@dataclass(frozen=True)
class Rect:
    """Half-open ranges of cell indices; y counts from the north."""

    x1: int
    x2: int
    y1: int
    y2: int

    @property
    def cells(self) -> int:
        return max(0, self.x2 - self.x1) * max(0, self.y2 - self.y1)

    def touches(self, other: Rect) -> bool:
        """Whether the ranges meet, edges included."""
        return not (other.x1 > self.x2 or other.x2 < self.x1 or other.y1 > self.y2 or other.y2 < self.y1)

    def indices(self) -> Iterator[tuple[int, int]]:
        return ((x, y) for x in range(self.x1, self.x2) for y in range(self.y1, self.y2))


@dataclass(frozen=True)
class Extents:
    """A box of cells inside a root box, which gives the cells their indices."""

    bounds: Bounds
    resolution: float
    alignment: str
    root: Bounds

    @classmethod
    def within(cls, bounds: Bounds, resolution: float, alignment: str, root: Bounds) -> Extents:
        return cls(bounds.aligned(resolution, alignment), resolution, alignment, root)

    @classmethod
    def of_root(cls, root: Bounds, resolution: float, alignment: str) -> Extents:
        box = root.aligned(resolution, alignment)
        return cls(box, resolution, alignment, box)

    @property
    def rect(self) -> Rect:
        b, r, res = self.bounds, self.root, self.resolution
        return Rect(math.floor((b.minx - r.minx) / res), math.ceil((b.maxx - r.minx) / res), math.ceil((r.maxy - b.maxy) / res), math.ceil((r.maxy - b.miny) / res))

    @property
    def cell_count(self) -> int:
        b = self.bounds
        return int((b.maxx - b.minx) * (b.maxy - b.miny) / self.resolution**2)

    def box_of(self, rect: Rect) -> Bounds:
        r, res = self.root, self.resolution
        return Bounds(r.minx + rect.x1 * res, r.maxy - rect.y2 * res, r.minx + rect.x2 * res, r.maxy - rect.y1 * res)

    def _sub(self, rect: Rect) -> Extents:
        return Extents(self.box_of(rect), self.resolution, self.alignment, self.root)

    def get_indices(self) -> list[tuple[int, int]]:
        return list(self.rect.indices())

    def disjoint(self, other: Extents) -> bool:
        return self.bounds.disjoint(other.bounds)

    def disjoint_by_mbr(self, mbr) -> bool:
        (x1, x2), (y1, y2) = mbr
        return not self.rect.touches(Rect(x1, x2, y1, y2))

    def split(self) -> list[Extents]:
        """Four parts along cell lines, as near to halves as they allow."""
        r = self.rect
        x, y = r.x1 + (r.x2 - r.x1) // 2, r.y1 - (r.y1 - r.y2) // 2
        return [self._sub(Rect(a, b, c, d)) for c, d in ((y, r.y2), (r.y1, y)) for a, b in ((r.x1, x), (x, r.x2))]

    def get_leaf_children(self, tile_size: int) -> list[Extents]:
        """Square tiles of at most so many cells, cut off at the edges."""
        side, r = max(1, math.isqrt(int(tile_size))), self.rect
        return [self._sub(Rect(x, min(x + side, r.x2), y, min(y + side, r.y2))) for x in range(r.x1, r.x2, side) for y in range(r.y1, r.y2, side)]

    def get_overlap(self, other: Extents) -> Extents | None:
        box = self.bounds.shared(other.bounds)
        return Extents.within(box, self.resolution, self.alignment, self.root) if box else None
