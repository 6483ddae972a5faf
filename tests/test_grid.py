import itertools
import random

import pytest

from stratagrid.grid import Bounds, Extents, Rect, alignment_of


@pytest.mark.parametrize("text", ["[1,2,101,102]", "[1,2,3,101,102,103]", '{"minx": 1,"miny": 2,"maxx": 101,"maxy": 102}', "([1,101],[2,102])", "([1,101],[2,102],[3,103])"])
def test_text_forms(text):
    assert Bounds.from_string(text) == Bounds(1, 2, 101, 102)


@pytest.mark.parametrize("text", ["", "x", "[1,2,3]"])
def test_bad_text(text):
    with pytest.raises(ValueError):
        Bounds.from_string(text)


def test_alignment():
    box = Bounds(300, 300, 600, 600)
    assert box.aligned(30, "AlignToCorner") == Bounds(300, 300, 600, 600)
    assert box.aligned(30, "pixelispoint") == Bounds(285, 285, 615, 615)
    assert Extents.of_root(box, 30, "PixelIsArea").cell_count == 100
    assert Extents.of_root(box, 30, "AlignToCenter").cell_count == 121
    with pytest.raises(ValueError):
        alignment_of("middle")


def test_boxes():
    a = Bounds(0, 0, 10, 10)
    assert a.disjoint(Bounds(10, 0, 20, 10)) and not a.disjoint(Bounds(9, 9, 20, 20))
    assert a.shared(Bounds(5, -5, 20, 5)) == Bounds(5, 0, 10, 5) and a.shared(Bounds(10, 10, 11, 11)) is None
    assert sum((b.maxx - b.minx) * (b.maxy - b.miny) for b in a.bisect()) == 100
    assert Rect(0, 4, 0, 4).touches(Rect(4, 6, 0, 4)) and not Rect(0, 4, 0, 4).touches(Rect(5, 6, 0, 4))


@pytest.mark.parametrize("alignment", ["AlignToCorner", "AlignToCenter"])
@pytest.mark.parametrize("res", [30, 7])
def test_tiles_cover_without_overlap(alignment, res):
    whole = Extents.of_root(Bounds(300, 300, 600, 600), res, alignment)
    for parts in (whole.split(), whole.get_leaf_children(10), [c for s in whole.split() for c in s.split()]):
        seen = list(itertools.chain.from_iterable(p.get_indices() for p in parts))
        assert len(seen) == len(set(seen)) == whole.rect.cells and set(seen) == set(whole.get_indices())


def test_sub_box_has_the_roots_indices():
    whole = Extents.of_root(Bounds(300, 300, 600, 600), 30, "AlignToCorner")
    sub = Extents.within(Bounds(300, 300, 450, 450), 30, "AlignToCorner", whole.root)
    assert sub.rect == Rect(0, 5, 5, 10) and whole.box_of(sub.rect) == sub.bounds
    assert whole.get_overlap(sub).bounds == sub.bounds and not whole.disjoint(sub)


def test_random_points_fall_in_their_cell():
    r = random.Random(1)
    whole = Extents.of_root(Bounds(-50, 20, 333, 400), 7, "AlignToCenter")
    for _ in range(200):
        x, y = r.uniform(-50, 333), r.uniform(20, 400)
        import math

        xi, yi = math.floor((x - whole.root.minx) / 7), math.ceil((whole.root.maxy - y) / 7 - 1)
        box = whole.box_of(Rect(xi, xi + 1, yi, yi + 1))
        assert box.minx <= x <= box.maxx and box.miny <= y <= box.maxy
