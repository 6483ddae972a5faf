import json
import socket
import struct
import threading
import zlib
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratagrid import cli, jobs, raster
from stratagrid.config import ExtractConfig, ShatterConfig, StorageConfig
from stratagrid.grid import Bounds, Rect
from stratagrid.operators import relational
from stratagrid.operators.metrics import Metric, attribute, product_moments, statistics
from stratagrid.sources.points import PointSource
from stratagrid.sources import las
from stratagrid.sources.session import WebSocketHandler, logger, memory_peaks, random_name
from stratagrid.sources.store import ShardGroup, Storage, union_of

BOX = Bounds(300, 300, 600, 600)
METRICS = [product_moments["mean"], statistics["max"]]


def area(spark, alignment):
    """Points one unit apart; the height is the row of 30 units."""
    low, high, shift = (300, 600, 0) if alignment == "AlignToCorner" else (285, 615, 15)
    axis = spark.range(low, high)
    xy = axis.select(F.col("id").cast("double").alias("X")).crossJoin(axis.select(F.col("id").cast("double").alias("Y")))
    z = F.floor((F.col("Y") + shift) / 30).cast("double")
    return xy.withColumns({"Z": z, "NumberOfReturns": z, "ReturnNumber": z, "Intensity": z})


@pytest.fixture(params=["AlignToCorner", "AlignToCenter"])
def setting(request, spark, tmp_path):
    path = f"file://{tmp_path}/store"
    config = StorageConfig(path, BOX, "EPSG:5070", 30, request.param, 5, 5, metrics=METRICS)
    return request.param, jobs.initialize(spark, config), area(spark, request.param), tmp_path


def run(store, **more):
    return ShatterConfig(store, "points", datetime(2011, 1, 1), **more)


def test_values_and_counts(spark, setting):
    alignment, storage, points, _ = setting
    n = jobs.shatter(spark, run(storage.path), points)
    assert n == (90_000 if alignment == "AlignToCorner" else 108_900)
    root = storage.config.extents.root
    for r in storage.read().collect():
        want = np.ceil(root.maxy / 30) - r.Y - 1
        assert r.m_Z_mean == want and set(r.Z) == {want} and r["count"] == 900 and len(r.Intensity) == 900


def test_sub_boxes_sum_up(spark, setting):
    alignment, storage, points, _ = setting
    total = sum(jobs.shatter(spark, run(storage.path, bounds=b, lists=False), points) for b in [Bounds(300, 300, 450, 450)])
    assert total == (22_500 if alignment == "AlignToCorner" else 32_400)
    assert jobs.shatter(spark, run(storage.path, bounds=Bounds(900, 900, 990, 990)), points) == 0


def test_later_runs_win_and_time_travel(spark, setting):
    _, storage, points, _ = setting
    jobs.shatter(spark, run(storage.path, name="one", lists=False), points)
    t = storage.process("one").start_timestamp
    half = points.filter("X < 450").withColumn("Z", F.col("Z") + 100)
    jobs.shatter(spark, ShatterConfig(storage.path, "p", [datetime(2012, 1, 1), datetime(2012, 6, 1)], name="two", lists=False), half)
    high = storage.read(["m_Z_mean"]).filter("m_Z_mean > 100").count()
    assert 0 < high < storage.read().count()
    assert storage.read(until=(None, int(t))).filter("m_Z_mean > 100").count() == 0
    assert storage.read(dates=(datetime(2012, 3, 1), datetime(2013, 1, 1))).filter("m_Z_mean < 100").count() == 0
    jobs.consolidate(spark, storage.path)
    assert storage.read(["m_Z_mean"]).filter("m_Z_mean > 100").count() == high
    gone = jobs.delete(spark, storage.path, "two")
    assert not gone.finished and storage.read(["m_Z_mean"]).filter("m_Z_mean > 100").count() == 0
    assert jobs.restart(spark, storage.path, "two", half) > 0 and storage.read(["m_Z_mean"]).filter("m_Z_mean > 100").count() == high
    with pytest.raises(KeyError):
        jobs.delete(spark, storage.path, "none")
    assert [p["name"] for p in jobs.info(spark, storage.path, dates=(datetime(2012, 2, 1), datetime(2012, 2, 2)))["history"]] == ["two"]
    assert [p["name"] for p in jobs.info(spark, storage.path, name="one", concise=True)["history"]] == ["one"]
    assert jobs.info(spark, storage.path, bounds=Bounds(0, 0, 10, 10))["history"] == []
    spring = (datetime(2012, 2, 1), datetime(2012, 12, 1))
    assert [r.name for r in storage.runs_at(spring, Bounds(300, 300, 330, 330)).collect()] == ["two"]
    assert storage.runs_at(spring, encompass=True).count() == 0 and storage.runs_at(spring, Bounds(0, 0, 10, 10)).count() == 0
    assert jobs.as_of(spark, storage.path, None, datetime.fromtimestamp(t / 1000)).filter("m_Z_mean > 100").count() == 0


def test_resume_skips_finished_cells(spark, setting):
    alignment, storage, points, _ = setting
    config = run(storage.path, name="r", mbr=[[[0, 4], [0, 4]]], lists=False, time_slot=storage.reserve_time_slot())
    storage.save_process(config)
    n = jobs.resume(spark, storage.path, "r", points)
    assert n == (90_000 if alignment == "AlignToCorner" else 108_900) - 25 * 900
    assert jobs.resume(spark, storage.path, "r", points) == n


def test_resume_after_a_crash(spark, setting, monkeypatch):
    """Broken off after a part was written, and after one was written but not recorded: nothing counts twice."""
    alignment, storage, points, _ = setting
    total, calls = 90_000 if alignment == "AlignToCorner" else 108_900, []
    whole = Storage.write

    def write(self, cells, slot, dates, written, part=0):
        calls.append(part)
        if len(calls) == 2:
            raise OSError("before")
        whole(self, cells, slot, dates, written, part)
        if len(calls) == 4:
            raise OSError("after")

    monkeypatch.setattr(Storage, "write", write)
    with pytest.raises(OSError, match="before"):
        jobs.shatter(spark, run(storage.path, name="r", lists=False, parts=3), points)
    with pytest.raises(OSError, match="after"):
        jobs.resume(spark, storage.path, "r", points)
    assert calls == [0, 1, 1, 2] and not storage.process("r").finished
    assert jobs.resume(spark, storage.path, "r", points) == total and calls == [0, 1, 1, 2, 2]
    assert storage.read(["count"]).agg(F.sum("count")).first()[0] == total and storage.process("r").finished


@pytest.mark.parametrize("step", [1, 2])
def test_consolidation_that_breaks_off(spark, setting, monkeypatch, step):
    from stratagrid.sources.store import Files

    _, storage, points, _ = setting
    jobs.shatter(spark, run(storage.path, lists=False, parts=2), points)
    before, calls, whole = storage.read(["count"]).count(), [], Files.rename

    def rename(self, path, to):
        calls.append(path)
        if len(calls) == step:
            raise OSError("broken off")
        whole(self, path, to)

    with monkeypatch.context() as m:
        m.setattr(Files, "rename", rename)
        with pytest.raises(OSError):
            jobs.consolidate(spark, storage.path)
    assert storage.read(["count"]).count() == before
    storage.vacuum()
    assert storage.read(["count"]).count() == before and not [n for n in storage.files.names(storage.path) if n.startswith("_")]
    jobs.consolidate(spark, storage.path)
    assert storage.read(["count"]).count() == before


def test_a_box_lies_in_few_files(spark, setting):
    _, storage, points, _ = setting
    jobs.shatter(spark, run(storage.path, lists=False), points)
    rows = spark.read.parquet(f"{storage.path}/cells").withColumn("file", F.input_file_name())
    spans = rows.groupBy("file").agg(F.min("Y").alias("a"), F.max("Y").alias("b")).collect()
    assert len(spans) > 1 and all(r.b - r.a < 6 for r in spans)


def test_extract(spark, setting):
    alignment, storage, points, tmp = setting
    jobs.shatter(spark, run(storage.path, lists=False), points.filter("X >= 330 or Y >= 330"))
    files = jobs.extract(spark, ExtractConfig(storage.path, f"file://{tmp}/out", ["Z"], ["mean"], form="asc"))
    assert [f.rpartition("/")[2] for f in files] == ["m_Z_mean.asc"]
    grid = np.loadtxt(f"{tmp}/out/m_Z_mean.asc", skiprows=6)
    about = json.loads((tmp / "out/m_Z_mean.json").read_text())
    root = storage.config.extents.root
    assert grid.shape == (about["height"], about["width"]) and about["geotransform"] == [root.minx, 30, 0, root.maxy, 0, -30]
    assert (grid[:, -1] == [np.ceil(root.maxy / 30) - y - 1 for y in range(len(grid))]).all()
    assert grid[-1, 0] == -9999 and grid[-2, 0] != -9999
    assert "m_Z_mean" in (tmp / "out/bands.aux.xml").read_text()
    part = jobs.extract(spark, ExtractConfig(storage.path, f"file://{tmp}/part", ["Z"], ["max"], Bounds(450, 450, 600, 600), form="asc"))
    assert len(part) == 1 and np.loadtxt(f"{tmp}/part/m_Z_max.asc", skiprows=6).shape[0] in (5, 6)


def bands_of(data):
    """Width, height, values and tags of a TIFF of one deflated strip."""
    assert data[:4] == b"II*\0"
    at, = struct.unpack_from("<I", data, 4)
    tags = {}
    for k in range(struct.unpack_from("<H", data, at)[0]):
        tag, kind, n = struct.unpack_from("<HHI", data, at + 2 + 12 * k)
        form = f"<{n}{ {2: 's', 3: 'H', 4: 'I', 12: 'd'}[kind] }"
        here = at + 10 + 12 * k if struct.calcsize(form) <= 4 else struct.unpack_from("<I", data, at + 10 + 12 * k)[0]
        tags[tag] = struct.unpack_from(form, data, here)
    kind = f"<{'uif'[tags[339][0] - 1]}{tags[258][0] // 8}"
    raw = zlib.decompress(data[tags[273][0] : tags[273][0] + tags[279][0]])
    return np.frombuffer(raw, kind).reshape(tags[257][0], tags[256][0]), tags


def test_geotiff_blocks(spark, setting, monkeypatch):
    alignment, storage, points, tmp = setting
    jobs.shatter(spark, run(storage.path, lists=False), points.filter("X >= 330 or Y >= 330"))
    whole, = jobs.extract(spark, ExtractConfig(storage.path, f"file://{tmp}/tif", ["Z"], ["mean"]))
    values, tags = bands_of(open(whole.removeprefix("file://"), "rb").read())
    root, side = storage.config.extents.root, 10 if alignment == "AlignToCorner" else 11
    assert values.shape == (side, side) and values.dtype == np.float32 and tags[33922][3:5] == (root.minx, root.maxy) and tags[33550][0] == 30
    assert tags[34735][-1] == 5070 and tags[42113] == (b"-9999.0\0",) and values[-1, 0] == -9999
    jobs.extract(spark, ExtractConfig(storage.path, f"file://{tmp}/asc", ["Z"], ["mean"], form="asc"))
    assert np.array_equal(np.loadtxt(f"{tmp}/asc/m_Z_mean.asc", skiprows=6), values)
    for cells in (25, 4):  # runs of rows; pieces of rows
        monkeypatch.setattr(raster, "BLOCK_CELLS", cells)
        files = jobs.extract(spark, ExtractConfig(storage.path, f"file://{tmp}/b{cells}", ["Z"], ["mean"]))
        rect, got = storage.config.extents.rect, np.full_like(values, -1)
        for k, part in enumerate(raster.blocks(rect)):
            assert files[k].endswith(f"m_Z_mean_{k}.tif") and part.cells <= cells
            got[part.y1 : part.y2, part.x1 : part.x2], found = bands_of(open(files[k].removeprefix("file://"), "rb").read())
            assert found[33922][3:5] == (root.minx + 30 * part.x1, root.maxy - 30 * part.y1)
        assert np.array_equal(got, values)


def test_shard_group(spark, setting):
    _, storage, points, tmp = setting
    c = storage.config
    config = StorageConfig(f"file://{tmp}/group", c.root, c.crs, c.resolution, c.alignment, attrs=c.attrs, metrics=c.metrics)
    group = ShardGroup.create(spark, config)
    with pytest.raises(ValueError):
        group.read().count()
    for name, part in (("west", "X < 450"), ("east", "X >= 450")):
        jobs.shatter(spark, run(storage.path, name=name, lists=False, publish_uri=group.path), points.filter(part))
    found = Storage.from_db(spark, group.path)
    assert found.shards() == ["east", "west"] and sum(found.all_rows(shard=s).agg(F.sum("count")).first()[0] for s in found.shards()) == points.count()
    assert found.read(["m_Z_mean"]).orderBy("X", "Y").collect() == storage.read(["m_Z_mean"]).orderBy("X", "Y").collect()
    assert len(jobs.extract(spark, ExtractConfig(group.path, f"file://{tmp}/group-out", ["Z"], ["mean"]))) == 1
    with pytest.raises(ValueError):
        found.write(found.read(), 9, (datetime(2011, 1, 1),) * 2, 0)
    with pytest.raises(ValueError):
        found.publish_from(jobs.initialize(spark, StorageConfig(f"file://{tmp}/other", BOX, "", 10, metrics=METRICS)), 1, "x")
    times = {(r.name, r.phase): r for r in jobs.timings(spark, storage.path).collect()}
    assert set(times) == {(n, p) for n in ("west", "east") for p in ("cells", "publish")} and all(r.seconds >= r.longest > 0 for r in times.values())


def test_stage_and_blocks(spark, setting, monkeypatch):
    """A run goes to a stage, is consolidated there and published in blocks; broken off, it goes on from the stage."""
    _, storage, points, tmp = setting
    c = storage.config
    group = ShardGroup.create(spark, StorageConfig(f"file://{tmp}/group", c.root, c.crs, c.resolution, c.alignment, attrs=c.attrs, metrics=c.metrics))
    config = run(storage.path, name="a", lists=False, parts=3, processing_strategy="macro-v3-stage-push", tile_size=1, read_group_size=4, shard_side_groups=2, shard_target_points=5000, stage_dir=f"file://{tmp}/stages", publish_uri=group.path)
    whole = ShardGroup.publish_from

    def fails(self, home, *more):
        whole(self, home, *more)
        storage.files.delete(f"{group.path}/shards/shard=a/_SUCCESS")
        raise OSError("broken off")

    monkeypatch.setattr(ShardGroup, "publish_from", fails)
    with pytest.raises(OSError, match="broken off"):
        jobs.shatter(spark, config, points)
    stage = Storage.from_db(spark, f"file://{tmp}/stages/a")
    assert stage.stage_state()["state"] == "consolidated" and group.shards() == []
    monkeypatch.setattr(ShardGroup, "publish_from", whole)
    monkeypatch.setattr(Storage, "write", None)  # nothing is written again
    n = jobs.resume(spark, storage.path, "a", points)
    assert n == points.count() and stage.stage_state() == {"state": "published", "points": n, "uri": group.path}
    assert storage.all_rows().count() == 0 and storage.process("a").finished
    assert group.shards() == ["a"] and "x0y0" in group.blocks("a")
    assert group.read().agg(F.sum("count")).first()[0] == n
    assert spark.read.parquet(f"{group.path}/shards/shard=a").filter("block = 'x1y1'").count() == 16
    box = Bounds(330, 330, 390, 360)
    assert 0 < group.read_shard("a", ["m_Z_mean"], box).count() < 12
    with pytest.raises(FileExistsError):
        storage.create_stage(stage.path)


def test_fragments_and_plan(spark, setting):
    _, storage, points, _ = setting
    assert storage.fragments().count() == 0 and storage.consolidation_plan() == []
    jobs.shatter(spark, run(storage.path, name="one", lists=False, parts=2), points)
    later = storage.process("one").end_timestamp + 1
    jobs.shatter(spark, run(storage.path, name="two", lists=False), points)
    found = storage.fragments().orderBy("time_slot", "part").collect()
    assert [(r.time_slot, r.part) for r in found] == [(1, 0), (1, 1), (2, 0)] and found[1].y1 == found[0].y2 + 1
    assert sum(r.cells for r in found) == storage.all_rows().count() and all(r.bytes > 0 for r in found)
    plan = storage.consolidation_plan()
    assert [(p["time_slot"], p["parts"], p["wanted"]) for p in plan] == [(1, [0, 1], 1), (2, [0], 1)]
    assert storage.consolidation_plan(1) == []
    jobs.consolidate(spark, storage.path, between=(int(later), None))
    assert [p["time_slot"] for p in storage.consolidation_plan()] == [1]
    assert storage.consolidate_by_plan() == 1 and storage.consolidation_plan() == []
    assert storage.all_rows().agg(F.sum("count")).first()[0] == 2 * points.count()


def test_websocket_log():
    """Frames of three sizes, as a server of its own reads them."""
    server, got = socket.create_server(("127.0.0.1", 0)), []

    def serve():
        link, _ = server.accept()
        stream = link.makefile("rwb")
        while stream.readline().strip():
            pass
        stream.write(b"HTTP/1.1 101 Switching Protocols\r\n\r\n")
        stream.flush()
        while True:
            opcode, size = stream.read(2)
            size &= 127
            size = int.from_bytes(stream.read({126: 2, 127: 8}[size]), "big") if size > 125 else size
            mask = stream.read(4)
            got.append((opcode & 15, bytes(b ^ mask[k % 4] for k, b in enumerate(stream.read(size))).decode()))
            if opcode & 15 == 8:
                return

    thread = threading.Thread(target=serve, daemon=True)
    thread.start()
    out = logger(websocket=f"ws://127.0.0.1:{server.getsockname()[1]}/log", as_json=True)
    texts = ["short", "m" * 300, "l" * 70_000]
    for text in texts:
        out.info(text)
    out.handlers[0].close()
    thread.join(10)
    server.close()
    logger()
    assert [json.loads(t)["message"] for k, t in got if k == 1] == texts and got[-1] == (8, "")
    with pytest.raises(ValueError):
        WebSocketHandler("http://somewhere")


def test_names_and_memory(spark):
    assert len({random_name() for _ in range(200)}) > 50 and all(random_name().count("-") == 1 for _ in range(20))
    found = memory_peaks(spark)
    assert found and all(set(r) == {"executor", "heap", "execution", "jvm", "python"} for r in found)


def las_bytes(form, points, minor=4):
    """A LAS file of points (x, y, z, return, returns, class, time) at a hundredth of a unit."""
    length = {0: 20, 1: 28, 6: 30, 7: 36}[form] + 3  # with extra bytes
    out = bytearray(375)
    out[:4], out[24:26] = b"LASF", bytes([1, minor])
    struct.pack_into("<HI", out, 94, 375, 375)
    struct.pack_into("<BHI", out, 104, form, length, 0 if minor == 4 else len(points))
    x, y, z = ([p[k] for p in points] or [0.0] for k in range(3))
    struct.pack_into("<12d", out, 131, *[0.01] * 3, 100, 200, 0, max(x), min(x), max(y), min(y), max(z), min(z))
    struct.pack_into("<Q", out, 247, len(points) if minor == 4 else 0)
    for px, py, pz, r, n, c, t in points:
        row = struct.pack("<iiiH", round((px - 100) * 100), round((py - 200) * 100), round(pz * 100), 7)
        if form < 6:
            row += struct.pack("<BBbBH", r | n << 3, c | 64, -3, 9, 11) + (struct.pack("<d", t) if form else b"")
        else:
            row += struct.pack("<BBBBhHd", r | n << 4, 0, c, 9, -500, 11, t) + (b"rgbrgb" if form == 7 else b"")
        out += row + b"xyz"
    return bytes(out)


@pytest.mark.parametrize("form, minor", [(0, 2), (1, 2), (6, 4), (7, 4)])
def test_las(spark, tmp_path, monkeypatch, form, minor):
    monkeypatch.setattr(las, "RUN", 7)
    west = [(300 + k, 310.25 + k, k / 4, 1 + k % 3, 3, 2 + k, 1000.5 + k) for k in range(20)]
    east = [(500 + k, 310.0, 1.0, 1, 1, 5, 0.0) for k in range(5)]
    (tmp_path / "in").mkdir()
    for name, points in (("w", west), ("e", east), ("none", [])):
        (tmp_path / f"in/{name}.las").write_bytes(las_bytes(form, points, minor))
    source = PointSource.of(f"file://{tmp_path}/in/w.las")
    rows = sorted(source.read(spark).collect(), key=lambda r: r.X)
    assert source.format == "las" and len(rows) == 20
    for r, p in zip(rows, west):
        assert np.allclose([r.X, r.Y, r.Z], p[:3]) and (r.ReturnNumber, r.NumberOfReturns, r.Classification, r.Intensity, r.UserData, r.PointSourceId) == (*p[3:6], 7, 9, 11)
        assert r.GpsTime == (p[6] if form else None) and np.isclose(r.ScanAngle, -3)
    folder = PointSource(f"file://{tmp_path}/in", "las")
    assert folder.count(spark) == folder.estimate_count(spark) == 25 and folder.bounds(spark) == Bounds(300, 310, 504, 329.25)
    box = Bounds(500, 300, 503, 400)
    assert folder.count(spark, box) == 3 and folder.estimate_count(spark, box) == 5
    assert folder.read(spark, Bounds(0, 0, 9, 9)).count() == 0
    index = [(f"file://{tmp_path}/in/{n}.las", *b) for n, b in (("w", (300.0, 310.0, 320.0, 330.0)), ("e", (500.0, 310.0, 504.0, 310.0)))]
    spark.createDataFrame(index, "location string, minx double, miny double, maxx double, maxy double").write.parquet(f"file://{tmp_path}/i.tindex")
    assert PointSource.of(f"file://{tmp_path}/i.tindex").count(spark) == 25
    moved = PointSource.from_pipeline([{"type": "readers.las", "filename": f"file://{tmp_path}/in"}, {"type": "filters.assign", "value": {"X": "X - 500"}}])
    assert moved.count(spark, Bounds(0, 300, 3, 400)) == 3
    bad = bytearray(las_bytes(form, east, minor))
    (tmp_path / "cut.las").write_bytes(bad[:-1])
    with pytest.raises(Exception, match="ends before"):
        PointSource.of(f"file://{tmp_path}/cut.las").count(spark)
    bad[104] |= 0x80
    (tmp_path / "packed.las").write_bytes(bad)
    for name in ("packed", "other"):
        (tmp_path / "other.las").write_bytes(b"x")
        with pytest.raises(ValueError):
            las.header(f"{tmp_path}/{name}.las")


def test_largest_unit_to_the_least_loaded():
    from stratagrid.operators import tiling

    assert tiling.balanced([7, 3, 9, 1, 4, 4, 0], 3) == [1, 1, 0, 2, 2, 2, 0]
    assert tiling.balanced([], 2) == [] and tiling.balanced([5, 5], 1) == [0, 0]


def test_scan(spark, setting):
    alignment, storage, points, _ = setting
    assert jobs.scan(spark, storage.path, points, None, 10, 10, 5)["tile_info"]["recommended"] == 1
    assert jobs.scan(spark, storage.path, points, depth=5)["tile_info"]["recommended"] == (100 if alignment == "AlignToCorner" else 121)


def test_chunks_and_workers(spark, setting):
    from stratagrid.operators import tiling

    _, storage, points, _ = setting
    whole = storage.config.extents
    units = tiling.chunk(points.filter("X < 450"), whole, 3000)
    seen = [i for u in units for i in u.get_indices()]
    assert len(seen) == len(set(seen))
    found = tiling.leaves(points, whole, 10, 10, 2)
    loads = [r["sum(points)"] for r in tiling.assign_workers(found, 4).groupBy("worker").sum("points").collect()]
    assert len(loads) == 4 and max(loads) < 1.5 * min(loads)
    r = whole.rect
    assert tuple(tiling.union_box(found).first()) == (r.x1, r.x2, r.y1, r.y2)


def test_session_settings_and_log(tmp_path):
    from stratagrid.sources.session import logger, object_store_options

    found = object_store_options("us-west-2", anonymous=True, retries=3)
    assert found["fs.s3a.endpoint.region"] == "us-west-2" and found["fs.s3a.retry.limit"] == "3" and "Anonymous" in found["fs.s3a.aws.credentials.provider"]
    logger(file=str(tmp_path / "log"), as_json=True).warning("seen")
    assert json.loads((tmp_path / "log").read_text())["message"] == "seen"


def test_slots_config_and_publishing(spark, setting):
    _, storage, points, tmp = setting
    assert [storage.reserve_time_slot() for _ in range(5)] == [1, 2, 3, 4, 5]
    again = Storage.from_db(spark, storage.path).config
    assert again.to_json() == storage.config.to_json() and again.next_time_slot == 6
    with pytest.raises(FileExistsError):
        jobs.initialize(spark, storage.config)
    with pytest.raises(FileNotFoundError):
        Storage.from_db(spark, f"file://{tmp}/none")
    jobs.shatter(spark, run(storage.path, processing_strategy="macro-v3-stage-push", tile_size=4, read_group_size=16, publish_uri=f"file://{tmp}/shard", lists=False), points)
    assert spark.read.parquet(f"file://{tmp}/shard").count() == storage.read().count()
    both = union_of([storage, storage], columns=["m_Z_mean"])
    assert both.count() == storage.read().count()


def test_validation():
    with pytest.raises(ValueError):
        StorageConfig("s", BOX, attrs=[attribute("Z")], metrics=[statistics["max"].on("Intensity")])
    with pytest.raises(ValueError):
        StorageConfig("s", BOX, "EPSG:4326")
    assert StorageConfig("s", BOX, "EPSG:5070", 30, xsize=1000).xsize == 12
    for bad in ({"processing_strategy": "x"}, {"processing_halo_m": -1}, {"processing_strategy": "macro-v2"}, {"processing_strategy": "macro-v2", "tile_size": 5, "read_group_size": 25}, {"processing_strategy": "macro-v2", "tile_size": 4, "read_group_size": 9}, {"processing_strategy": "macro-v3-stage-push", "tile_size": 4, "read_group_size": 16, "publish_uri": "s"}, {"stage_dir": "t"}, {"stage_dir": "t", "publish_uri": "t"}, {"stage_dir": "s", "publish_uri": "t"}, {"stage_file_mb": 0}, {"shard_side_groups": 0}, {"shard_target_points": 0}):
        with pytest.raises(ValueError):
            ShatterConfig("s", "f", "2020-01-01", **bad)
    with pytest.raises(ValueError):
        ShatterConfig("s", "f", ["2020-01-01"] * 3)
    a, b = ShatterConfig("s", "f", "2020-01-01"), ShatterConfig("s", "f", "2020-01-01")
    assert a.name != b.name and ShatterConfig.from_dict(json.loads(json.dumps(a.to_json()))) == a


def test_sources(spark, tmp_path):
    west, east = (area(spark, "AlignToCorner").filter(f"X {op} 450") for op in ("<", ">="))
    for name, part in (("w", west), ("e", east)):
        part.write.parquet(f"file://{tmp_path}/{name}")
    index = [(f"file://{tmp_path}/w", 300.0, 300.0, 450.0, 600.0), (f"file://{tmp_path}/e", 450.0, 300.0, 600.0, 600.0)]
    spark.createDataFrame(index, "location string, minx double, miny double, maxx double, maxy double").write.parquet(f"file://{tmp_path}/index.tindex")
    source = PointSource.of(f"file://{tmp_path}/index.tindex")
    assert source.format == "tindex" and source.count(spark) == 90_000
    inside = source.read(spark, Bounds(300, 300, 400, 400))
    assert inside.count() == 10_000 and all("/w/" in f for f in inside.inputFiles())
    assert source.bounds(spark) == Bounds(300, 300, 599, 599) and source.estimate_count(spark, resolution=50) == 36
    pipeline = {"pipeline": [f"file://{tmp_path}/w", {"type": "filters.where", "expression": "Z > 12"}, {"type": "filters.assign", "value": {"Z": "Z * 2"}}, {"type": "writers.las", "filename": "x"}]}
    (tmp_path / "p.json").write_text(json.dumps(pipeline))
    rows = PointSource.of(f"file://{tmp_path}/p.json", spark).read(spark)
    assert rows.agg(F.min("Z")).first()[0] == 26
    for bad in ([{"type": "filters.where", "expression": "true"}], ["a", "b"], [{"type": "readers.none", "filename": "x"}]):
        with pytest.raises(ValueError):
            PointSource.from_pipeline(bad)


def test_relational(spark):
    cells = spark.createDataFrame([(0, 0, 1, 5.0), (0, 0, 2, None), (1, 1, 1, 7.0)], "X int, Y int, time_slot int, v double")
    newest = relational.latest(cells)
    assert sorted((r.X, r.time_slot, r.v) for r in newest.collect()) == [(0, 2, None), (1, 1, 7.0)]
    dense = relational.densify(newest, Rect(0, 2, 0, 2), {"v": -1.0})
    assert sorted((r.X, r.Y, r.v) for r in dense.collect()) == [(0, 0, -1.0), (0, 1, -1.0), (1, 0, -1.0), (1, 1, 7.0)]
    assert relational.densify(cells, Rect(3, 3, 0, 2)).count() == 0
    rows = {r.Y: r.v for r in relational.raster_rows(newest, "v", Rect(0, 2, 0, 2), -1.0).collect()}
    assert rows == {0: [-1.0, -1.0], 1: [-1.0, 7.0]}


def test_command_line(spark, tmp_path, capsys):
    area(spark, "AlignToCorner").write.parquet(f"file://{tmp_path}/points")
    at = ["-d", f"file://{tmp_path}/store"]
    (tmp_path / "own.py").write_text("from stratagrid.operators.metrics import Metric\ndef one(x):\n    return 1\ndef metrics():\n    return [Metric('exists', method=one, dtype='uint8')]\n")
    cli.main([*at, "initialize", "--bounds", "[300,300,600,600]", "--crs", "EPSG:5070", "--resolution", "30", "--alignment", "AlignToCorner", "-m", f"mean,median,{tmp_path}/own.py", "-a", "Z,Intensity"], spark)
    assert cli.main([*at, "shatter", f"file://{tmp_path}/points", "--date", "2020-01-01"], spark) == 90_000
    assert cli.main([*at, "scan", f"file://{tmp_path}/points"], spark)["tile_info"]["recommended"] == 100
    found = cli.main([*at, "info", "--history", "--dates", "2019-01-01", "2021-01-01"], spark)["history"]
    assert len(found) == 1 and found[0]["finished"]
    assert len(cli.main([*at, "extract", "-o", f"file://{tmp_path}/out", "-m", "median"], spark)) == 2
    cells = Storage.from_db(spark, at[1]).read()
    assert cells.filter("m_Z_exists = 1 and m_Intensity_exists = 1 and count = 900").count() == cells.count() == 100
    assert [m["name"] for m in cli.main([*at, "info", "--metrics"], spark)["metrics"]] == ["mean", "median", "exists"]
    assert cli.main([*at, "delete", "--id", found[0]["name"]], spark)["finished"] is False
    assert cli.main([*at, "restart", "--id", found[0]["name"]], spark) == 90_000
    assert cli.main([*at, "resume", "--id", found[0]["name"]], spark) == 90_000
    cli.main([*at, "consolidate"], spark)
    with pytest.raises(SystemExit):
        cli.main([*at, "shatter", "x"], spark)


def test_streaming_ingest(spark, tmp_path):
    from stratagrid.streaming.ingest import ingest

    points = area(spark, "AlignToCorner")
    storage = jobs.initialize(spark, StorageConfig(f"file://{tmp_path}/s", BOX, "", 30, "AlignToCorner", metrics=[Metric.from_dict({"name": "mean"})]))
    for k in range(2):
        points.filter(F.col("X") < 450 if k == 0 else F.col("X") >= 450).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        ingest(spark, storage.path, f"file://{tmp_path}/in", points.schema, f"file://{tmp_path}/check", datetime(2020, 1, 1)).awaitTermination()
    assert storage.read(["count"]).agg(F.sum("count")).first()[0] == 90_000
    # Another stream has numbers of its own.
    points.withColumn("Z", F.col("Z") + 100).filter("X >= 450").coalesce(1).write.parquet(f"file://{tmp_path}/in2")
    ingest(spark, storage.path, f"file://{tmp_path}/in2", points.schema, f"file://{tmp_path}/check2", datetime(2020, 1, 1)).awaitTermination()
    assert len(storage.processes()) == 3 and storage.read(["count"]).agg(F.sum("count")).first()[0] == 90_000
    assert 0 < storage.read(["m_Z_mean"]).filter("m_Z_mean > 100").count() < 100
