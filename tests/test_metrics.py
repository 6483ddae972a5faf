import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratagrid.functions import ordered
from stratagrid.operators import metrics
from stratagrid.operators.metrics import Attribute, Metric
from stratagrid.plans.fused import cell_metrics, outputs

POINTS = "xi int, yi int, Z double, Intensity int, ReturnNumber int, NumberOfReturns int"
NAMES = ["Z", "NumberOfReturns", "ReturnNumber", "Intensity"]


def cloud(seed=1, cells=12):
    r = random.Random(seed)
    rows = []
    for c in range(cells):
        for _ in range(r.choice([1, 2, 3, 5, 40, 200])):
            rows.append((c, 0, r.choice([0.0, 1.0, r.uniform(0, 30), float(r.randint(0, 6))]), r.randint(0, 300), r.randint(1, 8), r.randint(1, 8)))
    return rows + [(98, 0, 1.0, 7, 2, 2), (99, 0, 0.0, 0, 1, 1), (99, 0, 0.0, 0, 1, 1)]


def numpy_stats(x):
    """Statistics by their textbook definitions; None where undefined."""
    n = len(x)
    if not n:
        return {}
    v = np.sort(np.array(x, dtype=float))
    out = {f"p{p:02d}": np.percentile(v, p) for p in metrics.PERCENTILES}
    out |= {"90m10": out["p90"] - out["p10"], "95m05": out["p95"] - out["p05"], "iq": out["p75"] - out["p25"], "median": np.median(v), "min": v[0], "max": v[-1], "stddev": v.std()}
    mean = v.mean() if v.any() else None
    out |= {"mean": mean, "variance": v.var(ddof=1) if n > 1 else None, "sqmean": math.sqrt((v**2).mean()), "cumean": np.cbrt((abs(v) ** 3).mean())}
    d, s = v - v.mean(), v.std()
    if n > 1 and v[-1] > v[0]:
        out |= {"skewness": (d**3).sum() / ((n - 1) * s**3), "kurtosis": (d**4).sum() / ((n - 1) * s**4)}
        out["canopy_relief_ratio"] = (v.mean() - v[0]) / (v[-1] - v[0])
    if mean:
        out |= {"cv": s / mean, "aad": abs(v - mean).mean(), "mad_mean": np.median(abs(v - mean))}
    out["mad_median"] = np.median(abs(v - np.median(v)))
    counts, edges = np.histogram(v, 64)
    out["mode"] = v[0] if v[0] == v[-1] else edges[counts.argmax()]
    out["mad_mode"] = np.median(abs(v - out["mode"]))
    j = np.arange(n, dtype=float)
    b = [v.mean()] + [None] * 3
    if n > 1:
        b[1] = (v * j).sum() / (n * (n - 1))
        out["l2"] = 2 * b[1] - b[0]
    if n > 2:
        b[2] = (v * j * (j - 1)).sum() / (n * (n - 1) * (n - 2))
        out["l3"] = 6 * (b[2] - b[1]) + b[0]
    if n > 3:
        b[3] = (v * j * (j - 1) * (j - 2)).sum() / (n * (n - 1) * (n - 2) * (n - 3))
        out["l4"] = 20 * b[3] - 30 * b[2] + 12 * b[1] - b[0]
    out["l1"] = b[0]
    for name, a, c in (("lcv", "l2", "l1"), ("lskewness", "l3", "l2"), ("lkurtosis", "l4", "l2")):
        if a in out and out.get(c):
            out[name] = out[a] / out[c]
    return out


def close(a, b):
    if a is None or b is None or b != b:
        return a is None and (b is None or b != b)
    return math.isclose(a, b, rel_tol=1e-7, abs_tol=1e-7)


def test_preset_against_numpy(spark):
    rows = cloud()
    preset = metrics.get_grid_metrics()
    got = {r.xi: r for r in cell_metrics(spark.createDataFrame(rows, POINTS), list(preset.values()), NAMES).collect()}
    assert set(got) == {r[0] for r in rows}
    for c, row in got.items():
        own = [r for r in rows if r[0] == c]
        for attribute, k in (("Z", 2), ("Intensity", 3)):
            want = numpy_stats([r[k] for r in own if r[2] > 2])
            for m in (metrics.percentiles | metrics.l_moments | metrics.statistics | metrics.product_moments | metrics.aad).values():
                name = m.entry_name(attribute)
                if name in row and m.name not in ("profile_area",):
                    if m.name in ("mode", "mad_mode") and want and not close(row[name], want.get(m.name)):
                        # a value on a bin's edge may fall to either side
                        assert abs(row[name] - want[m.name]) <= (want["max"] - want["min"]) / 2, (c, name)
                        continue
                    assert close(row[name], want.get(m.name)), (c, name, row[name], want.get(m.name))
        q = np.percentile([r[2] for r in own], range(100))
        area = 0.5 * (q[0] / q[99] + 2 * sum(q[1:99] / q[99]) + 1) if q[99] > 0 else None
        assert close(row.m_Z_profile_area, area)
        count = lambda p: sum(map(p, own)) or None
        high = [r for r in own if r[2] > 2]
        mean, mode = (np.mean([r[2] for r in high]), row.m_Z_mode) if high else (None, None)
        assert row["m_ReturnNumber_all_count"] == len(own) == row["count"]
        assert row["m_ReturnNumber_r3_count"] == count(lambda r: r[2] > 2 and r[4] == 3)
        assert row["m_ReturnNumber_1st_count_above_htbreak"] == count(lambda r: r[2] > 3 and r[4] == 1)
        first = [r for r in own if r[4] == 1]
        assert row["m_Z_all_count_above_mean"] == (sum(r[2] > mean for r in own) if high else None)
        assert row["m_Z_1st_count_above_mode"] == (sum(r[2] > mode for r in first) if high and first else None)
        assert close(row["m_ReturnNumber_all_cover_above_htbreak"], 100 * a / len(own) if (a := count(lambda r: r[2] > 3)) else None)
        assert close(row["m_Z_all_cover_above_mode"], 100 * sum(r[2] > mode for r in own) / len(high) if high else None)
        assert close(row["m_Z_all_1st_cover_above_mean"], 100 * sum(r[2] > mean for r in own) / len(first) if high and first else None)


def test_hand_written_rows(spark):
    z = [0, 1, 1.37, 3, 4, 5, 10, 15, 20, 21]
    rn = [1, 1, 2, 1, 2, 1, 2, 1, 2, 2]
    rows = [(0, 0, float(a), 1, b, 1) for a, b in zip(z, rn)]
    row = cell_metrics(spark.createDataFrame(rows, POINTS), list(metrics.get_grid_metrics().values()), NAMES).first()
    assert [row[f"m_Z_Strata-{k}"] for k in range(1, 7)] == pytest.approx([20, 30, 10, 10, 10, 20])
    assert [row[f"m_ReturnNumber_{k}_above_htbreak"] for k in ("all_cover", "1st_cover", "all_1st_cover")] == pytest.approx([60, 40, 120])


def test_preset_contract():
    preset = metrics.get_grid_metrics()
    assert len(preset) == 74 and len(metrics.all_metrics) == 39
    assert len(outputs(list(preset.values()), NAMES)) == 110
    assert preset["p50"].filters == ("`Z` > 2.0D",) and preset["profile_area"].filters == ()
    again = metrics.get_grid_metrics("HeightAboveGround", 1, 4)
    assert again["mean"].attributes == ("HeightAboveGround", "Intensity") and metrics.statistics["mode"].filters == ()


def test_result_does_not_depend_on_order_or_selection(spark):
    points = spark.createDataFrame(cloud(3), POINTS)
    preset = list(metrics.get_grid_metrics().values())
    one = {r.xi: r.m_Z_aad for r in cell_metrics(points, [m for m in preset if m.name == "aad"], ["Z"]).collect()}
    all_ = {r.xi: r.m_Z_aad for r in cell_metrics(points, preset[::-1], ["Z"]).collect()}
    assert one == all_


def test_compat_switches(spark):
    points = spark.createDataFrame(cloud(4), POINTS)
    row = cell_metrics(points, list(metrics.get_grid_metrics(compat=True).values()), NAMES).filter("xi = 3").first()
    assert row["m_Z_all_count_above_mode"] == row["m_Z_all_count_above_mean"]
    bare = cell_metrics(points, list(metrics.get_grid_metrics().values()), NAMES, drop_bare=True).filter("xi = 98").first()
    assert bare["count"] == 1 and bare["m_ReturnNumber_all_count"] is None


def spread(x):
    return float(x.max() - x.min())


def over(x, mean):
    return int((x > mean).sum())


def test_user_metrics(spark):
    points = spark.createDataFrame(cloud(5), POINTS)
    own = [metrics.product_moments["mean"].on("Z"), Metric("spread", method=spread, dtype="float64", attributes=("Z",), filters=("Z > 2",)), Metric("over", method=over, dtype="int32", attributes=("Z",), dependencies=("mean",))]
    rows = cloud(5)
    for r in cell_metrics(points, own, ["Z"]).collect():
        z = [x[2] for x in rows if x[0] == r.xi]
        high = [v for v in z if v > 2]
        assert close(r.m_Z_spread, max(high) - min(high) if high else None)
        assert r.m_Z_over == (sum(v > np.mean(z) for v in z) if any(z) else None)


def test_user_filters(spark, tmp_path):
    """Functions of rows: a DataFrame or booleans as their result, beside predicates, kept by name, never as code."""
    path = tmp_path / "filters.py"
    path.write_text("from stratagrid.operators.metrics import RowFilter, statistics\n\ndef low(rows):\n    return rows[rows['Z'] < 3]\n\ndef flags(rows):\n    return rows['R'] == 1\n\n"
                    "def metrics():\n    top = statistics['max']\n    return [top.add_filter(low), top.add_filter('Z > 0').add_filter(RowFilter(flags, ('R',)))]\n")  # fmt: skip
    one, two = metrics.load_user_metrics(str(path))
    points = spark.createDataFrame([(0, 0, 1.0, 1), (0, 0, 2.0, 2), (0, 0, 9.0, 1), (1, 0, 5.0, 2), (1, 0, None, 1)], "xi int, yi int, Z double, R int").repartition(3)
    for a, b in ((one, two), (Metric.from_string(one.to_string()), Metric.from_string(two.to_string()))):
        found = cell_metrics(points, [a], ["Z"]).join(cell_metrics(points, [b], ["Z"]).withColumnRenamed("m_Z_max", "other"), ["xi", "yi"])
        assert {(r.xi, r.m_Z_max, r.other) for r in found.collect()} == {(0, 2.0, 9.0), (1, None, None)}
    assert "def " not in one.to_string() and str(path) in one.to_string()


def test_mode_of_close_values(spark):
    """Sixty-four bins of no width give way to ten, and those to null."""
    up = lambda a, b: float(np.nextafter(a, b))
    steps = [1.0]
    for _ in range(30):
        steps.append(up(steps[-1], 2))
    rows = [([1.0, 1.0, 65.0],), (steps,), ([1.0, up(1.0, 2)],), ([1.0, 1.0],), ([],)]
    got = [r[0] for r in spark.createDataFrame(rows, "v array<double>").select(ordered.mode(F.col("v"))).collect()]
    assert got[0] == 1.0 and 1.0 <= got[1] <= steps[-1] and got[2:] == [None, 1.0, None]


def test_json_round_trip():
    for m in metrics.get_grid_metrics("HeightAboveGround", 1, 4).values():
        again = Metric.from_string(m.to_string())
        assert again == m and again.build is not None and again.preset == ("HeightAboveGround", 1.0, 4.0, False)
    u = Metric("spread", method=spread, nan_policy="raise")
    assert Metric.from_string(u.to_string()) == u and Metric.from_string(u.to_string()).nan_policy == "raise"
    assert Attribute.from_dict(Attribute("Z", "float64").to_json()) == Attribute("Z", "float64")


def test_validation_and_names(tmp_path):
    with pytest.raises(ValueError):
        Metric("x", dtype="complex64")
    with pytest.raises(ValueError):
        metrics.parse_metrics("nothing")
    assert [m.name for m in metrics.parse_metrics("mean,p_moments,l1")] == ["mean", "variance", "skewness", "kurtosis", "l1"]
    assert len(metrics.parse_metrics("grid_metrics_Z_1_2")) == 74 and len(metrics.parse_metrics("all")) == 39
    (tmp_path / "own.py").write_text("from stratagrid.operators.metrics import Metric\ndef metrics():\n    return [Metric('exists', method=lambda x: 1, dtype='uint8')]\n")
    assert metrics.parse_metrics(str(tmp_path / "own.py"))[0].name == "exists"


def test_other_preset_survives_storing(spark):
    points = spark.createDataFrame(cloud(6), POINTS).withColumnRenamed("Z", "HeightAboveGround")
    names = ["HeightAboveGround", "ReturnNumber"]
    own = list(metrics.get_grid_metrics("HeightAboveGround", 1, 4).values())
    again = [Metric.from_string(m.to_string()) for m in own]
    a, b = (sorted(map(repr, cell_metrics(points, x, names).collect())) for x in (own, again))
    assert a == b


def test_one_shuffle(spark):
    points = spark.createDataFrame(cloud(7), POINTS)
    plan = cell_metrics(points, list(metrics.get_grid_metrics().values()), NAMES)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Window" not in plan and "Python" not in plan
