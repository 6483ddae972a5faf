"""The same queries in SQL for DuckDB, written from the metrics' definitions and not from their plans."""

from __future__ import annotations

from .queries import BOX, FAMILIES, digits, family_columns, nudge

P = "p AS (SELECT l_partkey::DOUBLE AS X, (l_suppkey * 20)::DOUBLE AS Y, l_quantity AS Z, l_extendedprice AS I, l_linenumber AS RN, l_orderkey AS O, l_shipdate AS T FROM lineitem)"
C = P + ", c AS (SELECT *, floor(X / 100)::INT AS xi, ceil((20000 - Y) / 100 - 1)::INT AS yi FROM p WHERE X >= 0 AND X < 20000 AND Y >= 0 AND Y < 20000)"
IN_BOX = f"X >= {BOX.minx} AND X < {BOX.maxx} AND Y >= {BOX.miny} AND Y < {BOX.maxy}"
#: The box along cell lines.
IN_CELLS = "X >= 300 AND X < 1300 AND Y >= 400 AND Y < 1500"
Q = {"p01": 0.01, "p05": 0.05, "p10": 0.1, "p20": 0.2, "p25": 0.25, "p30": 0.3, "p40": 0.4, "p50": 0.5, "p60": 0.6, "p70": 0.7, "p75": 0.75, "p80": 0.8, "p90": 0.9, "p95": 0.95, "p99": 0.99}

# One row per point with the values of its cell: means, medians, extremes and ranks of the points above 2.
WINDOWS = C + """,
w AS (SELECT *, count(*) FILTER (Z > 2) OVER cell AS n,
  avg(Z) FILTER (Z > 2) OVER cell AS mz, avg(I) FILTER (Z > 2) OVER cell AS mi,
  median(Z) FILTER (Z > 2) OVER cell AS dz,
  min(Z) FILTER (Z > 2) OVER cell AS loz, max(Z) FILTER (Z > 2) OVER cell AS hiz,
  min(I) FILTER (Z > 2) OVER cell AS loi, max(I) FILTER (Z > 2) OVER cell AS hii,
  (row_number() OVER (PARTITION BY xi, yi ORDER BY (Z > 2) DESC, Z) - 1)::DOUBLE AS jz,
  (row_number() OVER (PARTITION BY xi, yi ORDER BY (Z > 2) DESC, I) - 1)::DOUBLE AS ji
  FROM c WINDOW cell AS (PARTITION BY xi, yi)),
b AS (SELECT *, CASE WHEN hiz = loz THEN 0 ELSE least(floor((Z - loz) * 64 / (hiz - loz)), 63) END AS bz,
  CASE WHEN hii = loi THEN 0 ELSE least(floor((I - loi) * 64 / (hii - loi)), 63) END AS bi FROM w),
oz AS (SELECT xi, yi, loz + bz * (hiz - loz) / 64 AS oz FROM (SELECT xi, yi, bz, any_value(loz) AS loz, any_value(hiz) AS hiz, row_number() OVER (PARTITION BY xi, yi ORDER BY count(*) DESC, bz) AS r FROM b WHERE Z > 2 GROUP BY xi, yi, bz) WHERE r = 1),
oi AS (SELECT xi, yi, loi + bi * (hii - loi) / 64 AS oi FROM (SELECT xi, yi, bi, any_value(loi) AS loi, any_value(hii) AS hii, row_number() OVER (PARTITION BY xi, yi ORDER BY count(*) DESC, bi) AS r FROM b WHERE Z > 2 GROUP BY xi, yi, bi) WHERE r = 1),
v AS (SELECT b.*, oz.oz, oi.oi FROM b LEFT JOIN oz USING (xi, yi) LEFT JOIN oi USING (xi, yi))"""


def _round(expression: str, places: int = 8) -> str:
    return f"round({expression} + {nudge(places)!r}::DOUBLE, {places})"


def _columns() -> dict[str, str]:
    """Each column of the preset as an expression over the points of a cell."""
    out: dict[str, str] = {}
    for x, a, m, lo, hi, j, o in (("Z", "Z", "mz", "loz", "hiz", "jz", "oz"), ("I", "Intensity", "mi", "loi", "hii", "ji", "oi")):
        f = "FILTER (Z > 2)"
        name = lambda k: f"m_{a}_{k}"  # noqa: E731, B023
        q = {k: f"quantile_cont({x}, {s}) {f}" for k, s in Q.items()}
        out |= {name(k): v for k, v in q.items()}
        out |= {name("90m10"): f"{q['p90']} - {q['p10']}", name("95m05"): f"{q['p95']} - {q['p05']}", name("iq"): f"{q['p75']} - {q['p25']}"}
        n = "nullif(any_value(n), 0)::DOUBLE"
        s = lambda e: f"sum({e}) {f}"  # noqa: E731, B023
        b0 = f"({s(x)} / {n})"
        b1 = f"({s(f'{x} * {j}')} / nullif({n} * ({n} - 1), 0))"
        b2 = f"({s(f'{x} * {j} * ({j} - 1)')} / nullif({n} * ({n} - 1) * ({n} - 2), 0))"
        b3 = f"({s(f'{x} * {j} * ({j} - 1) * ({j} - 2)')} / nullif({n} * ({n} - 1) * ({n} - 2) * ({n} - 3), 0))"
        l = [b0, f"(2 * {b1} - {b0})", f"(6 * ({b2} - {b1}) + {b0})", f"(20 * {b3} - 30 * {b2} + 12 * {b1} - {b0})"]
        out |= {name(f"l{k + 1}"): e for k, e in enumerate(l)}
        out |= {name("lcv"): f"{l[1]} / nullif({l[0]}, 0)", name("lskewness"): f"{l[2]} / nullif({l[1]}, 0)", name("lkurtosis"): f"{l[3]} / nullif({l[1]}, 0)"}
        mean = f"CASE WHEN any_value({lo}) <> 0 OR any_value({hi}) <> 0 THEN any_value({m}) END"
        sd = f"sqrt(avg(({x} - {m}) * ({x} - {m})) {f})"
        out |= {name("mode"): f"any_value({o})", name("median"): q["p50"], name("min"): f"any_value({lo})", name("max"): f"any_value({hi})", name("stddev"): sd, name("cv"): f"{sd} / nullif({mean}, 0)"}
        spread = f"any_value({hi}) > any_value({lo})"
        power = lambda k: f"CASE WHEN {spread} THEN nullif(sum(({x} - {m}) ** {k}) {f} / nullif(({n} - 1) * {sd} ** {k}, 0), 0) END"  # noqa: E731, B023
        out |= {name("mean"): mean, name("variance"): f"sum(({x} - {m}) * ({x} - {m})) {f} / nullif({n} - 1, 0)", name("skewness"): power(3), name("kurtosis"): power(4)}
        out |= {name("aad"): f"avg(abs({x} - {m})) {f}"}
    out["m_Z_canopy_relief_ratio"] = "nullif((any_value(mz) - any_value(loz)) / nullif(any_value(hiz) - any_value(loz), 0), 0)"
    out["m_Z_sqmean"] = "sqrt(avg(Z * Z) FILTER (Z > 2))"
    out["m_Z_cumean"] = "cbrt(avg(abs(Z * Z * Z)) FILTER (Z > 2))"
    shares = ", ".join(f"{k / 100:.2f}" for k in range(100))
    top = f"list_extract(quantile_cont(Z, [{shares}]), 100)"
    inner = f"list_sum(quantile_cont(Z, [{shares}])[2:99])"
    out["m_Z_profile_area"] = f"CASE WHEN {top} > 0 THEN 0.5 * (list_extract(quantile_cont(Z, [{shares}]), 1) / {top} + 2 * {inner} / {top} + 1) END"
    out |= {"m_Z_mad_median": "median(abs(Z - dz)) FILTER (Z > 2)", "m_Z_mad_mode": "median(abs(Z - oz)) FILTER (Z > 2)", "m_Z_mad_mean": "median(abs(Z - mz)) FILTER (Z > 2)"}
    n = lambda p: f"nullif(count(*) FILTER ({p}), 0)"
    r = lambda k: f"m_ReturnNumber_{k}"
    beyond = lambda p, c: f"CASE WHEN any_value({c}) IS NOT NULL AND count(*) FILTER ({p}) > 0 THEN count(*) FILTER ({p} AND Z > {c}) END"
    out |= {r("all_count"): n("true"), r("all_count_above_htbreak"): n("Z > 3"), r("all_count_above_minht"): n("Z > 2"), r("1st_count"): n("RN = 1"), r("1st_count_above_htbreak"): n("Z > 3 AND RN = 1")}
    out |= {r(f"r{k}_count"): n(f"Z > 2 AND RN = {k}") for k in range(1, 8)}
    for group, p in (("all", "true"), ("1st", "RN = 1")):
        out |= {f"m_Z_{group}_count_above_{k}": beyond(p, c) for k, c in (("mean", "mz"), ("mode", "oz"))}
    share = lambda a, b: f"100 * ({a})::DOUBLE / ({b})"
    out |= {r("all_cover_above_htbreak"): share(n("Z > 3"), n("true")), r("1st_cover_above_htbreak"): share(n("Z > 3 AND RN = 1"), n("RN = 1")), r("all_1st_cover_above_htbreak"): share(n("Z > 3"), n("RN = 1"))}
    out |= {"m_Z_all_cover_above_mean": share(beyond("true", "mz"), n("true")), "m_Z_all_cover_above_mode": share(beyond("true", "oz"), n("Z > 2"))}
    out |= {f"m_Z_1st_cover_above_{k}": share(beyond("RN = 1", c), n("RN = 1")) for k, c in (("mean", "mz"), ("mode", "oz"))}
    out |= {f"m_Z_all_1st_cover_above_{k}": share(beyond("true", c), n("RN = 1")) for k, c in (("mean", "mz"), ("mode", "oz"))}
    edges = [None, 1.37, 5, 10, 15, 20, None]
    for k, (low, high) in enumerate(zip(edges, edges[1:]), 1):
        test = " AND ".join(x for x in (f"Z >= {low}" if low is not None else "", f"Z < {high}" if high is not None else "") if x)
        out[f"m_Z_Strata-{k}"] = f"100.0 * count(*) FILTER ({test}) / count(*)"
    return out


def _family(name: str) -> str:
    found = _columns()
    whole = [c for c in found if "_count" in c]
    chosen = ", ".join(f'{found[c]} AS "{c}"' if c in whole else f'{_round(found[c], digits(c))} AS "{c}"' for c in family_columns(name))
    return f"WITH {WINDOWS} SELECT xi, yi, count(*) AS count, {chosen} FROM v GROUP BY xi, yi"


RUNS = C + ", r AS (SELECT xi AS X, yi AS Y, CASE WHEN T < '1998-05-24' OR X >= 1000 THEN 1 ELSE 2 END AS time_slot, count(*) AS count, max(Z) AS top, min(T::DATE) AS start_time, max(T::DATE) AS end_time FROM c GROUP BY ALL)"

ORACLE_SQL = {name: _family(name) for name in FAMILIES} | {
    "grid_core": f"WITH {C} SELECT xi, yi, count(*) AS count, {_round('CASE WHEN max(abs(Z)) > 0 THEN avg(Z) END')} AS m_Z_mean, {_round('min(Z)')} AS m_Z_min, {_round('max(Z)')} AS m_Z_max, {_round('median(Z)')} AS m_Z_median FROM c GROUP BY xi, yi",
    "bbox_points": f"WITH {P} SELECT {_round('X')} AS X, {_round('Y')} AS Y, {_round('Z')} AS Z, {_round('I')} AS Intensity, RN AS ReturnNumber FROM p WHERE {IN_BOX}",
    "cell_indices": f"WITH {P} SELECT floor((X + 15) / 30)::INT AS xi, ceil((20025 - Y) / 30 - 1)::INT AS yi, count(*) AS n FROM p WHERE X >= -15 AND X < 20025 AND Y >= -15 AND Y < 20025 GROUP BY ALL",
    "source_bounds": f"WITH {P} SELECT min(X) AS minx, min(Y) AS miny, max(X) AS maxx, max(Y) AS maxy FROM p",
    "count_in_bounds": f"WITH {P} SELECT count(*) AS n FROM p WHERE {IN_BOX}",
    "estimate_count": f"WITH {P} SELECT count(*) AS n FROM (SELECT DISTINCT floor(X / 50), floor(Y / 50) FROM p WHERE {IN_BOX})",
    "number_of_returns": f"WITH {C} SELECT xi, yi, max(k)::INT AS most, sum(k)::BIGINT AS total FROM (SELECT xi, yi, k FROM c JOIN (SELECT l_orderkey AS O, count(*) AS k FROM lineitem GROUP BY 1) USING (O)) GROUP BY xi, yi",
    "cell_lists": f"WITH {C} SELECT xi, yi, count(*) AS count, string_agg(RN::VARCHAR, ',' ORDER BY RN) AS returns, count(Z) AS n_z FROM c GROUP BY xi, yi",
    "points_above_own_mean": f"WITH {C} SELECT xi, yi, count(*) AS n FROM (SELECT *, avg(Z) OVER (PARTITION BY xi, yi) AS m FROM c) WHERE Z > m GROUP BY xi, yi",
    "dense_cells": f"WITH {C}, g AS (SELECT xi, yi, count(*) AS n, max(Z) AS top FROM c WHERE RN = 7 AND {IN_CELLS} GROUP BY xi, yi) SELECT x.i::INT AS X, y.i::INT AS Y, coalesce(n, 0) AS count, coalesce(top, -9999.0) AS top FROM (SELECT unnest(range(3, 13)) AS i) x CROSS JOIN (SELECT unnest(range(185, 196)) AS i) y LEFT JOIN g ON xi = x.i AND yi = y.i",
    "dense_grid": f"WITH {C}, g AS (SELECT xi, yi, count(*) AS n, max(Z) AS top FROM c GROUP BY xi, yi) SELECT x.i::INT AS X, y.i::INT AS Y, coalesce(n, 0) AS count, coalesce(top, -9999.0) AS top FROM (SELECT unnest(range(0, 200)) AS i) x CROSS JOIN (SELECT unnest(range(0, 200)) AS i) y LEFT JOIN g ON g.xi = x.i AND g.yi = y.i",
    "latest_cells": f"WITH {RUNS} SELECT X, Y, time_slot, count, top FROM (SELECT *, row_number() OVER (PARTITION BY X, Y ORDER BY time_slot DESC) AS k FROM r) WHERE k = 1",
    "time_travel": f"WITH {RUNS} SELECT X, Y, count, top FROM r WHERE time_slot = 1",
    "date_overlap": f"WITH {RUNS} SELECT X, Y, time_slot, (start_time - DATE '1970-01-01')::INT AS start_day, (end_time - DATE '1970-01-01')::INT AS end_day FROM r WHERE end_time >= DATE '1998-06-01' AND start_time <= DATE '1998-07-01'",
    "raster": f"WITH {C} SELECT yi AS Y, " + ", ".join(f"max(Z) FILTER (xi = {k}) AS x{k}" for k in (3, 4, 5, 6)) + f" FROM c WHERE {IN_CELLS} GROUP BY yi",
    "outlier_trim": f"WITH {C}, n AS (SELECT xi, yi, count(*) AS n FROM c GROUP BY xi, yi), q AS (SELECT quantile_cont(n, 0.25) AS a, quantile_cont(n, 0.75) AS b FROM n) SELECT xi, yi, n FROM n, q WHERE n > a - 0.5 * (b - a) AND n < b + 0.5 * (b - a)",
    "scan_tiles": f"WITH {C} SELECT (xi // 50 * 50)::INT AS x1, (xi // 50 * 50 + 50)::INT AS x2, (yi // 50 * 50)::INT AS y1, (yi // 50 * 50 + 50)::INT AS y2, count(*)::BIGINT AS points, 2500::BIGINT AS cells FROM c GROUP BY ALL",
    "scan_tree": f"""WITH {P}, s AS (SELECT ceil((greatest(max(X), max(Y)) + 1) / 200)::INT AS res, count(*) // 16 AS most FROM p), c AS (SELECT floor(X / res)::INT AS xi, ceil((200 * res - Y) / res - 1)::INT AS yi, most FROM p, s),
      n AS (SELECT 200 >> d AS k, xi // (200 >> d) AS a, yi // (200 >> d) AS b, d, count(*) AS n, any_value(most) AS most FROM c, range(4) AS t(d) GROUP BY ALL)
      SELECT (a * k)::INT AS x1, (a * k + k)::INT AS x2, (b * k)::INT AS y1, (b * k + k)::INT AS y2, n::BIGINT AS points, (k * k)::BIGINT AS cells, n >= most AS ended FROM n
      WHERE (n < most OR d = 3) AND (d = 0 OR EXISTS (SELECT 1 FROM n AS up WHERE up.d = n.d - 1 AND up.a = n.a // 2 AND up.b = n.b // 2 AND up.n >= up.most))""",
    "scan_summary": f"""WITH {C}, n AS (SELECT xi // 50 AS a, yi // 50 AS b, count(*) AS p FROM c GROUP BY ALL), e AS (SELECT ceil(2000.0::DOUBLE / (p / 2500.0::DOUBLE))::BIGINT AS k FROM n),
      s AS (SELECT unnest(list_concat(list_transform(range(2500 // k), lambda x: k), [2500 % k])) AS cells FROM e), q AS (SELECT quantile_cont(cells, 0.25) AS a, quantile_cont(cells, 0.75) AS b FROM s),
      t AS (SELECT cells FROM s, q WHERE cells > a - 1.5 * (b - a) AND cells < b + 1.5 * (b - a)), u AS (SELECT cells FROM t UNION ALL SELECT cells FROM s WHERE NOT EXISTS (SELECT 1 FROM t))
      SELECT (SELECT sum(cells)::BIGINT FROM s) AS num_cells, (SELECT count(*) FROM s) AS num_tiles, {_round('avg(cells)')} AS mean, {_round('stddev_pop(cells)')} AS std_dev, {_round('median(cells)')} AS median, {_round('median(cells)')} AS recommended FROM u""",
    "unfinished_cells": f"WITH {C} SELECT xi, yi, count(*) AS n FROM c WHERE NOT (xi < 5 AND yi >= 190 AND yi < 195) AND NOT (xi >= 10 AND xi < 12 AND yi >= 180) GROUP BY xi, yi",
    "event_cells": f"SELECT floor(user_id / 100)::INT AS xi, floor((ts::DATE - DATE '1970-01-01') / 7)::INT AS yi, count(*) AS count, {_round('min(value)')} AS m_Z_min, {_round('max(value)')} AS m_Z_max, {_round('median(value)')} AS m_Z_median FROM events GROUP BY ALL",
    "user_metric": f"WITH {C} SELECT xi, yi, count(*) AS count, {_round('median(Z)')} AS m_Z_median, {_round('max(Z) FILTER (Z > 2) - min(Z) FILTER (Z > 2)')} AS m_Z_spread FROM c GROUP BY xi, yi",
    "user_filter": f"WITH {C} SELECT xi, yi, count(*) AS count, {_round('max(Z)')} AS m_Z_max, {_round('max(Z) FILTER (RN <= 2)')} AS m_Z_early FROM c GROUP BY xi, yi",
    "metrics_compat": f"""WITH {WINDOWS}, a AS (SELECT xi, yi, count(*) AS count, CASE WHEN any_value(mz) IS NOT NULL THEN count(*) FILTER (Z > mz) END AS above, nullif(count(*) FILTER (Z > 2), 0) AS low,
      nullif(count(*) FILTER (RN = 1), 0) AS first FROM v GROUP BY xi, yi) SELECT xi, yi, count, above AS m_Z_all_count_above_mode, {_round('100 * above::DOUBLE / low')} AS m_Z_all_cover_above_mode,
      {_round('100 * above::DOUBLE / first')} AS m_Z_all_1st_cover_above_mode FROM a""",
}
