"""On line items inside the frame of the SQL, but with missing and odd values: queries equal their SQL as it is."""

from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.01"


def chance(column, one_in):
    return f"hash('{column}', l_orderkey, l_linenumber, l_partkey) % {one_in} = 0"


def missing(column, one_in):
    return f"CASE WHEN {chance(column, one_in)} THEN NULL ELSE {column} END AS {column}"


#: Nulls in every column that a point has, many enough for cells without any value.
NULLS = ", ".join(missing(c, n) for c, n in (("l_quantity", 2), ("l_linenumber", 2), ("l_shipdate", 3), ("l_partkey", 50), ("l_suppkey", 50)))
#: Heights that no sum or difference gets rid of.
ENDLESS = f"CASE WHEN {chance('nan', 7)} THEN 'nan'::DOUBLE WHEN {chance('inf', 7)} THEN 'inf'::DOUBLE ELSE l_quantity END AS l_quantity"


def same(spark, name, path, replaced, but=()):
    """Both sides' rows are equal, compared as text, since no NaN equals another. Returns the values of each column."""
    # So few points that cells have one or several.
    duckdb.execute(f"COPY (SELECT l.* REPLACE ({replaced}) FROM '{SF}/lineitem.parquet' l WHERE l_orderkey % 40 = 0) TO '{path}/lineitem.parquet' (FORMAT parquet)")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS FROM '{path}/lineitem.parquet'")
    want = con.sql(entry.oracle_sql()[name])
    names = [c for c in want.columns if c not in but]
    want = want.project(", ".join(f'"{n}"' for n in names)).fetchall()
    found = entry.queries()[name](spark, str(path)).select(*names).collect()
    assert Counter(repr(tuple(r)) for r in found) == Counter(map(repr, want))
    return {n: [r[k] for r in want] for k, n in enumerate(names)}


def test_lists_of_points_without_values(spark, tmp_path):
    rows = same(spark, "cell_lists", tmp_path, NULLS)
    assert None in rows["returns"] and any(0 < z < n for z, n in zip(rows["n_z"], rows["count"]))


def test_median_beside_endless_heights(spark, tmp_path):
    rows = same(spark, "grid_core", tmp_path, ENDLESS)
    assert sum(abs(v) < float("inf") and not top < float("inf") for v, top in zip(rows["m_Z_median"], rows["m_Z_max"])) > 50


def test_counts_of_first_returns_without_heights(spark, tmp_path):
    """Points without a height are points, none of which lies above."""
    rows = same(spark, "metrics_counts", tmp_path, NULLS)
    for above in ("m_Z_1st_count_above_mean", "m_Z_1st_count_above_mode"):
        assert 0 in rows[above] and None in rows[above]


def test_covers_of_first_returns_without_heights(spark, tmp_path):
    rows = same(spark, "metrics_covers", tmp_path, NULLS)
    for above in ("m_Z_1st_cover_above_mean", "m_Z_1st_cover_above_mode"):
        assert any(v is not None and abs(v) < 1e-6 for v in rows[above]) and None in rows[above]


def test_median_distance_beside_endless_heights(spark, tmp_path):
    """A mode of such heights is null here, as there are no bins for them; the SQL calls it NaN."""
    rows = same(spark, "metrics_deviations", tmp_path, ENDLESS, but=["m_Z_mad_mode"])
    assert sum(v is not None and abs(v) < float("inf") and m != m for v, m in zip(rows["m_Z_mad_median"], rows["m_Z_mad_mean"])) > 10
