"""On line items beyond the frame of the SQL: a query has every row of its SQL with the clip taken out, and no other.
So it differs from the SQL as it is by the points that this drops, and by nothing else."""

from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.01"
CLIP = " WHERE X >= 0 AND X < 20000 AND Y >= 0 AND Y < 20000"
WHOLE = [
    "dense_cells",
    "cell_lists",
    "date_overlap",
    "dense_grid",
    "grid_core",
    "latest_cells",
    "metrics_compat",
    "metrics_counts",
    "metrics_covers",
    "metrics_deviations",
    "metrics_l_moments",
]


@pytest.fixture(scope="module")
def apart(tmp_path_factory):
    """Three copies, the second one frame east and two north, the third two east and one north."""
    path = tmp_path_factory.mktemp("apart")
    rows = f"SELECT l.* REPLACE (l_orderkey + k * 1000000 AS l_orderkey, l_partkey + k * 20000 AS l_partkey, l_suppkey + k * 2 % 3 * 1000 AS l_suppkey) FROM range(3) t(k), '{SF}/lineitem.parquet' l"
    duckdb.execute(f"COPY ({rows}) TO '{path}/lineitem.parquet' (FORMAT parquet)")
    return str(path)


def unclipped(name):
    """The SQL so; where it lists cells, as far as the points of apart lie."""
    sql = entry.oracle_sql()[name]
    assert sql.count(CLIP) == 1
    x, y = ("(SELECT unnest(range({}, {})) AS i) " + k for k in "xy")
    if name == "dense_grid":
        assert x.format(0, 200) in sql and y.format(0, 200) in sql
        sql = sql.replace(x.format(0, 200), x.format(0, 420)).replace(y.format(0, 200), y.format(-220, 200))
    return sql.replace(CLIP, "")


@pytest.mark.parametrize("name", WHOLE)
def test_equals_sql_without_its_clip(spark, apart, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS FROM '{apart}/lineitem.parquet'")
    want = con.execute(unclipped(name))
    names = [d[0] for d in want.description]
    found = entry.queries()[name](spark, apart)
    assert sorted(found.columns) == sorted(names)
    assert Counter(map(tuple, found.select(*names).collect())) == Counter(want.fetchall())
