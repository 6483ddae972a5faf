"""On line items whose parts and suppliers lie beyond the frame of the SQL, too: its cells are all there, unchanged."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from stratagrid.grid import Rect
from stratagrid.operators import relational

SF = "/root/testdata/sf0.001"
TENTH = "/root/testdata/sf0.1/lineitem.parquet"
#: Their box lies inside the frame of the SQL, so nothing is added to it.
BOXED = ["dense_cells", "raster", "store_in_box", "store_extract"]
#: A row for each cell; the query has cells beyond the frame besides.
BY_CELL = ["cell_indices", "cell_lists", "date_overlap", "dense_grid", "grid_core", "grid_preset", "latest_cells", "metrics_compat", "metrics_counts", "metrics_covers", "metrics_deviations", "metrics_l_moments", "metrics_percentiles", "number_of_returns", "points_above_own_mean", "time_travel", "unfinished_cells", "user_metric", "store_cells", "store_by_date", "store_resumed", "store_published", "store_shards", "shard_points", "store_union"]


@pytest.fixture(scope="module")
def larger(tmp_path_factory):
    path = tmp_path_factory.mktemp("larger")
    rows = f"SELECT l.* REPLACE (l_orderkey + k * 1000000 AS l_orderkey, l_partkey + k * 20000 AS l_partkey, l_suppkey + k * 1000 AS l_suppkey) FROM range(3) t(k), '{SF}/lineitem.parquet' l"
    duckdb.execute(f"COPY ({rows}) TO '{path}/lineitem.parquet' (FORMAT parquet)")
    return str(path)


def both(spark, name, path):
    """Rows that only the query has, only its SQL has, and both have."""
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS FROM '{path}/lineitem.parquet'")
    want = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in want.description]
    want = want.fetchall()
    found = [tuple(r) for r in entry.queries()[name](spark, path).select(*names).collect()]
    assert len(set(found)) == len(found)
    return set(found) - set(want), set(want) - set(found), set(found) & set(want)


@pytest.mark.parametrize("name", BOXED)
def test_equals_sql_in_its_box(spark, larger, name):
    more, less, _ = both(spark, name, larger)
    assert not more and not less


@pytest.mark.parametrize("name", BY_CELL)
def test_has_all_cells_of_the_sql(spark, larger, name):
    more, less, same = both(spark, name, larger)
    assert same and not less
    assert bool(more) == (name not in ("store_by_date", "store_published"))  # whose run has western points only


def test_values_even_about_the_mean_have_no_skewness(spark, tmp_path):
    places = "(VALUES (53, 151), (69, 125), (121, 65)) AS c(x, y)"
    duckdb.execute(f"COPY (SELECT l.* FROM '{TENTH}' l, {places} WHERE l_partkey // 100 = x AND l_suppkey // 5 = 199 - y) TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)")
    more, less, same = both(spark, "metrics_product_moments", str(tmp_path))
    assert not more and not less and len(same) == 3


def shuffled_rows(spark):
    store, jvm = spark.sparkContext._jsc.sc().statusStore(), spark._jvm
    none = jvm.java.lang.reflect.Array.newInstance(jvm.java.lang.Double.TYPE, 0)
    stages = store.stageList(None, False, False, none, None)
    return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))


def test_rasters_shuffle_only_cells_with_data(spark):
    """Of a grid of 400 x 300 cells, 7 have a point, one twice and one outside."""
    rect = Rect(-100, 300, -50, 250)
    rows = [(-100, -50, 1.0), (-99, -50, 2.0), (299, -50, 3.0), (5, 0, None), (7, 0, 4.0), (7, 0, 5.0), (299, 249, 6.0), (300, 10, 9.0)]
    cells = spark.createDataFrame(rows, "X int, Y int, v double").withColumn("n", F.lit(1).cast("long"))
    inside = rows[:-1]
    held = {(x, y) for x, y, _ in inside}
    want = sorted([(x, y, -1.0 if v is None else v, 1) for x, y, v in inside] + [(x, y, -1.0, None) for x, y in rect.indices() if (x, y) not in held], key=lambda r: r[:3])
    before = shuffled_rows(spark)
    dense = relational.densify(cells, rect, {"v": -1.0})
    assert dense.columns == ["X", "Y", "v", "n"]
    assert sorted(map(tuple, dense.collect()), key=lambda r: r[:3]) == want
    found = {r.Y: r.v for r in relational.raster_rows(cells, "v", rect, -1.0).collect()}
    assert found == {y: [v for _, b, v, _ in want if b == y] for y in range(-50, 250)}
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    assert shuffled_rows(spark) - before < 2 * (300 + len(rows)) + 50
    empty = {r.Y: r.v for r in relational.raster_rows(cells, "v", Rect(100, 103, 0, 2)).collect()}
    assert empty == {0: [None] * 3, 1: [None] * 3}
