import pytest

from stratagrid.llm import shared


def test_tables_are_kept_apart_and_cleared(spark):
    a, b = (shared.materialise(spark.range(n).toDF("x"), "t") for n in (2, 3))
    assert (a.count(), b.count()) == (2, 3) and a.columns == ["x"]
    assert shared.shared_dir(spark).startswith(spark.conf.get("spark.checkpoint.dir"))
    shared.clear(spark)
    assert shared.materialise(spark.range(4).toDF("x"), "t").count() == 4


def test_words(spark):
    rows = spark.createDataFrame([("a  b\tc\n d\r\n\x0b\x0c e",), ("",), (" ",), (None,), ("é x y",)], "t string")
    t = shared.text_or_empty("t")
    got = rows.select(shared.words_of(t), shared.n_words_of(t)).collect()
    assert [r[0] for r in got] == [["a", "b", "c", "d", "e"], [], [], [], ["é x", "y"]] and [r[1] for r in got] == [5, 0, 0, 0, 2]


def test_free_name(spark):
    assert shared.free_name(spark.createDataFrame([(1, 2)], "A int, _a int"), "a", "b") == ["__a", "b"]


def test_rows_of_hot_keys_are_spread(spark, monkeypatch):
    monkeypatch.setattr(shared, "PARTS", 8)
    monkeypatch.setattr(shared, "LEAST", 2)
    rows = [(k, i) for i, k in enumerate(["hot"] * 300 + [f"k{i % 150}" for i in range(300)])]
    left = spark.createDataFrame(rows, "key string, salt int")
    right = spark.createDataFrame([("hot", "a", 1), ("hot", "b", 2), ("k1", "c", 3), ("none", "d", 4)], "key string, what string, salts int")
    counts = left.groupBy("key").count().withColumnRenamed("count", "n")
    for how in ("inner", "left", "left_semi"):
        want = left.join(right, "key", how)
        got = shared.spread_join(left, right, ["key"], counts, how)
        assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert "_salt" in shared.spread_join(left, right, ["key"], counts)._jdf.queryExecution().toString()


def test_no_folder_of_one_machine_on_a_cluster():
    class Session:
        class conf:
            get = staticmethod(lambda name, default: None)

        class sparkContext:
            master = "spark://somewhere"

    with pytest.raises(ValueError):
        shared.shared_dir(Session)
