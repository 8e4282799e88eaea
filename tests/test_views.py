"""Layouts and comparisons whose work does not grow with the number of samples or sides."""

from pathlib import Path

from locus.operators import regions
from locus.sources import dataset


def test_views_have_no_folder_for_each_sample(spark, tmp_path):
    rows = spark.range(20_000).selectExpr("id % 500 AS sample", "id AS position")
    dataset.write_views(rows, str(tmp_path), "sample", "position")
    assert len(list(Path(tmp_path, "by_sample").rglob("*.parquet"))) <= 8
    own = dataset.read_view(spark, str(tmp_path), "sample").where("sample = 3")
    assert "EqualTo(sample,3)" in own._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.position for r in own.collect()) == list(range(3, 20_000, 500))
    assert dataset.read_view(spark, str(tmp_path), "position").where("position < 7").count() == 7


def test_differences_are_counted_in_one_pass(spark):
    left = spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (3, "c"), (None, "d")], "`k.x` int, v string")
    right = spark.createDataFrame([(1, "a"), (2, None), (2, None), (2, None), (4, "e"), (None, "d")], "`k.x` int, v string")
    out = regions.difference(left, right)
    assert sorted(map(tuple, out.collect()), key=repr) == sorted([(1, "a", "left"), (3, "c", "left"), (2, None, "right"), (2, None, "right"), (4, "e", "right")], key=repr)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 2
    assert regions.difference(left, left).count() == 0
