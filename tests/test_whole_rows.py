"""Queries that return every row of their tables, or all that belongs to a row."""

from locus import registry
from locus.operators import variants
from tests.test_queries import FOLDER


def test_merge_returns_every_row_in_order(spark):
    got = [tuple(r) for r in registry.kway_merge_whole(spark, FOLDER).select("reference_id", "position", "l_orderkey", "l_linenumber").collect()]
    assert len(got) == registry.P.reads(spark, FOLDER).count() and got == sorted(got)


def test_merge_keeps_rows_of_odd_places(spark, tmp_path):
    lines = registry.P.table(spark, FOLDER, "lineitem").limit(3)
    for place in ("-l_partkey - 1", "cast(null as long)", "l_partkey"):
        lines.selectExpr(*(f"{place} AS l_partkey" if c == "l_partkey" else c for c in lines.columns)).write.mode("append").parquet(str(tmp_path / "lineitem.parquet"))
    assert registry.kway_merge_whole(spark, str(tmp_path)).count() == 9


def test_one_row_holds_all_carriers_of_a_place(spark):
    calls = spark.createDataFrame([(s, 7, 1 + s % 2) for s in range(100)] + [(3, 7, 1), (5, 7, 0), (5, 8, 0), (5, 9, 1)], "sample long, position long, dosage int")
    want = {7: ",".join(f"{s}:{1 + s % 2}" for s in range(100)), 9: "5:1"}
    assert {r.position: r.carriers for r in variants.merged_genotypes(calls).collect()} == want
    blocks = sorted(map(tuple, variants.merged_genotypes(calls.where("position = 7"), 50).select("block", "carriers").collect()))
    assert [k for k, _ in blocks] == [0, 1] and ",".join(c for _, c in blocks) == want[7]
    whole = registry.merged_genotypes(spark, FOLDER)
    assert whole.count() == whole.select("position").distinct().count()
