"""Adaptive chunks and sketches: balance, pruning, merging."""

import random

from pyspark.sql import functions as F

from locus.operators.regions import Region
from locus.plans import sketches
from locus.sources import adaptive


def dense_rows(spark, n=30_000, seed=4):
    rng = random.Random(seed)
    rows = [("x" if k % 5 else "y", int(rng.expovariate(1) * 40_000) if k % 3 else rng.randrange(-500, 400_000), rng.randint(1, 90), k) for k in range(n)]
    rows += [("z", 7, 5, k) for k in range(4000)] + [("w", 1, 1, 0), (None, 5, 1, 1), ("x", None, 1, 2)]
    return spark.createDataFrame(rows, "reference string, position long, span int, id long").repartition(6)


def test_chunks_are_even_and_cover_all(spark, monkeypatch):
    monkeypatch.setattr(adaptive, "FAN", 5)  # several passes
    rows = dense_rows(spark)
    chunks = adaptive.chunk_map(rows, 500).collect()
    for reference in "xy":
        own = sorted((r.start, r.end, r.rows) for r in chunks if r.reference == reference)
        assert own[0][0] == -(1 << 62) and own[-1][1] == 1 << 62 and all(a[1] == b[0] for a, b in zip(own, own[1:]))
        sizes = [r[2] for r in own]
        assert max(sizes) <= 2 * 500 and max(sizes) <= 4 * min(sizes)
    monkeypatch.undo()
    even = {}
    for r in adaptive.chunk_map(rows, 500).collect():
        even.setdefault(r.reference, []).append(r.rows)
    assert all(max(even[k]) <= 2 * min(even[k]) for k in "xy") and even["z"] == [4000] and even["w"] == [1]
    assert sum(map(sum, even.values())) == rows.where("reference is not null and position is not null").count()


def test_regions_prune_by_the_map(spark, tmp_path):
    rows, path = dense_rows(spark), str(tmp_path)
    adaptive.write(rows, path, 500)
    assert adaptive.read(spark, path).count() == rows.count()
    for region in (Region("x", 1000, 3000), Region("x", -600, 0), Region("y", 200_000, None), Region("z"), Region("nowhere"), Region("x", 10**9, 10**9 + 5)):
        for mode in ("start", "overlap"):
            got = adaptive.query(spark, path, region, mode)
            low = (F.col("position") + F.col("span") > region.start) if mode == "overlap" else F.col("position") >= region.start
            want = rows.where((F.col("reference") == region.reference) & low & (F.col("position") < (1 << 60 if region.end is None else region.end)))
            assert sorted(r.id for r in got.select("id").collect()) == sorted(r.id for r in want.select("id").collect())
    near = adaptive.query(spark, path, Region("x", 1000, 3000))
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "chunk_start" in plan.split("PartitionFilters: [")[1].split("]")[0]
    files = near.select(F.input_file_name()).distinct().count()
    assert 0 < files <= adaptive.chunks_of(spark, path, Region("x", 1000, 3000)).count() < adaptive.read_map(spark, path).count() / 5


def test_sketches_merge_over_batches_and_groups(spark):
    rows = dense_rows(spark).where("reference in ('x', 'y')")
    parts = [sketches.build(rows.where(F.col("id") % 3 == k), ["reference"], ["id", "position"], ["position"]) for k in range(3)]
    merged = sketches.merge(parts[0].unionByName(parts[1]).unionByName(parts[2]), [])
    got = sketches.read_off(merged, {"position": [0.1, 0.5, 0.9]}).first()
    exact = rows.agg(F.count("*"), F.count_distinct("id"), F.count_distinct("position")).first()
    assert got.rows == exact[0] and abs(got.id_distinct - exact[1]) < 0.02 * exact[1] and abs(got.position_distinct - exact[2]) < 0.02 * exact[2]
    for rank, value in ((0.1, got.position_p10), (0.5, got.position_p50), (0.9, got.position_p90)):
        assert abs(rows.where(F.col("position") <= value).count() / exact[0] - rank) < 0.01
    by = {r.reference: r.rows for r in sketches.merge(parts[0].unionByName(parts[1]), ["reference"]).collect()}
    assert by == {r.reference: r["count"] for r in rows.where("id % 3 < 2").groupBy("reference").count().collect()}


def test_grouping_sets(spark):
    rows = spark.createDataFrame([("a", 1, "p"), ("a", 2, "p"), ("b", 1, "q")], "x string, y int, z string")
    got = {(r.x, r.y, r.grouped): (r.rows, r.z_distinct) for r in sketches.rolled_up(rows, [["x"], ["y"], []], ["z"]).collect()}
    assert got == {("a", None, 1): (2, 1), ("b", None, 1): (1, 1), (None, 1, 2): (2, 2), (None, 2, 2): (1, 1), (None, None, 3): (3, 2)}
