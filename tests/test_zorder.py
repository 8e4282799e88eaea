"""Z-order: keys, box decomposition, results, and row groups that a box touches."""

import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from locus.sources import zorder


def interleaved(cells, bits):
    return sum((c >> i & 1) << (i * len(cells) + d) for d, c in enumerate(cells) for i in range(bits))


@pytest.mark.parametrize("dims, bits", [(2, 5), (3, 3)])
def test_ranges_cover_a_box(dims, bits):
    rng = random.Random(dims)
    for most in (8, 64, 100_000):
        for _ in range(30):
            low = [rng.randrange(1 << bits) for _ in range(dims)]
            high = [rng.randrange(w, 1 << bits) for w in low]
            spans = zorder.ranges(low, high, bits, most)
            inside = set()
            for n in range((1 << bits) ** dims):
                cells = [n >> (bits * d) & ((1 << bits) - 1) for d in range(dims)]
                if all(w <= c <= h for c, w, h in zip(cells, low, high, strict=True)):
                    inside.add(interleaved(cells, bits))
            covered = {k for a, b in spans for k in range(a, b + 1)}
            assert inside <= covered and (most < 100_000 or inside == covered)
            assert all(b < c for (_, b), (c, _) in zip(spans, spans[1:])) and len(spans) <= most + 4


@pytest.fixture(scope="module")
def points(spark):
    rng = random.Random(2)
    rows = [(k, rng.uniform(-5, 105), rng.gauss(50, 20), rng.randrange(1000)) for k in range(20_000)] + [(20_000, None, 5.0, 1), (20_001, 3.0, None, 2), (20_002, 1e9, -1e9, 3)]
    return spark.createDataFrame(rows, "id long, x double, y double, w int").repartition(4)


def test_boxes(spark, points, tmp_path):
    zorder.write(points, str(tmp_path), {"x": (0, 100), "y": (0, 100)}, bits=8)
    for box in ({"x": (10, 20), "y": (40, 45.5)}, {"x": (90, 1e12)}, {"y": (-1e12, 10)}, {"x": (3, 3)}, {}, {"x": (-100, 200), "y": (-100, 200)}):
        got = sorted(r.id for r in zorder.in_box(spark, str(tmp_path), **box).collect())
        want = points
        for name, (a, b) in box.items():
            want = want.where((F.col(name) >= a) & (F.col(name) < b))
        assert got == sorted(r.id for r in want.collect())


def groups_touched(folder, box):
    """Row groups whose statistics let the box pass, and all of them."""
    touched = total = 0
    for file in folder.glob("*.parquet"):
        meta = pq.ParquetFile(file).metadata
        names = [meta.schema.column(c).name for c in range(meta.num_columns)]
        for g in range(meta.num_row_groups):
            total += 1
            stats = {n: meta.row_group(g).column(names.index(n)).statistics for n in box}
            touched += all(s.min < b and s.max >= a for n, (a, b) in box.items() if (s := stats[n]))
    return touched, total


def test_a_box_touches_few_row_groups(spark, points, tmp_path):
    whole = points.where("x is not null and y is not null and abs(x) < 1e6")
    zorder.write(whole, str(tmp_path / "z"), {"x": (0, 100), "y": (0, 100)}, bits=8, files=4, rows_a_group=250)
    whole.repartition(4).write.option("parquet.block.row.count.limit", 250).parquet(str(tmp_path / "plain"))
    whole.repartitionByRange(4, "x").sortWithinPartitions("x").write.option("parquet.block.row.count.limit", 250).parquet(str(tmp_path / "by_x"))
    box = {"x": (20, 30), "y": (50, 60)}
    (z, total), (plain, all_plain), (by_x, _) = groups_touched(tmp_path / "z" / "points", box), groups_touched(tmp_path / "plain", box), groups_touched(tmp_path / "by_x", box)
    assert total >= 60 and plain == all_plain and z < total / 6 and z < plain / 6
    narrow = {"y": (50, 51)}
    assert groups_touched(tmp_path / "z" / "points", narrow)[0] < groups_touched(tmp_path / "by_x", narrow)[0] / 2
    plan = zorder.in_box(spark, str(tmp_path / "z"), **box)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(x), IsNotNull(y), Or(" in plan and "z#" in plan.split("DataFilters: [")[1]
