"""Interval joins against plain Python: every length, touching ends, points, negative places, hot places."""

import random

from pyspark.sql import functions as F

from locus.operators import intervals


def rows_of(seed, n, references="xy"):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        start = rng.choice([rng.randrange(-3000, 300_000), rng.randrange(0, 3000), 256 * rng.randrange(0, 40)])
        out.append((k, rng.choice(references), start, start + rng.choice([0, 1, 2, 255, 256, 257, rng.randrange(1, 5000), 2048, 2049, rng.randrange(1, 400_000), 1 << 33, 1 << 50])))
    return out + [(n, None, 0, 10), (n + 1, "x", None, 10), (n + 2, "x", 0, None)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, reference string, start long, end long")


def pairs(spark, a, b, **more):
    out = intervals.overlap_join(frame(spark, a), frame(spark, b), "reference", ("start", "end"), ("start", "end"), **more)
    return sorted(map(tuple, out.select("left.id", "right.id").collect()))


def brute(a, b):
    return sorted((x[0], y[0]) for x in a for y in b if None not in x and None not in y and x[1] == y[1] and x[2] < x[3] and y[2] < y[3] and max(x[2], y[2]) < min(x[3], y[3]))


def test_every_pair_once(spark):
    a, b = rows_of(1, 250), rows_of(2, 250)
    want = brute(a, b)
    assert pairs(spark, a, b) == want == pairs(spark, a, b, salts=3) and len(want) > 2000
    assert pairs(spark, a, []) == [] == pairs(spark, [], b)


def test_points_and_repeated_rows(spark):
    a, b = rows_of(3, 150), [(k, "x", p, None) for k, p in enumerate(range(-500, 300_000, 1777))] * 2
    out = intervals.overlap_join(frame(spark, b), frame(spark, a), "reference", ("start", None), ("start", "end"))
    want = sorted((y[0], x[0]) for x in a for y in b if None not in x and x[1] == "x" and x[2] <= y[2] < x[3])
    assert sorted(map(tuple, out.select("left.id", "right.id").collect())) == want


def test_a_row_stays_bounded_by_the_levels(spark):
    long = frame(spark, [(1, "x", 5, 1 << 55), (2, "x", 5, 6)])
    side = intervals._side(long, "reference", "start", "end", "left")
    placed = intervals._placed(side, "left", list(range(intervals.LEVELS)), 0, True)
    counts = {r.id: r["count"] for r in placed.groupBy(F.col("left.id").alias("id")).count().collect()}
    assert counts[1] <= 6 and counts[2] <= 2 * intervals.LEVELS + 2


def test_hot_place_is_split(spark):
    # One place holds most rows of both sides: adaptive execution splits its bin.
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8k", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        rng = random.Random(6)
        a = [(k, "x", 1000 if k % 3 else rng.randrange(10**6), None) for k in range(20_000)]
        b = [(k, "x", s := rng.randrange(10**6), s + 500) for k in range(60)] + [(99, "x", 990, 1010), (100, "x", 0, 1 << 40)]
        out = intervals.overlap_join(frame(spark, a).repartition(8), frame(spark, b), "reference", ("start", None), ("start", "end"))
        got = out.groupBy("right.id").count().collect()
        want = {y[0]: n for y in b if (n := sum(y[2] <= x[2] < y[3] for x in a))}
        assert {r.id: r["count"] for r in got} == want
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_totals_without_pairs(spark):
    a, b = rows_of(7, 250), rows_of(8, 250)
    each = {}
    for x, y in ((x, y) for x in a for y in b if None not in x and None not in y):
        if x[1] == y[1] and y[2] < y[3] and x[2] < y[3] and x[3] > y[2]:
            n, shared = each.get(y[0], (0, 0))
            each[y[0]] = (n + 1, shared + min(x[3], y[3]) - max(x[2], y[2]))
    got = intervals.overlap_totals(frame(spark, a), frame(spark, b), "reference", ("start", "end"), ("start", "end"))
    assert {r.id: (r.rows, r.shared) for r in got.select("right.id", "rows", "shared").collect()} == each and len(each) > 150
    starts = {y[0]: n for y in b if None not in y and (n := sum(None not in x[1:3] and x[1] == y[1] and y[2] <= x[2] < y[3] for x in a))}
    got = intervals.overlap_totals(frame(spark, a), frame(spark, b), "reference", ("start", None), ("start", "end"))
    assert {r.id: r.rows for r in got.select("right.id", "rows").collect()} == starts


def test_a_long_interval_is_not_paired_with_every_row(spark):
    rows = spark.range(50_000).selectExpr("id", "'x' AS reference", "id % 5000 AS start", "id % 5000 + 7 AS end")
    wide = spark.range(2000).selectExpr("id", "'x' AS reference", "id AS start", "id + 1000000000 AS end")
    out = intervals.overlap_totals(rows, wide, "reference", ("start", "end"), ("start", "end"))
    got = {r.id: (r.rows, r.shared) for r in out.select("right.id", "rows", "shared").collect()}
    assert len(got) == 2000 and got[0] == (50_000, 350_000) and got[1999] == (50_000 - 10 * 1993, 10 * sum(min(7, p + 7 - 1999) for p in range(1993, 5000)))
