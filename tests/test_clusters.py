"""Clustered vectors: exact searches equal brute force, probing is measured, clusters are read alone."""

import math
import random

from pyspark.sql import functions as F

from locus.sources import clusters


def vectors(n=1500, dims=8, seed=3):
    rng = random.Random(seed)
    centres = [[rng.uniform(-10, 10) for _ in range(dims)] for _ in range(12)]
    rows = [(k, [x + rng.gauss(0, 1) for x in rng.choice(centres)]) for k in range(n)]
    return rows + [(n + k, list(rows[0][1])) for k in range(30)] + [(5000, None), (5001, [math.nan] * dims), (5002, [1.0]), (None, rows[1][1])]


def brute(rows, queries, n, dims=8):
    own = [(i, v) for i, v in rows if i is not None and v is not None and len(v) == dims and all(map(math.isfinite, v))]
    return {(q, k): i for q, v in queries for k, (_, i) in enumerate(sorted((math.sqrt(sum((a - b) ** 2 for a, b in zip(v, w))), i) for i, w in own)[:n], 1)}


def test_search(spark, tmp_path):
    rows, path = vectors(), str(tmp_path)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    clusters.write(frame, path, 16, rounds=5)
    sizes = spark.read.parquet(f"{path}/clusters")
    assert sizes.agg(F.sum("size")).first()[0] == 1530 and 8 <= sizes.count() <= 16
    queries = [(i, v) for i, v in rows[:1500:50]] + [(9000, [0.0] * 8), (9001, [50.0] * 8)]
    asked = spark.createDataFrame(queries, "query_id long, embedding array<double>")
    exact = clusters.search(spark, path, asked, 10, 2, exact=True)
    assert {(r.query_id, r.rank): r.vec_id for r in exact.collect()} == brute(rows, queries, 10)
    probed = clusters.search(spark, path, asked, 10, 2)
    assert probed.count() <= exact.count() and clusters.recall(probed, exact).first().recall >= 0.9
    assert clusters.recall(clusters.search(spark, path, asked, 10, 16), exact).first().recall == 1
    # More wanted than the probed clusters hold.
    few = clusters.search(spark, path, asked.where("query_id = 9001"), 1525, 1, exact=True)
    assert few.count() == 1525 and {(r.query_id, r.rank): r.vec_id for r in few.where("rank > 1400").collect()}.items() <= brute(rows, [queries[-1]], 1525).items()


def test_means_move_towards_the_clusters(spark):
    frame = spark.createDataFrame(vectors(), "vec_id long, embedding array<double>")
    usable = clusters._usable(frame).where(F.size("embedding") == 8)

    def spread(centres):
        return sum(min(sum((a - b) ** 2 for a, b in zip(r.embedding, c)) for c in centres.tolist()) for r in usable.collect())

    assert spread(clusters.kmeans(frame, 12, 6)) < 0.7 * spread(clusters.kmeans(frame, 12, 0))
    assert clusters.kmeans(frame.limit(0), 5).shape == (0, 0) and len(clusters.kmeans(frame.where("vec_id >= 1500 and vec_id < 1530"), 5, 2)) == 1


def test_nothing_stored(spark, tmp_path):
    frame = spark.createDataFrame([], "vec_id long, embedding array<double>")
    clusters.write(frame, str(tmp_path), 4)
    asked = spark.createDataFrame([(1, [1.0])], "query_id long, embedding array<double>")
    assert clusters.search(spark, str(tmp_path), asked, 3, 2, exact=True).count() == 0


def test_blocks_of_a_cluster_agree_with_brute_force(spark, tmp_path, monkeypatch):
    """Many small blocks, ties at every place, far from the origin: every pair counts, none is told twice."""
    monkeypatch.setattr(clusters, "BLOCK", 7)
    monkeypatch.setattr(clusters, "ASKING", 3)
    rows = [(k, [float(1_000_000 + k % 5), float(k % 7), float(k % 3)]) for k in range(300)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    clusters.write(vectors, str(tmp_path), 3, rounds=2)
    got = clusters.search(spark, str(tmp_path), vectors.where("vec_id % 10 = 0").withColumnRenamed("vec_id", "query_id"), 9, 1, exact=True)
    want = {(q, r + 1): v for q, e in rows if q % 10 == 0 for r, (_, v) in enumerate(sorted((sum((a - b) ** 2 for a, b in zip(e, f)), v) for v, f in rows)[:9])}
    assert {(r.query_id, r.rank): r.vec_id for r in got.collect()} == want


def test_queries_meet_a_cluster_by_blocks(spark, tmp_path):
    assert clusters.BLOCK * clusters.ASKING < 1 << 20  # distances that a task holds at once
    rows = [(k, [float(k % 11), float(k % 13)]) for k in range(200)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    clusters.write(vectors, str(tmp_path), 2, rounds=1)
    asked = clusters._asked(spark, str(tmp_path), vectors.withColumnRenamed("vec_id", "query_id"))
    assert "MapInArrow" in clusters._nearest(spark, str(tmp_path), asked, 3)._jdf.queryExecution().toString()
