"""Vectors stored by cluster, and searches that read the nearest clusters only.

k-means rounds: every task assigns its vectors to the nearest of the k centroids (a
table of k vectors, bounded by k, goes to the tasks) and adds them up by cluster, so a
round shuffles k sums a task.  The vectors are then written in a folder for each
cluster, and beside them each cluster's centroid and radius.

A search asks the ``probe`` clusters with the nearest centroids.  With ``exact`` it
then also reads every other cluster that may still hold something nearer: no vector of
a cluster is nearer than the distance to its centroid less its radius.  recall() tells
what a search that only probes has found of the exact result.

Distances are Euclidean; ties go to the smaller id.  Null vectors, and vectors with
null or non-finite components or of another length than most, take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from locus.sources.shared import materialised, scratch

#: Vectors that meet the centroids at once; vectors and queries of a block in a search.
STEP, BLOCK, ASKING = 4096, 1024, 256


def _usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding (array of double) of the vectors that take part."""
    fine = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & fine & (F.size("embedding") > 0)).select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy().reshape(len(column), -1)


def _squared(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)[None], 0)


def kmeans(vectors: DataFrame, k: int, rounds: int = 8) -> np.ndarray:
    """k centroids, or as many as there are distinct vectors: at first the vectors with the least hashes, then the means of what is nearest to each; one that nothing is near stays."""
    with scratch(vectors.sparkSession) as folder:
        rows = materialised(_usable(vectors), folder)
        dims = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
        if dims is None:
            return np.zeros((0, 0))
        rows = rows.where(F.size("embedding") == dims.d)
        first = rows.select("embedding", F.xxhash64("embedding").alias("h")).distinct().orderBy("h").limit(k).collect()
        centres = np.array([r.embedding for r in first])
        for _ in range(rounds):
            centres = _moved(rows, centres)
        return centres


def _moved(rows: DataFrame, centres: np.ndarray) -> np.ndarray:
    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros_like(centres), np.zeros(len(centres), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                x = _matrix(batch.column(0).slice(at, STEP))
                nearest = _squared(x, centres).argmin(1)
                np.add.at(sums, nearest, x)
                counts += np.bincount(nearest, minlength=len(centres))
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({"cluster": pa.array(used, pa.int32()), "n": pa.array(counts[used]), "total": pa.array(list(sums[used]), pa.list_(pa.float64()))})

    parts = rows.select("embedding").mapInArrow(summed, "cluster int, n long, total array<double>")
    by_place = parts.select("cluster", "n", F.posexplode("total").alias("d", "x")).groupBy("cluster", "d").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
    out = centres.copy()
    for r in by_place.collect():  # k vectors
        out[r.cluster, r.d] = r.x / r.n
    return out


def write(vectors: DataFrame, path: str, k: int, rounds: int = 8) -> None:
    """The vectors by cluster (cluster=<n>/), and the clusters' centroids, radii and sizes."""
    spark, centres = vectors.sparkSession, kmeans(vectors, k, rounds)
    dims = centres.shape[1]

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                part = batch.slice(at, STEP)
                squared = _squared(_matrix(part.column(1)), centres)
                nearest = squared.argmin(1)
                # The radius is what later rules clusters out: it is measured plainly, not by the expanded square.
                radius = np.sqrt(((_matrix(part.column(1)) - centres[nearest]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(nearest, pa.int32()), pa.array(radius)], ["vec_id", "embedding", "cluster", "away"])

    rows = _usable(vectors).where(F.size("embedding") == dims) if dims else _usable(vectors).where("false")
    out = rows.mapInArrow(placed, T.StructType([*rows.schema.fields, T.StructField("cluster", T.IntegerType()), T.StructField("away", T.DoubleType())]))
    out.hint("rebalance", "cluster").sortWithinPartitions("cluster", "away").write.mode("overwrite").partitionBy("cluster").parquet(f"{path}/vectors")
    named = spark.createDataFrame([(c, v.tolist()) for c, v in enumerate(centres)], "cluster int, centre array<double>")
    sizes = spark.read.schema("vec_id long, embedding array<double>, away double, cluster int").parquet(f"{path}/vectors").groupBy("cluster").agg(F.max("away").alias("radius"), F.count("*").alias("size"))
    named.join(sizes, "cluster").write.mode("overwrite").parquet(f"{path}/clusters")


def _asked(spark: SparkSession, path: str, queries: DataFrame) -> DataFrame:
    """query_id, query, cluster, radius, centre_away, place (1: the nearest) for each query and cluster; clusters are as many as k."""
    clusters = [r.asDict() for r in spark.read.parquet(f"{path}/clusters").select("cluster", "centre", "radius").orderBy("cluster").collect()]
    if not clusters:
        return queries.select("query_id", F.col("embedding").alias("query"), F.lit(0).alias("cluster"), F.lit(0.0).alias("radius"), F.lit(0.0).alias("centre_away"), F.lit(1).alias("place")).where("false")
    centres, radii, names = np.array([c["centre"] for c in clusters]), np.array([c["radius"] for c in clusters]), np.array([c["cluster"] for c in clusters], np.int32)

    def ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                away = np.sqrt(((_matrix(part.column(1))[:, None] - centres[None]) ** 2).sum(2))
                order = np.argsort(away, axis=1, kind="stable")
                n, k = order.shape
                row = pa.array(np.repeat(np.arange(n), k))
                flat = order.ravel()
                yield pa.RecordBatch.from_arrays([*(c.take(row) for c in part.columns), pa.array(names[flat]), pa.array(radii[flat]), pa.array(np.take_along_axis(away, order, 1).ravel()), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n))], ["query_id", "query", "cluster", "radius", "centre_away", "place"])

    given = _usable(queries.select(F.col("query_id").alias("vec_id"), "embedding")).where(F.size("embedding") == centres.shape[1]).toDF("query_id", "query")
    return given.mapInArrow(ordered, "query_id long, query array<double>, cluster int, radius double, centre_away double, place int")


def search(spark: SparkSession, path: str, queries: DataFrame, n: int, probe: int, exact: bool = False) -> DataFrame:
    """query_id, rank, vec_id, distance: of each query (query_id, embedding) the n nearest vectors in the probed clusters, or (exact) of all."""
    with scratch(spark) as folder:
        asked = materialised(_asked(spark, path, queries), folder)
        found = materialised(_nearest(spark, path, asked.where(F.col("place") <= probe), n), folder)
        if exact:
            # Of queries that have n already, only clusters that reach within the n-th distance; a little more, for rounding.
            bound = found.groupBy("query_id").agg(F.max("distance").alias("bound"), F.count("*").alias("have"))
            rest = asked.where(F.col("place") > probe).join(bound, "query_id", "left")
            near = (F.col("centre_away") - F.col("radius")) <= F.col("bound") * (1 + 1e-9) + 1e-9
            more = _nearest(spark, path, rest.where(F.col("have").isNull() | (F.col("have") < n) | near).select(asked.columns), n)
            found = _best(found.drop("rank").unionByName(more.drop("rank")), n)
        return materialised(found.select("query_id", "rank", "vec_id", "distance"))


def _best(found: DataFrame, n: int) -> DataFrame:
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "vec_id"))).where(F.col("rank") <= n)


def _blocks(rows: DataFrame, size: int, parts: DataFrame) -> DataFrame:
    """cluster, part, ids, flat: rows (id, v, cluster) packed into blocks of about size vectors of one cluster; parts: cluster, parts, the number of blocks of each."""
    dealt = rows.join(F.broadcast(parts), "cluster").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    packed = dealt.groupBy("cluster", "part").agg(F.collect_list(F.struct("id", "v")).alias("rows"))
    return packed.select("cluster", "part", F.col("rows.id").alias("ids"), F.flatten("rows.v").alias("flat"))


def _parts(rows: DataFrame, size: int) -> DataFrame:
    return rows.groupBy("cluster").agg(F.ceil(F.count("*") / size).cast("int").alias("parts"))


def _nearest(spark: SparkSession, path: str, asked: DataFrame, n: int) -> DataFrame:
    """query_id, vec_id, distance, rank of the n nearest in the clusters asked; a vector that cannot be within a cluster's reach is not excluded here, its distance decides.

    Blocks of a cluster's vectors meet blocks of the queries that ask for it, and of
    each two blocks only a query's n nearest go on.
    """
    vectors = spark.read.schema("vec_id long, embedding array<double>, away double, cluster int").parquet(f"{path}/vectors").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "cluster")
    queries = asked.select(F.col("query_id").alias("id"), F.col("query").alias("v"), "cluster")
    parts = _parts(vectors, BLOCK)
    held = _blocks(vectors, BLOCK, parts)
    asking = _blocks(queries, ASKING, _parts(queries, ASKING)).select("cluster", F.col("ids").alias("query_ids"), F.col("flat").alias("query_flat"))
    asking = asking.join(F.broadcast(parts), "cluster").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                query_ids, query_flat, ids, flat = (batch.column(k)[at].values.to_numpy(zero_copy_only=False) for k in range(4))
                x, q = flat.reshape(len(ids), -1), query_flat.reshape(len(query_ids), -1)
                about = _squared(q, x)
                # The expanded square only rules out what is farther by more than its rounding; the distances themselves are plain.
                kth = np.partition(about, min(n, len(ids)) - 1, axis=1)[:, min(n, len(ids)) - 1]
                slack = 1e-9 * ((q * q).sum(1) + (x * x).sum(1).max())
                row, column = np.nonzero(about <= (kth + slack)[:, None])
                away = np.concatenate([np.sqrt(((q[row[k : k + STEP]] - x[column[k : k + STEP]]) ** 2).sum(1)) for k in range(0, len(row), STEP)])
                order = np.lexsort((ids[column], away, row))
                row, column, away = row[order], column[order], away[order]
                place = np.arange(len(row)) - np.searchsorted(row, row)
                keep = place < n
                yield pa.RecordBatch.from_arrays([pa.array(query_ids[row[keep]]), pa.array(ids[column[keep]]), pa.array(away[keep])], ["query_id", "vec_id", "distance"])

    met = asking.join(held, ["cluster", "part"]).select("query_ids", "query_flat", "ids", "flat")
    return _best(met.mapInArrow(nearest, "query_id long, vec_id long, distance double"), n)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """wanted (results of the exact search), hit (of them found), recall."""
    both = exact.select("query_id", "vec_id").distinct().join(found.select("query_id", "vec_id", F.lit(True).alias("hit")).distinct(), ["query_id", "vec_id"], "left")
    return both.agg(F.count("*").alias("wanted"), F.count("hit").alias("hit")).withColumn("recall", F.try_divide("hit", "wanted"))
