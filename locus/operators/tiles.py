"""Tiles of N-dimensional coordinates, and vectors near centroids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_tiles(points: DataFrame, **sizes: int) -> DataFrame:
    """points with t_<column> = column div size for each given column."""
    return points.withColumns({f"t_{c}": F.expr(f"{c} div {n}") for c, n in sizes.items()})


def in_box(points: DataFrame, sizes: dict[str, int], **bounds: tuple[int, int]) -> DataFrame:
    """Points in the box of half-open bounds; the tile predicates prune, the others decide."""
    for c, (low, high) in bounds.items():
        points = points.where(F.col(f"t_{c}").between(low // sizes[c], (high - 1) // sizes[c])).where((F.col(c) >= low) & (F.col(c) < high))
    return points


def centroids(vectors: DataFrame) -> DataFrame:
    """label, centroid: the mean vector of each label."""
    parts = vectors.select("label", F.posexplode("embedding").alias("d", "x")).groupBy("label", "d").agg(F.avg("x").alias("x"))
    return parts.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("d", "x"))).alias("c")).select("label", F.col("c.x").alias("centroid"))


def nearest_centroid(vectors: DataFrame, centres: DataFrame, block: int = 256) -> DataFrame:
    """vec_id, label, distance to the nearest centroid (ties: the smaller label); the centroids, one a label, come in blocks that each vector meets by number."""
    blocks = max(1, -(-centres.count() // block))
    numbered = centres.select("label", "centroid", F.pmod(F.xxhash64("label"), F.lit(blocks)).cast("int").alias("block"))
    packed = numbered.groupBy("block").agg(F.collect_list(F.struct("label", "centroid")).alias("all"))
    squared = F.transform("all", lambda c: F.struct(F.aggregate(F.zip_with("embedding", c["centroid"], lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v).alias("d"), c["label"].alias("label")))
    met = vectors.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(packed, "block").select("vec_id", F.array_min(squared).alias("best"))
    best = met if blocks == 1 else met.groupBy("vec_id").agg(F.min("best").alias("best"))
    return best.select("vec_id", F.col("best.label").alias("label"), F.sqrt("best.d").alias("distance"))


def top_per_group(rows: DataFrame, by: str, order: list, k: int) -> DataFrame:
    """The first k rows of each group; Spark keeps k a group before it shuffles."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= k)
