"""Coordinate order: sort, ranks, deltas, merge and equal-count chunks.

Ranks over a whole reference are counted inside chunks and shifted by the count
of the chunks before, so no task holds a reference.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TIES = ("l_orderkey", "l_linenumber", "l_suppkey")


def coordinate_sort(rows: DataFrame, *ties: str) -> DataFrame:
    """Rows in (reference_id, position) order; unmapped ones (negative ids) last."""
    return rows.orderBy((F.col("reference_id") < 0).asc(), "reference_id", "position", *ties)


def merge_sorted(*runs: DataFrame, by: list[str]) -> DataFrame:
    """One sorted table of several runs."""
    out = runs[0]
    for run in runs[1:]:
        out = out.unionByName(run)
    return out.orderBy(*by)


def ranked(rows: DataFrame, *ties: str, name: str = "rank") -> DataFrame:
    """rows with their place (from 1) in position order within the reference; rows need chunk_start from position."""
    counts = rows.groupBy("reference", "chunk_start").agg(F.count("*").alias("_n"))
    before = counts.select("reference", "chunk_start", (F.sum("_n").over(Window.partitionBy("reference").orderBy("chunk_start")) - F.col("_n")).alias("_before"))
    inside = Window.partitionBy("reference", "chunk_start").orderBy("position", *ties)
    return rows.withColumn("_row", F.row_number().over(inside)).join(before, ["reference", "chunk_start"]).withColumn(name, (F.col("_row") + F.col("_before")).cast("long")).drop("_row", "_before")


def deltas(rows: DataFrame, *ties: str) -> DataFrame:
    """rows with delta: the distance to the row before in the reference (null for its first); a chunk's first row looks at the chunk before."""
    inside = Window.partitionBy("reference", "chunk_start").orderBy("position", *ties)
    chunks = rows.groupBy("reference", "chunk_start").agg(F.max("position").alias("_last"))
    before = chunks.select("reference", "chunk_start", F.lag("_last").over(Window.partitionBy("reference").orderBy("chunk_start")).alias("_before"))
    return rows.withColumn("_lag", F.lag("position").over(inside)).join(before, ["reference", "chunk_start"]).withColumn("delta", (F.col("position") - F.coalesce("_lag", "_before")).cast("long")).drop("_lag", "_before")


def equal_count_chunks(rows: DataFrame, chunks: int, *ties: str) -> DataFrame:
    """reference, chunk, first, last, reads: chunks of a reference with equal counts."""
    place = ranked(rows, *ties, name="_place")
    total = rows.groupBy("reference").agg(F.count("*").alias("_total"))
    chunk = F.expr(f"(_place - 1) * {chunks} div _total")
    return place.join(total, "reference").groupBy("reference", chunk.alias("chunk")).agg(F.min("position").alias("first"), F.max("position").alias("last"), F.count("*").alias("reads"))


def export_places(chunks: DataFrame) -> DataFrame:
    """chunks (reference, chunk_start, ...) with place: from 1, references by name, then by start.  Places are counted inside a reference and shifted by the chunks of the references before, a row each."""
    counts = chunks.groupBy("reference").agg(F.count("*").alias("_n")).withColumn("_all", F.lit(1))
    before = counts.select("reference", (F.sum("_n").over(Window.partitionBy("_all").orderBy("reference")) - F.col("_n")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("reference").orderBy("chunk_start"))
    return chunks.withColumn("_row", inside).join(before, "reference").withColumn("place", (F.col("_row") + F.col("_before")).cast("long")).drop("_row", "_before")
