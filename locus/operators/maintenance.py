"""Migration and checks of stored objects, over listings and manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locus.functions.scalars import request_cost, shard_prefix


def sharded_paths(manifest: DataFrame, bits: int) -> DataFrame:
    """manifest with each path under its hash prefix; no object is rewritten."""
    return manifest.withColumn("path", F.concat(shard_prefix(F.col("path"), bits), F.lit("/"), F.col("path")))


def unsharded_paths(manifest: DataFrame) -> DataFrame:
    return manifest.withColumn("path", F.regexp_replace("path", "^[0-9a-f]{1,2}/", ""))


def migration_estimate(manifest: DataFrame, bytes_a_base: float = 1.0) -> DataFrame:
    """chunks, bytes, cost of reading and writing everything once."""
    total = manifest.agg(F.count("*").alias("chunks"), F.coalesce(F.sum("bases") * bytes_a_base, F.lit(0.0)).alias("bytes"))
    return total.withColumn("cost", request_cost(F.col("chunks") * 2, F.col("bytes")))


def readiness(objects: DataFrame) -> DataFrame:
    """path, verdict of a listing (path, n_bytes, indexed, has_metadata, codec): whether ranges of it can be read without the rest."""
    splittable = F.col("codec").isin("none", "zstd", "bgzf", "snappy")
    verdict = (
        F.when(~F.col("has_metadata"), "no metadata")
        .when(~splittable, "compression cannot be entered in the middle")
        .when((F.col("n_bytes") > 64 << 20) & ~F.col("indexed"), "large and without an index")
        .otherwise("ready")
    )
    return objects.select("path", verdict.alias("verdict"))


def chunk_sizes(manifest: DataFrame) -> DataFrame:
    """chunks, least, most, mean of reads a chunk, and skew: the largest against the mean."""
    out = manifest.agg(F.count("*").alias("chunks"), F.min("reads").alias("least"), F.max("reads").alias("most"), F.avg("reads").alias("mean"))
    return out.withColumn("skew", F.try_divide(F.col("most"), F.col("mean")))


def speedups(results: DataFrame, baseline: str) -> DataFrame:
    """results (method, operation, n_bytes, seconds, success) with throughput and speed-up against the baseline method, successes first, fastest first."""
    base = results.where((F.col("method") == baseline) & F.col("success")).groupBy("operation").agg(F.min("seconds").alias("_base"))
    out = results.join(base, "operation", "left").withColumn("throughput", F.try_divide(F.col("n_bytes"), F.col("seconds"))).withColumn("speedup", F.try_divide(F.col("_base"), F.col("seconds")))
    return out.drop("_base").orderBy(F.desc("success"), "seconds")


def markdown(rows: DataFrame, title: str) -> DataFrame:
    """number, line: a small result as a Markdown table, row by row in the result's order."""
    cells = F.concat(F.lit("| "), F.concat_ws(" | ", *(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in rows.columns)), F.lit(" |"))
    head = [f"## {title}", "", "| " + " | ".join(rows.columns) + " |", "|" + " --- |" * len(rows.columns)]
    lines = rows.sparkSession.createDataFrame([(k - len(head), line) for k, line in enumerate(head)], "number long, line string")
    return lines.unionByName(rows.select(F.monotonically_increasing_id().alias("number"), cells.alias("line")))
