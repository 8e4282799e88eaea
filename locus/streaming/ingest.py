"""Incremental ingest and windows over streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from locus.sources import dataset, shared, text_formats


def ingest_sam(spark: SparkSession, source: str, target: str, references: DataFrame, size: int, checkpoint: str, name: str = "stream") -> StreamingQuery:
    """Text files that arrive in source, parsed and appended to the dataset at target; stops when all are in.

    Rows may come in any order and late: each micro-batch appends files to its
    chunks and entries to the manifest, so nothing waits for a frontier.  The
    checkpoint makes it resumable, and a micro-batch that is played again replaces
    its own files and entries.
    """
    lines, known = spark.readStream.text(source), shared.small(references.select("reference", "reference_id"))

    def store(batch: DataFrame, number: int) -> None:
        rows = text_formats.parse_sam(batch).join(known, "reference", "left")
        rows = rows.withColumn("reference_id", F.coalesce("reference_id", F.lit(-1)))
        dataset.append(rows, target, size, batch=f"{name}-{number}")

    return lines.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def frontier(rows: DataFrame, margin: int) -> DataFrame:
    """reference, frontier (greatest position so far), settled (chunks that end at or before it are complete but for rows later than the margin)."""
    return rows.groupBy("reference").agg(F.max("position").alias("frontier")).withColumn("settled", F.greatest(F.col("frontier") - margin, F.lit(0)))


def settled_chunks(rows: DataFrame, size: int, chunks_late: int = 2) -> DataFrame:
    """reference, chunk_start, reads of chunks that end chunks_late chunks or more before the frontier of their reference; rows need chunk_start."""
    passed = frontier(rows, chunks_late * size)
    counted = rows.groupBy("reference", "chunk_start").agg(F.count("*").alias("reads"))
    return counted.join(passed, "reference").where(F.col("chunk_start") + size <= F.col("settled")).select("reference", "chunk_start", "reads")


def windowed_counts(events: DataFrame, width: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """start, code, events: tumbling windows, or sliding ones; rows later than ``late`` may be dropped."""
    stamped = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    window = F.window("at", width, slide) if slide else F.window("at", width)
    return stamped.groupBy(window.alias("w"), F.col("event_type").alias("code")).agg(F.count("*").alias("events")).select(F.col("w.start").alias("start"), "code", "events")


def session_counts(events: DataFrame, gap: str, late: str = "10 minutes") -> DataFrame:
    stamped = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return stamped.groupBy("user_id", F.session_window("at", gap).alias("w")).agg(F.count("*").alias("events")).select("user_id", F.col("w.start").alias("start"), "events")


def deduplicated(events: DataFrame, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """The first row of each key within the watermark."""
    return events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late).dropDuplicatesWithinWatermark(keys)


def paired(left: DataFrame, right: DataFrame, by: str, within: str, late: str = "10 minutes") -> DataFrame:
    """Stream-stream join: rows of right at most ``within`` after one of left, same key; state is bounded by the watermarks."""
    a = left.withColumn("left_at", F.col("ts").cast("timestamp")).withWatermark("left_at", late).select(by, "left_at", F.col("event_id").alias("left_id"))
    b = right.withColumn("right_at", F.col("ts").cast("timestamp")).withWatermark("right_at", late).select(F.col(by).alias("_by"), "right_at", F.col("event_id").alias("right_id"))
    return a.join(b, F.expr(f"{by} = _by and right_at >= left_at and right_at <= left_at + interval {within}")).drop("_by")
