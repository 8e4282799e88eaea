"""Coverage depth by a sweep over range ends.

A running sum over a whole reference would put the reference into one task, so
depth is summed inside chunks and started from the total of all chunks before,
which is a small table of one row a chunk.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def running_total(rows: DataFrame, by: str, chunk: str, place: str, value: str, name: str) -> DataFrame:
    """rows with name: the sum of value over all rows of the same ``by`` up to place (unique within by and chunk)."""
    totals = rows.groupBy(by, chunk).agg(F.sum(value).alias("_total"))
    before = totals.select(by, chunk, (F.sum("_total").over(Window.partitionBy(by).orderBy(chunk)) - F.col("_total")).alias("_before"))
    inside = Window.partitionBy(by, chunk).orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.sum(value).over(inside)).join(before, [by, chunk]).withColumn(name, (F.col(name) + F.col("_before")).cast("long")).drop("_before", chunk)


def depth(rows: DataFrame, size: int) -> DataFrame:
    """reference, position, depth: the depth from each breakpoint to the next."""
    ends = rows.select("reference", F.explode(F.array(F.struct(F.col("position").cast("long").alias("position"), F.lit(1).alias("step")), F.struct((F.col("position") + F.col("span")).cast("long").alias("position"), F.lit(-1).alias("step")))).alias("e"))
    steps = ends.groupBy("reference", F.col("e.position").alias("position")).agg(F.sum("e.step").alias("step")).withColumn("chunk", F.expr(f"position div {size}"))
    return running_total(steps, "reference", "chunk", "position", "step", "depth").select("reference", "position", "depth")


def following(rows: DataFrame, by: str, chunk: str, place: str, name: str) -> DataFrame:
    """rows with name: the next place of the same ``by`` (null for the last); a chunk's last row looks at the first place of the next chunk."""
    firsts = rows.groupBy(by, chunk).agg(F.min(place).alias("_first"))
    after = firsts.select(by, chunk, F.lead("_first").over(Window.partitionBy(by).orderBy(chunk)).alias("_after"))
    inside = F.lead(place).over(Window.partitionBy(by, chunk).orderBy(place))
    return rows.withColumn(name, inside).join(after, [by, chunk]).withColumn(name, F.coalesce(name, "_after")).drop("_after")


def summary(depths: DataFrame, at_least: int, size: int) -> DataFrame:
    """reference, max_depth, bases (the integral of depth), covered (bases at depth at_least or more)."""
    stretch = following(depths.withColumn("chunk", F.expr(f"position div {size}")), "reference", "chunk", "position", "next")
    stretch = stretch.withColumn("length", F.coalesce(F.col("next") - F.col("position"), F.lit(0)))
    return stretch.groupBy("reference").agg(
        F.max("depth").alias("max_depth"), F.sum(F.col("depth") * F.col("length")).alias("bases"), F.sum(F.when(F.col("depth") >= at_least, F.col("length")).otherwise(0)).alias("covered")
    )


def base_depth(rows: DataFrame, start: int, end: int) -> DataFrame:
    """position, depth of every base of [start, end) that rows cover."""
    covered = F.sequence(F.greatest("position", F.lit(start)), F.least(F.col("position") + F.col("span"), F.lit(end)) - 1)
    inside = rows.where((F.col("position") < end) & (F.col("position") + F.col("span") > start) & (F.col("span") > 0))
    return inside.select(F.explode(covered).alias("position")).groupBy(F.col("position").cast("long").alias("position")).agg(F.count("*").alias("depth"))
