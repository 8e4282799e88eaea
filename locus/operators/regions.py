"""Region queries over coordinate-chunked rows.

Rows have reference, position, span and chunk_start (the multiple of the chunk
size that position falls into).  Coordinates are 0-based, ranges half-open.
Catalyst does not derive bounds of chunk_start from bounds of position, so every
predicate here states both: the first prunes partitions, the second rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Region:
    """A range of one reference; end None: to the reference's end."""

    reference: str
    start: int = 0
    end: int | None = None

    @classmethod
    def parse(cls, text: str) -> Region:
        """ "ref", "ref:1,000-2,000" or "ref:1M-2M"."""
        import re

        m = re.fullmatch(r"([^:]+)(?::([0-9,]+)([KkMm]?)-([0-9,]+)([KkMm]?))?", text)
        if not m:
            raise ValueError(f"not a region: {text!r}")
        if m[2] is None:
            return cls(m[1])
        unit = {"": 1, "K": 1_000, "M": 1_000_000}
        start, end = (int(m[k].replace(",", "")) * unit[m[k + 1].upper()] for k in (2, 4))
        if start >= end:
            raise ValueError(f"empty region: {text!r}")
        return cls(m[1], start, end)


def with_chunks(rows: DataFrame, size: int) -> DataFrame:
    """rows with chunk_start; unmapped rows (null position or negative reference_id) go to chunk 0."""
    start = F.expr(f"position div {size} * {size}")
    return rows.withColumn("chunk_start", F.when(F.col("reference_id") < 0, 0).otherwise(start).cast("long"))


def chunk_bounds(region: Region, size: int, reach: int = 0) -> Column:
    """Chunks that may hold rows of the region; reach: the longest span, for rows that start before it."""
    keep = (F.col("reference") == region.reference) & (F.col("chunk_start") + size > region.start - reach)
    return keep if region.end is None else keep & (F.col("chunk_start") < region.end)


def starts_in(rows: DataFrame, region: Region, size: int) -> DataFrame:
    """Rows whose position lies in the region."""
    inside = F.col("position") >= region.start
    return rows.where(chunk_bounds(region, size)).where(inside if region.end is None else inside & (F.col("position") < region.end))


def overlapping(rows: DataFrame, region: Region, size: int, max_span: int) -> DataFrame:
    """Rows that cover a base of the region, those that start before it included; max_span: from the manifest."""
    inside = F.col("position") + F.col("span") > region.start
    return rows.where(chunk_bounds(region, size, max_span)).where(inside if region.end is None else inside & (F.col("position") < region.end))


def join_regions(rows: DataFrame, regions: DataFrame, size: int) -> DataFrame:
    """rows with region columns (name, reference, start, end), for each region that a row starts in.

    Each region is spread over the chunks that it touches, so this is an equi
    join on (reference, chunk_start); Spark broadcasts the regions if they are few.
    """
    spread = regions.withColumn("chunk_start", F.explode(F.sequence(F.expr(f"start div {size} * {size}"), F.expr(f"(end - 1) div {size} * {size}"), F.lit(size))))
    return rows.join(spread, ["reference", "chunk_start"]).where("position >= start and position < end")


def per_chunk(rows: DataFrame, apply, schema: str) -> DataFrame:
    """A user function over the rows of each chunk, as a pandas frame in and out."""
    return rows.groupBy("reference", "chunk_start").applyInPandas(apply, schema)


def difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that one side has more often than the other: a side column tells which; empty after a faithful round trip."""
    both = left.withColumn("_more", F.lit(1)).union(right.withColumn("_more", F.lit(-1)))
    each = both.groupBy(*(F.col(f"`{c}`") for c in left.columns)).agg(F.sum("_more").alias("_more")).where("_more <> 0")
    side = F.when(F.col("_more") > 0, "left").otherwise("right").alias("side")
    return each.select(*(F.col(f"`{c}`") for c in left.columns), side, F.explode(F.sequence(F.lit(1).cast("long"), F.abs("_more"))).alias("_k")).drop("_k")
