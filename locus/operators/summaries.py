"""Summary statistics of aligned rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locus.functions.scalars import has_flag, is_mapped

#: Names of the flag bits.
FLAGS = {
    "paired": 1, "proper_pair": 2, "unmapped": 4, "mate_unmapped": 8, "reverse": 16, "mate_reverse": 32,
    "first": 64, "second": 128, "secondary": 256, "failed": 512, "duplicate": 1024, "supplementary": 2048,
}


def dataset_statistics(rows: DataFrame, reference_length: int, mapped_by: str = "reference") -> DataFrame:
    """One row of counters; mean_coverage is 0 without a reference length, shares are null without rows."""
    mapped = is_mapped(F.col("reference_id"), F.col("flag"), mapped_by)
    bases = F.coalesce(F.sum("span"), F.lit(0)).cast("long")
    counted = rows.agg(
        F.count("*").alias("total_reads"),
        F.count_if(mapped).alias("mapped_reads"),
        F.count_if(~mapped).alias("unmapped_reads"),
        F.count_if(has_flag(F.col("flag"), 1024)).alias("duplicate_reads"),
        bases.alias("total_bases"),
    )
    return counted.withColumn("mean_coverage", F.coalesce(F.try_divide(F.col("total_bases").cast("double"), F.lit(float(reference_length))), F.lit(0.0))).withColumn(
        "percent_mapped", F.try_divide(F.col("mapped_reads") * 100.0, F.col("total_reads").cast("double"))
    )


def flag_counts(rows: DataFrame) -> DataFrame:
    """flag_name, reads: one scan, all bits counted side by side, then turned to rows."""
    counted = rows.agg(*(F.count_if(has_flag(F.col("flag"), bit)).alias(name) for name, bit in FLAGS.items()), F.count("*").alias("total"))
    return counted.unpivot([], list(FLAGS) + ["total"], "flag_name", "reads")


def reads_per_reference(rows: DataFrame) -> DataFrame:
    """reference, mapped, unmapped."""
    return rows.groupBy("reference").agg(F.count_if(F.col("reference_id") >= 0).alias("mapped"), F.count_if(F.col("reference_id") < 0).alias("unmapped"))
