"""Views of the test tables in the shapes that the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locus.operators.regions import with_chunks

#: Chunk width of the proxy coordinates.
SIZE = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reads(spark: SparkSession, sf_dir: str, size: int = SIZE) -> DataFrame:
    """Aligned rows: lineitem as reads, parts as positions."""
    unmapped = F.col("l_tax") == 0.0
    rows = table(spark, sf_dir, "lineitem").select(
        F.when(unmapped, -1).when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2).alias("reference_id"),
        F.col("l_returnflag").alias("reference"),
        F.col("l_partkey").alias("position"),
        F.col("l_quantity").cast("int").alias("span"),
        (F.round(F.col("l_discount") * 100).cast("int") * 6).alias("mapq"),
        (F.when(F.col("l_linestatus") == "F", 1024).otherwise(0) + F.when(unmapped, 4).otherwise(0)).alias("flag"),
        "l_orderkey", "l_linenumber", "l_suppkey",
    )
    return with_chunks(rows, size)


def mapped(spark: SparkSession, sf_dir: str, size: int = SIZE) -> DataFrame:
    return reads(spark, sf_dir, size).where("reference_id >= 0")


def placed(spark: SparkSession, sf_dir: str, size: int = SIZE) -> DataFrame:
    """All rows chunked by position, unmapped ones too, for orders within a reference."""
    return reads(spark, sf_dir).withColumn("chunk_start", F.expr(f"position div {size} * {size}"))


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Genotype calls: suppliers as samples, line numbers as dosages."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("sample"), F.col("l_partkey").alias("position"), (F.col("l_linenumber") % 3).alias("dosage"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("sample"))


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as point annotations, with t in whole seconds."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("participant"), F.col("event_type").alias("code"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("t"), "value"
    )
