"""Sparse genotypes: rows (sample, position, dosage), dosage 0 for the reference; only other genotypes need storing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sparse(calls: DataFrame) -> DataFrame:
    """Only calls that differ from the reference."""
    return calls.where("dosage <> 0")


def sparse_ratio(calls: DataFrame, positions: int, samples: int) -> DataFrame:
    """gchunk, schunk, dense, stored: all calls against those that differ, in each tile of the position by sample grid."""
    tile = calls.groupBy(F.expr(f"position div {positions}").alias("gchunk"), F.expr(f"sample div {samples}").alias("schunk"))
    return tile.agg(F.count("*").alias("dense"), F.count_if(F.col("dosage") != 0).alias("stored"))


def of_sample(calls: DataFrame, sample: int, start: int | None = None, end: int | None = None) -> DataFrame:
    """Distinct variants (position, dosage) of one sample, within [start, end) if given."""
    own = sparse(calls).where(F.col("sample") == sample)
    if start is not None:
        own = own.where((F.col("position") >= start) & (F.col("position") < end))
    return own.select("position", "dosage").distinct()


def carriers(calls: DataFrame, position: int) -> DataFrame:
    return sparse(calls).where(F.col("position") == position).select("sample").distinct()


def noncarriers(samples: DataFrame, calls: DataFrame, position: int) -> DataFrame:
    return samples.join(carriers(calls, position), "sample", "left_anti")


def allele_frequency(calls: DataFrame) -> DataFrame:
    """position, ac (alternate alleles), an (all alleles), af."""
    counted = calls.groupBy("position").agg(F.sum("dosage").cast("long").alias("ac"), (F.count("*") * 2).alias("an"))
    return counted.withColumn("af", F.col("ac") / F.col("an"))


def dense(calls: DataFrame, samples: DataFrame, start: int, end: int, block: int = 10_000) -> DataFrame:
    """sample, position, dosage for every sample and every variant position of [start, end); unstored calls are 0.  The range bounds the grid.

    Samples lie in blocks and each site meets each block, an equi join whose rows
    are the grid's own; no row holds all samples.
    """
    near = sparse(calls).where((F.col("position") >= start) & (F.col("position") < end))
    stored = near.groupBy("sample", "position").agg(F.max("dosage").alias("dosage"))
    every = samples.select("sample").distinct()
    blocks = max(1, -(-every.count() // block))
    sites = near.select("position").distinct().withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    grid = sites.join(every.withColumn("block", F.pmod(F.xxhash64("sample"), F.lit(blocks)).cast("int")), "block")
    return grid.join(stored, ["sample", "position"], "left").select("sample", "position", F.coalesce("dosage", F.lit(0)).alias("dosage"))


def filtered(sites: DataFrame, reference: str, start: int, end: int, min_quality: float = 0.0, min_depth: int = 0) -> DataFrame:
    """Sites (reference, position, qual, depth, ...) of [start, end) with that quality and depth at least; all four are plain predicates that a columnar scan takes."""
    near = sites.where((F.col("reference") == reference) & (F.col("position") >= start) & (F.col("position") < end))
    return near.where((F.col("qual") >= min_quality) & (F.col("depth") >= min_depth))


def site_sketch(calls: DataFrame) -> DataFrame:
    """positions, samples (about: sketches of fixed size, merged map-side), median_position (about)."""
    own = sparse(calls)
    return own.agg(F.approx_count_distinct("position", 0.01).alias("positions"), F.approx_count_distinct("sample", 0.01).alias("samples"), F.percentile_approx("position", 0.5, 10_000).alias("median_position"))


def shared(calls: DataFrame, one: int, other: int) -> DataFrame:
    """Positions at which both samples differ from the reference."""
    own = sparse(calls)
    return own.where(F.col("sample") == one).select("position").intersect(own.where(F.col("sample") == other).select("position"))


def merged_genotypes(calls: DataFrame, block: int | None = None) -> DataFrame:
    """position, carriers: "sample:dosage" of all carriers, by sample, comma-joined; with block a row for each block of samples (sample div block) and its number, so that a row holds a block at most."""
    best = sparse(calls).groupBy("position", "sample").agg(F.max("dosage").alias("dosage"))
    pairs = F.array_sort(F.collect_list(F.struct("sample", "dosage")))
    by = ["position"] if block is None else ["position", F.expr(f"sample div {block}").alias("block")]
    return best.groupBy(*by).agg(F.array_join(F.transform(pairs, lambda p: F.concat_ws(":", p["sample"], p["dosage"])), ",").alias("carriers"))


def variant_statistics(sites: DataFrame) -> DataFrame:
    """variants, snps, indels of rows (ref, alt)."""
    short = (F.length("ref") == 1) & (F.length("alt") == 1)
    return sites.agg(F.count("*").alias("variants"), F.count_if(short).alias("snps"), F.count_if(F.length("ref") != F.length("alt")).alias("indels"))


def vcf_lines(calls: DataFrame, samples: list[int]) -> DataFrame:
    """position, line: one tab-separated line a variant, a genotype column for each sample."""
    text = F.element_at(F.array(F.lit("0/0"), F.lit("0/1"), F.lit("1/1")), F.col("dosage") + 1)
    wide = sparse(calls).where(F.col("sample").isin(samples)).groupBy("position", "sample").agg(F.max("dosage").alias("dosage")).withColumn("gt", text)
    wide = wide.groupBy("position").pivot("sample", samples).agg(F.first("gt"))
    columns = [F.coalesce(F.col(str(s)), F.lit("0/0")) for s in samples]
    return wide.select("position", F.concat_ws("\t", F.lit("1"), "position", F.lit("."), F.lit("A"), F.lit("G"), F.lit("."), F.lit("PASS"), F.lit("."), F.lit("GT"), *columns).alias("line"))
