"""The manifest: one row a chunk, enough to plan, price and check queries before any data is read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locus.functions.scalars import chunk_path, request_cost
from locus.operators.regions import Region, chunk_bounds

COLUMNS = ("reference", "chunk_start", "chunk_end", "reads", "bases", "max_span", "min_mapq", "max_mapq", "duplicates", "path")


def build(rows: DataFrame, size: int) -> DataFrame:
    """reference, chunk_start, chunk_end, reads, bases, max_span, min_mapq, max_mapq, duplicates, path of mapped rows' chunks, and one entry for unmapped rows (reference null)."""
    return _finished(_grouped(rows).agg(*_counted()), size).select(*COLUMNS)


def _counted() -> list[Column]:
    return [
        F.count("*").alias("reads"),
        F.sum("span").cast("long").alias("bases"),
        F.max("span").alias("max_span"),
        F.min("mapq").alias("min_mapq"),
        F.max("mapq").alias("max_mapq"),
        F.count_if(F.col("flag").bitwiseAND(1024) != 0).alias("duplicates"),
    ]


def _grouped(rows: DataFrame):
    mapped = F.col("reference_id") >= 0
    return rows.groupBy(F.when(mapped, F.col("reference")).alias("reference"), F.when(mapped, F.col("chunk_start")).otherwise(0).cast("long").alias("chunk_start"))


def _finished(entries: DataFrame, size: int) -> DataFrame:
    end = F.when(F.col("reference").isNull(), 0).otherwise(F.col("chunk_start") + size).cast("long")
    return entries.withColumn("chunk_end", end).withColumn("path", chunk_path(F.col("reference"), F.col("chunk_start"), size))


def build_part(rows: DataFrame, size: int, columns: list[str]) -> DataFrame:
    """As build, of some of a dataset's rows, with the sums that checksums are made of: parts of a chunk are put together by merged()."""
    h = row_number_of(columns)
    sums = (F.bit_xor(h).alias("hash_xor"), F.sum(h.cast("decimal(38,0)")).alias("hash_sum"))
    return _finished(_grouped(rows).agg(*_counted(), *sums), size).select(*COLUMNS, "hash_xor", "hash_sum")


def merged(parts: DataFrame) -> DataFrame:
    """One entry a chunk of the parts that each write has left, with its checksum."""
    out = parts.groupBy("reference", "chunk_start", "chunk_end", "path").agg(
        F.sum("reads").alias("reads"), F.sum("bases").alias("bases"), F.max("max_span").alias("max_span"), F.min("min_mapq").alias("min_mapq"), F.max("max_mapq").alias("max_mapq"),
        F.sum("duplicates").alias("duplicates"), F.bit_xor("hash_xor").alias("x"), F.sum("hash_sum").cast("decimal(38,0)").alias("s"), F.max("chunk_size").alias("chunk_size"), F.max("version").alias("version"),
    )
    return out.select(*COLUMNS, checksum_text("reads", "x", "s").alias("checksum"), "chunk_size", "version")


def row_number_of(columns: list[str]) -> Column:
    """60 bits of a row's digest; the row as text, null fields empty, a tab between fields."""
    text = F.concat_ws("\t", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def checksum_text(reads: str, xor: str, total: str) -> Column:
    return F.sha2(F.concat_ws(":", *(F.col(c).cast("string") for c in (reads, xor, total))), 256)


def checksums(rows: DataFrame, columns: list[str]) -> DataFrame:
    """reference, chunk_start, reads, checksum: independent of row order, bounded state: the xor and the sum of 60-bit row digests, then SHA-256 of them."""
    h = row_number_of(columns)
    grouped = rows.groupBy("reference", "chunk_start").agg(F.count("*").alias("reads"), F.bit_xor(h).alias("x"), F.sum(h.cast("decimal(38,0)")).cast("decimal(38,0)").alias("s"))
    return grouped.select("reference", "chunk_start", "reads", checksum_text("reads", "x", "s").alias("checksum"))


def find_chunks(manifest: DataFrame, region: Region, size: int) -> DataFrame:
    return manifest.where(chunk_bounds(region, size))


def spatial_index(manifest: DataFrame, references: DataFrame | None = None) -> DataFrame:
    """reference, length (0 if unknown), chunks, first, last, reads; unmapped rows have no place in it."""
    index = manifest.where(F.col("reference").isNotNull()).groupBy("reference").agg(
        F.count("*").alias("chunks"), F.min("chunk_start").alias("first"), F.max("chunk_end").alias("last"), F.sum("reads").alias("reads")
    )
    if references is None:
        return index.withColumn("length", F.lit(0).cast("long"))
    return index.join(references.select("reference", "length"), "reference", "left").withColumn("length", F.coalesce("length", F.lit(0)).cast("long"))


def index_entries(manifest: DataFrame) -> DataFrame:
    """reference, chunks: the index that keeps unmapped rows (under "unmapped"): each reference's chunks (start, end, reads, path) by start."""
    entry = F.struct(F.col("chunk_start").alias("start"), F.col("chunk_end").alias("end"), "reads", "path")
    return manifest.groupBy(F.coalesce("reference", F.lit("unmapped")).alias("reference")).agg(F.array_sort(F.collect_list(entry)).alias("chunks"))


def chunk_info(manifest: DataFrame, paths: DataFrame) -> DataFrame:
    """The manifest's entries of the given paths; paths that no entry has keep nulls."""
    return paths.select("path").join(manifest, "path", "left")


def info(manifest: DataFrame) -> DataFrame:
    """chunks, reads, bases, references (distinct ones), first_references (the first ten by name, "and N more" after them)."""
    names = F.array_sort(F.collect_set("reference"))
    out = manifest.agg(F.count("*").alias("chunks"), F.coalesce(F.sum("reads"), F.lit(0)).alias("reads"), F.coalesce(F.sum("bases"), F.lit(0)).alias("bases"), names.alias("names"))
    shown = F.array_join(F.slice("names", 1, 10), ", ")
    more = F.when(F.size("names") > 10, F.concat(F.lit(" and "), (F.size("names") - 10).cast("string"), F.lit(" more"))).otherwise("")
    return out.select("chunks", "reads", "bases", F.size("names").cast("long").alias("references"), F.concat(shown, more).alias("first_references"))


def estimate(manifest: DataFrame, region: Region, size: int, bytes_a_base: float = 1.0) -> DataFrame:
    """chunks, reads, bytes, cost of what a region query would touch."""
    touched = find_chunks(manifest, region, size).agg(F.count("*").alias("chunks"), F.coalesce(F.sum("reads"), F.lit(0)).alias("reads"), F.coalesce(F.sum("bases") * bytes_a_base, F.lit(0.0)).alias("bytes"))
    return touched.withColumn("cost", request_cost(F.col("chunks"), F.col("bytes")))


def violations(rows: DataFrame, manifest: DataFrame, size: int) -> DataFrame:
    """rule, violations: what a manifest says against what the rows are."""
    actual = build(rows, size).select("reference", "chunk_start", F.col("reads").alias("found"))
    both = manifest.withColumn("listed", F.lit(True)).join(actual, (manifest["reference"].eqNullSafe(actual["reference"])) & (manifest["chunk_start"] == actual["chunk_start"]), "full_outer")
    counted = both.agg(
        F.count_if(F.col("listed").isNull()).alias("chunk_not_listed"),
        F.count_if(F.col("found").isNull()).alias("chunk_missing"),
        F.count_if(F.col("found") != F.col("reads")).alias("reads_differ"),
        F.count_if((F.col("chunk_end") > 0) & (F.col("chunk_end") - manifest["chunk_start"] != size)).alias("wrong_width"),
    )
    return counted.unpivot([], counted.columns, "rule", "violations")
