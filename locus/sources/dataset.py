"""The stored dataset: batches of Parquet partitioned by reference and ranges of chunks, with a manifest of each batch and the header beside them.

A folder (``chunk_start=`` its first place) holds the rows of GROUP chunks that follow one
another, so that folders and files stay few and of a size where chunks are narrow and
many.  Which chunk a row is of is a column of the files, by which they are sorted:
readers leave out folders, then row groups and pages.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from locus.operators import regions
from locus.operators.regions import Region
from locus.plans import manifest as plan
from locus.sources import shared
from locus.sources.chunk_files import read_any

UNMAPPED = "unmapped"
#: Version 1 had a folder for each chunk and no column CHUNK.
FORMAT_VERSION = "2"
#: Chunks of a folder, and the files' column that tells them apart.
GROUP, CHUNK = 64, "_chunk"


def write(rows: DataFrame, path: str, size: int, codec: str = "zstd", mode: str = "overwrite", max_rows_a_file: int = 5_000_000, batch: str = "0") -> None:
    """rows (reference_id, reference, position, span, mapq, flag, ...) as a dataset at path.

    One shuffle brings each folder's rows together; a crowded folder is split by
    AQE's rebalancing instead of filling one task.  Rows are sorted in files, so
    statistics of row groups and pages prune inside a folder as well.  Mode "append" adds the rows
    as a batch; a batch that is written again replaces itself, so a write that is
    repeated after a failure changes nothing.  The manifest gets entries of these
    rows only.
    """
    chunked = regions.with_chunks(rows, size).withColumn("reference", F.when(F.col("reference_id") < 0, UNMAPPED).otherwise(F.col("reference")))
    grouped = chunked.withColumns({CHUNK: F.col("chunk_start"), "chunk_start": F.expr(f"chunk_start div {size * GROUP} * {size * GROUP}")})
    sorted_rows = grouped.hint("rebalance", "reference", "chunk_start").sortWithinPartitions("reference", "chunk_start", CHUNK, "position")
    _put(sorted_rows, f"{path}/data", mode, batch, ["reference", "chunk_start"], compression=codec, maxRecordsPerFile=max_rows_a_file)
    columns = sorted(c for c in rows.columns if c not in ("chunk_start", "reference", "batch") and not isinstance(rows.schema[c].dataType, (MapType, ArrayType, StructType)))
    # Read back from the batch's own folder: no other file is listed.
    stored = _typed(rows.sparkSession.read.parquet(f"{path}/data/batch={batch}"))
    entries = plan.build_part(with_ids(stored), size, columns).withColumns({"chunk_size": F.lit(size), "version": F.lit(FORMAT_VERSION), "columns": F.lit(",".join(columns)), "codec": F.lit(codec)})
    _put(entries.hint("rebalance"), f"{path}/manifest", mode, batch, [])


def _put(rows: DataFrame, path: str, mode: str, batch: str, by: list[str], **options) -> None:
    """rows as the batch's folder under path; mode "overwrite" first removes all other batches."""
    if mode == "overwrite":
        rows.withColumn("batch", F.lit(batch)).write.mode("overwrite").options(partitionOverwriteMode="static", **options).partitionBy("batch", *by).parquet(path)
    else:
        rows.write.mode("overwrite").options(partitionOverwriteMode="static", **options).partitionBy(*by).parquet(f"{path}/batch={batch}")


def _typed(rows: DataFrame) -> DataFrame:
    """Files' rows with their reference as text, whatever Spark infers from folder names, and their own chunk instead of their folder's first."""
    chunk = F.col(CHUNK if CHUNK in rows.columns else "chunk_start").cast("long")
    return rows.withColumns({"reference": F.col("reference").cast("string"), "chunk_start": chunk}).drop(CHUNK)


def near(files: DataFrame, region: Region, size: int, reach: int = 0) -> DataFrame:
    """Files' rows of the chunks that may hold something of the region; reach: the longest span, for rows that start before it."""
    return _typed(files.where(regions.chunk_bounds(region, size * GROUP, reach))).where(regions.chunk_bounds(region, size, reach))


def with_ids(stored: DataFrame) -> DataFrame:
    """Unmapped rows have a reference of their own in a dataset; their id is -1."""
    return stored.withColumn("reference_id", F.when(F.col("reference") == UNMAPPED, -1).otherwise(F.col("reference_id")))


def read(spark: SparkSession, path: str) -> DataFrame:
    """All rows of all batches."""
    return _typed(spark.read.parquet(f"{path}/data")).drop("batch")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One entry a chunk, with its checksum, chunk size and format version."""
    found = spark.read.parquet(f"{path}/manifest")
    versions = [r.version for r in found.select("version").distinct().limit(2).collect()]
    if versions not in ([], [FORMAT_VERSION]):
        raise ValueError(f"format version {versions} is not {FORMAT_VERSION}")
    return plan.merged(found)


def write_header(header: DataFrame, path: str) -> None:
    """The header (as text_formats.sam_header's) as JSON lines beside the data."""
    header.coalesce(1).sortWithinPartitions("number").write.mode("overwrite").json(f"{path}/header")


def read_header(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("number long, kind string, fields map<string,string>").json(f"{path}/header")


def query(spark: SparkSession, path: str, region: Region | str, mode: str = "start") -> DataFrame:
    """Rows of a region: mode "start" those that begin in it, "overlap" those that cover a base of it.

    Chunk width and longest span come from the manifest (a row or two), then the
    scan is cut down by partition, row-group statistics and row.
    """
    region = Region.parse(region) if isinstance(region, str) else region
    known = read_manifest(spark, path).where(F.col("reference") == region.reference).agg(F.max("chunk_size"), F.max("max_span")).first()
    size, span = known[0] or 1, known[1] or 0
    rows = near(spark.read.parquet(f"{path}/data").drop("batch"), region, size, 0 if mode == "start" else span)
    return regions.starts_in(rows, region, size) if mode == "start" else regions.overlapping(rows, region, size, span)


def query_many(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """Rows of each region of a table (name, reference, start, end)."""
    size = read_manifest(spark, path).agg(F.max("chunk_size")).first()[0] or 1
    return regions.join_regions(read(spark, path), wanted, size)


def append(rows: DataFrame, path: str, size: int, batch: str | None = None) -> None:
    """Late or new rows simply become more files of their chunks; only their own entries are added to the manifest."""
    write(rows, path, size, mode="append", batch=batch or uuid.uuid4().hex)


def rechunk(spark: SparkSession, path: str, target: str, size: int, codec: str = "zstd") -> None:
    """The same rows under another chunk width or codec, their batches made one; onto its own path, the dataset is replaced once the new one is whole."""
    own = path.rstrip("/") == target.rstrip("/")
    draft = f"{target.rstrip('/')}-{uuid.uuid4().hex}" if own else target
    write(with_ids(read(spark, path).drop("chunk_start")), draft, size, codec)
    if own:
        shared.replace(spark, draft, target)


def upgrade(spark: SparkSession, chunk_files_path: str, references: DataFrame, target: str, size: int, pattern: str = "*.chunk") -> None:
    """A dataset of older chunk files (packed or JSON, told apart by their first bytes, of names that fit the pattern) as a dataset of this format."""
    rows = read_any(spark, chunk_files_path, pattern).join(shared.small(references.select("reference_id", "reference")), "reference_id", "left")
    write(rows, target, size)


def migrate(spark: SparkSession, jobs: list[tuple[str, str, int, str]], dry_run: bool = False) -> DataFrame:
    """Each (source, target, chunk size, codec) rechunked in turn: source, target, reads before and after, written (whether this run wrote it), done.

    A target that already holds the same rows (by number and sums of digests) at that
    width and under that codec is left alone, so a broken run can be run again; any
    other is written beside itself and takes the old one's place when it is whole.
    With dry_run nothing is written: written tells what would be, reads after what is there.
    """
    report = []
    for source, target, size, codec in jobs:
        before, after = _identity(spark, source), _identity(spark, target)
        written = after is None or (after.rows, after.size, after.codec) != (before.rows, size, codec)
        if written and not dry_run:
            draft = f"{target.rstrip('/')}-{uuid.uuid4().hex}"
            rechunk(spark, source, draft, size, codec)
            if _identity(spark, draft).rows != before.rows:
                raise ValueError(f"the rows of {source} and of what was made of them differ")
            shared.replace(spark, draft, target)
            after = _identity(spark, target)
        done = after is not None and (after.rows, after.size, after.codec) == (before.rows, size, codec)
        report.append((source, target, before.reads, None if after is None else after.reads, written, done))
    return spark.createDataFrame(report, "source string, target string, before long, after long, written boolean, done boolean")


class _Identity(NamedTuple):
    """What a dataset holds: number and digests of its rows, whatever chunks they are in; its chunk width and codec."""

    reads: int
    rows: tuple
    size: int | None
    codec: str | None


def _identity(spark: SparkSession, path: str) -> _Identity | None:
    """Read from the manifest; None if there is no dataset yet."""
    if not shared.exists(spark, f"{path}/manifest"):
        return None
    parts = spark.read.parquet(f"{path}/manifest")
    codec = F.col("codec") if "codec" in parts.columns else F.lit(None).cast("string")
    one = parts.agg(F.sum("reads"), F.bit_xor("hash_xor"), F.sum("hash_sum"), F.min("chunk_size"), F.max("chunk_size"), F.min(codec), F.max(codec)).first()
    return _Identity(one[0] or 0, tuple(one[:3]), one[3] if one[3] == one[4] else None, one[5] if one[5] == one[6] else None)


def violations(spark: SparkSession, path: str) -> DataFrame:
    """rule, violations of a stored dataset: chunks without files or entry, counts, spans, checksums and references that differ, chunks of a wrong width, overlapping or off their grid."""
    parts = spark.read.parquet(f"{path}/manifest")
    listed = plan.merged(parts)
    first = parts.select("columns", "chunk_size").limit(1).first()
    columns, size = (first.columns.split(","), first.chunk_size) if first else ([], 1)
    rows = with_ids(read(spark, path))
    found = plan.merged(plan.build_part(rows, size, columns).withColumns({"chunk_size": F.lit(size), "version": F.lit(FORMAT_VERSION)}))
    found = found.select("reference", "chunk_start", *(F.col(c).alias(f"found_{c}") for c in ("reads", "max_span", "checksum")))
    key = listed["reference"].eqNullSafe(found["reference"]) & (listed["chunk_start"] == found["chunk_start"])
    both = listed.withColumn("listed", F.lit(True)).join(found, key, "full_outer")
    start, end = listed["chunk_start"], F.col("chunk_end")
    chunk_rules = both.agg(
        F.count_if(F.col("found_reads").isNull()).alias("files_missing"),
        F.count_if(F.col("listed").isNull()).alias("chunk_not_listed"),
        F.count_if(F.col("found_reads") != F.col("reads")).alias("reads_differ"),
        F.count_if(F.col("found_checksum") != F.col("checksum")).alias("checksum_differs"),
        F.count_if(F.col("found_max_span") > F.col("max_span")).alias("span_too_short"),
        F.count_if((end > 0) & ((end - start != size) | (start % size != 0))).alias("wrong_width"),
    )
    # Chunks of one width on one grid overlap where two entries have the same start, or the widths differ.
    cells = F.sequence(F.expr(f"chunk_start div {size}"), F.expr(f"greatest(chunk_end - 1, chunk_start) div {size}"))
    entries = listed.where("reference is not null").select("reference", F.explode(cells).alias("cell")).groupBy("reference", "cell").agg(F.count("*").alias("n"))
    misplaced = (F.col("reference") != UNMAPPED) & ((F.col("position") < F.col("chunk_start")) | (F.col("position") >= F.col("chunk_start") + size))
    rules = chunk_rules.unpivot([], chunk_rules.columns, "rule", "violations")
    rules = rules.unionByName(entries.agg(F.count_if(F.col("n") > 1).alias("violations")).select(F.lit("chunks_overlap").alias("rule"), "violations"))
    return rules.unionByName(rows.agg(F.count_if(misplaced).alias("violations")).select(F.lit("row_outside_its_chunk").alias("rule"), "violations"))


def _shares(spark: SparkSession, path: str) -> DataFrame:
    """reference, chunk_start, file, bytes: of each chunk in each of its files its part of the file's bytes, by rows; only the chunks' column is read."""
    stored = spark.read.parquet(f"{path}/data")
    rows = _typed(stored.select(*(c for c in ("reference", "chunk_start", CHUNK) if c in stored.columns), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size")))
    each = rows.groupBy("reference", "chunk_start", "file", "size").agg(F.count("*").alias("rows"))
    whole = each.groupBy("file").agg(F.sum("rows").alias("all"))
    return each.join(whole, "file").select("reference", "chunk_start", "file", (F.col("size") * F.col("rows") / F.col("all")).alias("bytes"))


def chunk_files(spark: SparkSession, path: str) -> DataFrame:
    """reference, chunk_start, files (that hold rows of it), bytes (its part of theirs, by rows) of every chunk."""
    return _shares(spark, path).groupBy("reference", "chunk_start").agg(F.count("*").alias("files"), F.ceil(F.sum("bytes")).alias("bytes"))


def compression(spark: SparkSession, path: str) -> DataFrame:
    """chunks, bytes, plain_bytes (of the rows as text, tab-separated), ratio, least, most and mean bytes of a chunk: from the files' sizes, parted by rows, and one scan."""
    rows = read(spark, path)
    texts = [F.coalesce(F.octet_length((F.to_json(c) if isinstance(rows.schema[c].dataType, (MapType, ArrayType, StructType)) else F.col(c)).cast("string")), F.lit(0)) + 1 for c in rows.columns if c not in ("chunk_start", "reference")]
    line = texts[0]
    for t in texts[1:]:
        line = line + t
    plain = rows.agg(F.sum(line.cast("long")).alias("plain_bytes"))
    chunks = _shares(spark, path).groupBy("reference", "chunk_start").agg(F.sum("bytes").alias("bytes"))
    files = chunks.agg(F.count("*").alias("chunks"), F.round(F.sum("bytes")).cast("long").alias("bytes"), F.ceil(F.min("bytes")).alias("least"), F.ceil(F.max("bytes")).alias("most"), F.avg("bytes").alias("mean"))
    return files.join(plain).select("chunks", "bytes", "plain_bytes", F.try_divide("plain_bytes", "bytes").alias("ratio"), "least", "most", "mean")


def write_views(rows: DataFrame, path: str, sample: str, order: str) -> None:
    """The same rows in two layouts: sorted by sample (and within it by the order column), and by the order column through all samples; a reader takes the one in which its predicate prunes files and row groups.  Neither has a folder or file for each sample."""
    rows.repartitionByRange(sample, order).sortWithinPartitions(sample, order).write.mode("overwrite").parquet(f"{path}/by_{sample}")
    rows.repartitionByRange(order).sortWithinPartitions(order, sample).write.mode("overwrite").parquet(f"{path}/by_{order}")


def read_view(spark: SparkSession, path: str, view: str) -> DataFrame:
    return spark.read.parquet(f"{path}/by_{view}")


def write_hierarchy(rows: DataFrame, path: str, place: str, coarse: int, fine: int) -> None:
    """rows in folders of coarse ranges of place, files sorted so that fine ones are row groups' ranges, and their counts for whoever needs no rows."""
    split = rows.withColumns({"coarse": F.expr(f"{place} div {coarse} * {coarse}"), "fine": F.expr(f"{place} div {fine} * {fine}")})
    split.hint("rebalance", "coarse").sortWithinPartitions("coarse", "fine", place).write.mode("overwrite").partitionBy("coarse").parquet(f"{path}/rows")
    rows.sparkSession.read.parquet(f"{path}/rows").groupBy("coarse", "fine").agg(F.count("*").alias("rows")).write.mode("overwrite").parquet(f"{path}/counts")


def read_hierarchy(spark: SparkSession, path: str, place: str, start: int, end: int, coarse: int, fine: int) -> DataFrame:
    """Rows of [start, end): whole folders are left out, then row groups, then rows."""
    rows = spark.read.parquet(f"{path}/rows")
    near = (F.col("coarse") > start - coarse) & (F.col("coarse") < end) & (F.col("fine") > start - fine) & (F.col("fine") < end)
    return rows.where(near & (F.col(place) >= start) & (F.col(place) < end)).drop("coarse", "fine")


def counted_rows(rows: DataFrame) -> tuple[DataFrame, Observation]:
    """rows, and what is counted of them on the way to wherever they are written: reads, mapped, bases, references."""
    seen = Observation("ingest")
    mapped = F.col("reference_id") >= 0
    return rows.observe(seen, F.count(F.lit(1)).alias("reads"), F.count_if(mapped).alias("mapped"), F.sum(F.col("span").cast("long")).alias("bases"), F.approx_count_distinct(F.when(mapped, F.col("reference"))).alias("references")), seen


def snapshot(manifest: DataFrame, snapshots: DataFrame | None, snapshot_id: int) -> DataFrame:
    """snapshots with the manifest's paths under one more id; a snapshot is a list of paths, so rolling back is a filter."""
    entry = manifest.select(F.lit(snapshot_id).alias("snapshot_id"), "path", "reads")
    return entry if snapshots is None else snapshots.unionByName(entry)


def snapshot_changes(snapshots: DataFrame, old: int, new: int) -> DataFrame:
    """path, change: "added" or "removed" between two snapshots."""
    a, b = (snapshots.where(F.col("snapshot_id") == k).select("path", "reads") for k in (old, new))
    return b.exceptAll(a).select("path", F.lit("added").alias("change")).unionByName(a.exceptAll(b).select("path", F.lit("removed").alias("change")))


def union(datasets: Iterable[DataFrame]) -> DataFrame:
    """Rows of several datasets, columns matched by name, absent ones null."""
    out = None
    for rows in datasets:
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    if out is None:
        raise ValueError("no datasets")
    return out
