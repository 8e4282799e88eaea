"""Benchmark decontamination: size-partitioned MinHash containment search, DataFrame operations only.

An item is its set of distinct five-word shingles (A-Z lower-cased; with fewer
words, its whole sequence is the one shingle).  A document contains an item if it
has at least ``threshold`` of the item's shingles.  Then it lacks fewer than
1 - threshold of them, so of an item's k = s - ceil(threshold * s) + 1 smallest
hashes it has at least one.  Items are partitioned by their size s, and a
partition's sketch keeps that many minima of each item: the search misses no
contained item, however long the document.  Documents that meet a sketch are
verified by the exact share of shingles, compared as text.

Every shingle of every document meets the sketches in one join on hashes, and the
documents that meet one are read again to be verified.  Either join broadcasts its
smaller side if that is counted to be at most BROADCAST_ROWS, and shuffles beyond.

Null, empty and blank texts contain nothing, and such items are contained in
nothing, nor are items without an id.  Rows of one doc_id count as one document
that contains what any of them contains; so do rows without an id.  Repeated items
count once.  Extra columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locus.sources.shared import materialised, scratch

SHINGLE = 5
BROADCAST_ROWS = 500_000


def words(text: str) -> Column:
    low = F.translate(F.coalesce(F.col(text), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.filter(F.split(low, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def _hash(run: Column) -> Column:
    return F.xxhash64(run)


def _text(run: Column) -> Column:
    return F.concat_ws(" ", run)


def _runs(array: Column, size: int | Column, of) -> Column:
    """of(run) for every run of size elements; none in a shorter array."""
    last = F.size(array) - size + 1
    return F.transform(F.slice(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), 2, F.greatest(last, F.lit(0))), lambda i: of(F.slice(array, i, size)))


def _bounded(rows: DataFrame) -> DataFrame:
    """A written table, with a hint to broadcast it if it is counted to be small."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def contained(docs: DataFrame, items: DataFrame, threshold: float = 0.75) -> DataFrame:
    """doc_id, item_id, n_shared, n_item, containment for every document that contains an item."""
    with scratch(docs.sparkSession) as folder:
        return materialised(_contained(docs, items, threshold, folder))


def _contained(docs: DataFrame, items: DataFrame, threshold: float, folder: str) -> DataFrame:
    sized = items.where("item_id is not null").select("item_id", words("text").alias("w")).where(F.size("w") > 0).withColumn("width", F.least(F.size("w"), F.lit(SHINGLE)))
    runs = sized.select("item_id", "width", F.explode(_runs(F.col("w"), F.col("width"), lambda r: F.struct(_text(r).alias("shingle"), _hash(r).alias("hash")))).alias("r"))
    whole = Window.partitionBy("item_id")
    shingles = materialised(
        runs.select("item_id", "width", "r.*")
        .distinct()
        .withColumn("n_item", F.count("*").over(whole))
        .withColumn("place", F.row_number().over(whole.orderBy("hash", "shingle"))),
        folder,
    )
    # A partition of items is all those of one size; its sketch has as many minima as that size needs.
    sketch_size = F.col("n_item") - F.ceil(F.col("n_item") * threshold - 1e-9) + 1
    keys = materialised(shingles.where(F.col("place") <= sketch_size).select("item_id", "width", "hash").distinct(), folder)
    widths = sorted(r.width for r in keys.select("width").distinct().collect())  # at most SHINGLE of them

    # A row's name; rows that share one by chance are merely verified for nothing.
    rows = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row"))
    hashes = F.concat(F.array().cast("array<bigint>"), *(_runs(F.col("w"), width, _hash) for width in widths))
    met = rows.select("row", words("text").alias("w")).select("row", F.explode(hashes).alias("hash")).join(_bounded(keys), "hash")
    pairs = materialised(met.select("row", "item_id", "width").distinct(), folder)
    marked = rows.join(_bounded(materialised(pairs.select("row").distinct(), folder)), "row", "left_semi")
    wanted = shingles.groupBy("item_id", "n_item").agg(F.collect_set("shingle").alias("shingles"))
    return (
        marked.select("row", "doc_id", words("text").alias("w"))
        .join(pairs, "row")
        .join(wanted, "item_id")
        .select("doc_id", "item_id", "n_item", F.size(F.array_intersect("shingles", _runs(F.col("w"), F.col("width"), _text))).alias("n_shared"))
        .groupBy("doc_id", "item_id")
        .agg(F.max("n_shared").cast("long").alias("n_shared"), F.max("n_item").cast("long").alias("n_item"))
        .withColumn("containment", F.col("n_shared") / F.col("n_item"))
        .where(F.col("containment") >= threshold - 1e-9)
    )


def clean(docs: DataFrame, items: DataFrame, threshold: float = 0.75) -> DataFrame:
    """docs without the rows that contain an item; rows of one doc_id, or without one, are judged each by its own text."""
    digest = F.sha2("text", 256)
    dirty = contained(docs.select(F.struct("doc_id", digest.alias("digest")).alias("doc_id"), "text"), items, threshold).select(F.col("doc_id.doc_id").alias("dirty_id"), F.col("doc_id.digest").alias("dirty_digest")).distinct()
    return docs.join(dirty, docs["doc_id"].eqNullSafe(dirty["dirty_id"]) & (digest == dirty["dirty_digest"]), "left_anti")
