"""A store of variant calls with secondary indexes: by variant id, and by sample.

Calls (variant_id, position, sample, dosage) lie in chunks of position, one folder a
chunk; where a batch has more than FOLDERS chunks, a folder holds as many that follow one
another as keep folders to that number, and a column tells them apart.  Two indexes lie
beside them.

``ids`` tells for each variant id its chunk and position.  It is dealt over folders by
the id's hash, so a lookup of some ids reads the folders of those ids only, and then
only the chunks that it names.

``chunks`` is the manifest: a row a chunk with its counts and a Bloom filter of the
samples that carry something there, as 64-bit words made of column expressions.  The
chunks that may hold a sample are those in which all its bits are set: none is missed,
and a share of others, which false_positive_rate() measures, is read for nothing.

Filters of batches merge by or, counts by sums, so an append adds rows of its own to
the manifest and readers merge them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders of the id index; bits set for a sample; ids of a lookup that become a literal list of chunks, more are joined; folders of a batch's calls; the column of a call's chunk in its files.
BUCKETS, HASHES, LISTED, FOLDERS, CHUNK = 64, 4, 10_000, 256, "_chunk"


def _bucket(variant_id: Column) -> Column:
    return F.pmod(F.xxhash64(variant_id), F.lit(BUCKETS)).cast("int")


def _bits(sample: Column, bits: Column) -> Column:
    """The places of a sample's bits in a filter of that many bits."""
    return F.transform(F.sequence(F.lit(0), F.lit(HASHES - 1)), lambda k: F.pmod(F.xxhash64(sample, k), bits))


def _filters(carriers: DataFrame, bits: int) -> DataFrame:
    """chunk_start, words: the filter of each chunk of distinct (chunk_start, sample); a row holds bits / 64 numbers."""
    place = carriers.select("chunk_start", F.explode(_bits(F.col("sample"), F.lit(bits))).alias("place"))
    words = place.groupBy("chunk_start", F.expr("place div 64").cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(place % 64 as int))")).alias("value"))
    by_word = words.groupBy("chunk_start").agg(F.map_from_entries(F.collect_list(F.struct("word", "value"))).alias("by_word"))
    every = F.transform(F.sequence(F.lit(0), F.lit(bits // 64 - 1)), lambda k: F.coalesce(F.col("by_word")[k], F.lit(0).cast("long")))
    return by_word.select("chunk_start", every.alias("words"))


def write(calls: DataFrame, path: str, size: int, bits: int = 4096, mode: str = "overwrite") -> None:
    """calls in chunks of size, with both indexes; mode "append" adds a batch.  bits: of a chunk's filter, a multiple of 64; about 6 for each carrier of a chunk keep false hits near one in a hundred."""
    if bits % 64 or bits <= 0:
        raise ValueError("bits is no multiple of 64")
    chunked = calls.withColumn("chunk_start", F.expr(f"floor(position / {size}) * {size}").cast("long"))
    width = _folder_width(calls, size)
    in_folders = chunked.withColumns({CHUNK: F.col("chunk_start"), "chunk_start": _folder(F.col("chunk_start"), F.lit(width))})
    in_folders.hint("rebalance", "chunk_start").sortWithinPartitions("chunk_start", CHUNK, "position", "variant_id").write.mode(mode).partitionBy("chunk_start").parquet(f"{path}/calls")
    ids = chunked.select("variant_id", "chunk_start", "position").distinct().withColumn("bucket", _bucket(F.col("variant_id")))
    ids.repartition("bucket").sortWithinPartitions("bucket", "variant_id").write.mode(mode).partitionBy("bucket").parquet(f"{path}/ids")
    carriers = chunked.where("dosage <> 0").select("chunk_start", "sample").distinct()
    counts = chunked.groupBy("chunk_start").agg(F.count("*").alias("calls"), F.count_if(F.col("dosage") != 0).alias("stored"))
    entries = counts.join(_filters(carriers, bits), "chunk_start", "left").withColumns({"bits": F.lit(bits).cast("long"), "width": F.lit(width).cast("long")})
    entries.write.mode(mode).parquet(f"{path}/chunks")


def _folder_width(calls: DataFrame, size: int) -> int:
    """Places of a folder: of one chunk, or of the least power of two of chunks with which folders are FOLDERS at most."""
    least, most = calls.agg(F.min("position"), F.max("position")).first()
    chunks = 1 if least is None else int(most // size - least // size) + 1
    return size << (-(-chunks // FOLDERS) - 1).bit_length()


def _folder(chunk: Column, width: Column) -> Column:
    """The first place of the chunk's folder."""
    return chunk - F.pmod(chunk, width)


def _calls(files: DataFrame) -> DataFrame:
    """Calls with their own chunk instead of their folder's first place."""
    return files.withColumn("chunk_start", F.col(CHUNK)).drop(CHUNK)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """chunk_start, calls, stored, bits, words (null: no carrier): the manifest, its batches merged."""
    parts = spark.read.parquet(f"{path}/chunks")
    counts = parts.groupBy("chunk_start").agg(F.sum("calls").alias("calls"), F.sum("stored").alias("stored"), F.max("bits").alias("bits"))
    words = parts.where("words is not null").select("chunk_start", F.posexplode("words").alias("word", "value")).groupBy("chunk_start", "word").agg(F.bit_or("value").alias("value"))
    merged = words.groupBy("chunk_start").agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "value"))), lambda w: w["value"]).alias("words"))
    return counts.join(merged, "chunk_start", "left")


def _of_chunks(spark: SparkSession, path: str, chunks: DataFrame) -> DataFrame:
    """Calls of the chunks listed (chunk_start, distinct): folders named by a literal list if they are few, else by a join."""
    files = spark.read.parquet(f"{path}/calls")
    few = [r.chunk_start for r in chunks.limit(LISTED + 1).collect()]
    if len(few) > LISTED:
        return _calls(files).join(chunks, "chunk_start", "left_semi")
    widths = [r.width for r in spark.read.parquet(f"{path}/chunks").select("width").distinct().collect()]  # one a batch at most, and powers of two
    folders = {c // w * w for c in few for w in widths}
    return _calls(files.where(F.col("chunk_start").isin(list(folders)))).where(F.col("chunk_start").isin(few))


def find_ids(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """variant_id, chunk_start, position of the wanted ids (a column variant_id), from the folders of the index that may have them."""
    index, ids = spark.read.parquet(f"{path}/ids"), wanted.select("variant_id").distinct()
    buckets = [r[0] for r in ids.select(_bucket(F.col("variant_id"))).distinct().collect()]  # BUCKETS at most
    return index.where(F.col("bucket").isin(buckets)).join(ids, "variant_id", "left_semi").select("variant_id", "chunk_start", "position").distinct()


def lookup(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """All calls of the wanted ids (a column variant_id): only chunks that the index names are read."""
    found = find_ids(spark, path, wanted)
    calls = _of_chunks(spark, path, found.select("chunk_start").distinct())
    return calls.join(found.select("variant_id", "chunk_start", "position"), ["variant_id", "chunk_start", "position"], "left_semi")


def chunks_with(spark: SparkSession, path: str, sample: int | str) -> DataFrame:
    """chunk_start of the chunks that may hold something of a sample."""
    kind = spark.read.parquet(f"{path}/calls").schema["sample"].dataType  # a number's hash depends on its type
    mine = _bits(F.lit(sample).cast(kind), F.col("bits"))
    held = _all_set(mine)
    return read_chunks(spark, path).where(F.col("words").isNotNull() & held).select("chunk_start")


def _all_set(places: Column) -> Column:
    return F.forall(places, lambda p: F.getbit(F.element_at("words", F.shiftright(p, 6).cast("int") + 1), F.pmod(p, F.lit(64)).cast("int")) == 1)


def of_sample(spark: SparkSession, path: str, sample: int | str) -> DataFrame:
    """What a sample carries: only chunks whose filter lets it pass are read."""
    return _of_chunks(spark, path, chunks_with(spark, path, sample)).where((F.col("sample") == F.lit(sample)) & (F.col("dosage") != 0))


def false_positive_rate(spark: SparkSession, path: str, samples: DataFrame) -> DataFrame:
    """pairs (of samples and chunks they carry nothing in), passed (those that the filter lets pass nonetheless), rate."""
    calls = _calls(spark.read.parquet(f"{path}/calls")).where("dosage <> 0").select("chunk_start", "sample").distinct()
    chunks = read_chunks(spark, path).where("words is not null").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(15))))
    asked = samples.select("sample").distinct().withColumn("block", F.pmod(F.xxhash64("sample"), F.lit(16)).cast("int"))
    free = asked.join(chunks, "block").join(calls, ["chunk_start", "sample"], "left_anti")
    out = free.agg(F.count("*").alias("pairs"), F.count_if(_all_set(_bits(F.col("sample"), F.col("bits")))).alias("passed"))
    return out.withColumn("rate", F.try_divide("passed", "pairs"))
