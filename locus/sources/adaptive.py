"""Datasets whose chunks are as wide as the rows are dense: about as many rows in each.

Where chunks end is found by mergeable quantile sketches, not by ranking all rows:
each pass sketches the positions of every range that is still too full (partial
sketches in the tasks, merged by Spark) and splits it at even ranks into up to FAN
ranges.  A range of n times the target thus needs log n / log FAN passes.  A place
that has more rows than the target by itself stays one chunk.

The chunk map (reference, start, end, rows, longest span) takes the place of
``position div size``: rows find their chunk by an interval join with it, and a reader
turns a region into the map's chunks, which prune folders.  A folder holds one chunk,
or, where there are more than FOLDERS, as many that follow one another as keep folders
near that number; a column of the files then tells a folder's chunks apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from locus.operators import intervals
from locus.operators.regions import Region
from locus.sources.shared import materialised, scratch

#: Ranges that one pass makes of one at most, ranks that a sketch is asked for, the sketches' size, chunks of a region that become a literal list, folders (besides one a reference), and the files' column of a row's chunk.
FAN, GRID, SKETCH, LISTED, FOLDERS, CHUNK = 32, 320, 4000, 10_000, 512, "_chunk"


def chunk_map(rows: DataFrame, target: int) -> DataFrame:
    """reference, start, end (half-open; they cover all positions, the outermost go on for ever), rows of about target rows each."""
    with scratch(rows.sparkSession) as folder:
        return materialised(_chunk_map(rows, target, folder))


def _chunk_map(rows: DataFrame, target: int, folder: str) -> DataFrame:
    places = materialised(rows.where("reference is not null and position is not null").select("reference", F.col("position").cast("long").alias("position")), folder)
    least, most = -(1 << 62), 1 << 62
    ranges = materialised(places.groupBy("reference").agg(F.count("*").alias("rows")).select("reference", F.lit(least).alias("start"), F.lit(most).alias("end"), "rows"), folder)
    done = ranges.where(F.col("rows") < 1.5 * target)
    full = ranges.where(F.col("rows") >= 1.5 * target)
    while full.limit(1).count():
        inside = of_ranges(places, full)
        sketched = inside.groupBy("reference", "start", "end").agg(F.kll_sketch_agg_bigint("position", SKETCH).alias("sketch"), F.count("*").alias("rows"), F.min("position").alias("lowest"), F.max("position").alias("highest"))
        # Parts such that each is then a whole number of targets, as nearly as can be.
        whole = F.round(F.col("rows") / target)
        n = F.ceil(whole / F.ceil(whole / FAN)).cast("int")
        # The sketch is asked for places at fixed even ranks (Spark wants them constant); those nearest to a range's own ranks are its cuts.
        places_at = F.kll_sketch_get_quantile_bigint("sketch", F.array(*(F.lit(k / GRID) for k in range(1, GRID))))
        cuts = F.transform(F.sequence(F.lit(1), n - 1), lambda k: F.element_at(places_at, F.round(k * GRID / n).cast("int")) + 1)
        starts = F.array_sort(F.array_distinct(F.concat(F.array("start"), F.filter(cuts, lambda c: (c > F.col("lowest")) & (c <= F.col("highest"))))))
        ends = F.concat(F.slice(starts, 2, F.size(starts)), F.array("end"))
        split = sketched.select("reference", F.size(starts).alias("parts"), F.explode(F.arrays_zip(starts.alias("start"), ends.alias("end"))).alias("r"))
        split = materialised(split.select("reference", F.col("r.start").alias("start"), F.col("r.end").alias("end"), "parts"), folder)
        counted = materialised(of_ranges(places, split).groupBy("reference", "start", "end", "parts").agg(F.count("*").alias("rows")), folder)
        # What one place fills by itself cannot be split again.
        more = (F.col("rows") >= 1.5 * target) & (F.col("parts") > 1)
        done = done.unionByName(counted.where(~more).drop("parts"))
        full = counted.where(more).drop("parts")
    return done


def of_ranges(rows: DataFrame, ranges: DataFrame) -> DataFrame:
    """rows with the other columns of the range (reference, start, end, ...) that their position lies in."""
    met = intervals.overlap_join(rows, ranges, "reference", ("position", None), ("start", "end"))
    return met.select("left.*", *(F.col(f"right.{c}").alias(c) for c in ranges.columns if c != "reference"))


def write(rows: DataFrame, path: str, target: int, codec: str = "zstd") -> None:
    """rows (reference, position, span, ...) as a dataset of chunks of about target rows, with its map; rows without a place form a chunk of their own."""
    spark = rows.sparkSession
    own = _in_folders(chunk_map(rows, target))
    placed = of_ranges(rows.where("reference is not null and position is not null"), own.select("reference", "start", "end", "folder")).withColumnsRenamed({"start": CHUNK, "folder": "chunk_start"}).drop("end")
    unplaced = rows.where("reference is null or position is null").withColumns({"reference": F.lit(None).cast("string"), "chunk_start": F.lit(None).cast("long"), CHUNK: F.lit(None).cast("long")})
    whole = placed.unionByName(unplaced.select(placed.columns))
    whole.hint("rebalance", "reference", "chunk_start").sortWithinPartitions("reference", "chunk_start", CHUNK, "position").write.mode("overwrite").option("compression", codec).partitionBy("reference", "chunk_start").parquet(f"{path}/data")
    spans = read(spark, path).where("reference is not null").groupBy("reference", F.col("chunk_start").alias("start")).agg(F.max("span").alias("max_span"))
    own.join(spans, ["reference", "start"]).write.mode("overwrite").parquet(f"{path}/map")


def _in_folders(chunks: DataFrame) -> DataFrame:
    """chunks with folder: the start of the first chunk of theirs; a row a chunk is all that is ordered here."""
    per = -(-chunks.count() // FOLDERS) or 1
    numbered = chunks.withColumn("_group", F.expr(f"(row_number() over (partition by reference order by start) - 1) div {per}"))
    return numbered.withColumn("folder", F.min("start").over(Window.partitionBy("reference", "_group"))).drop("_group")


def _of_files(files: DataFrame) -> DataFrame:
    """Files' rows with their own chunk instead of their folder's first."""
    return files.withColumns({"reference": F.col("reference").cast("string"), "chunk_start": F.col(CHUNK)}).drop(CHUNK)


def read(spark: SparkSession, path: str) -> DataFrame:
    return _of_files(spark.read.parquet(f"{path}/data"))


def read_map(spark: SparkSession, path: str) -> DataFrame:
    """reference, start, end, rows, folder, max_span of every chunk."""
    return spark.read.parquet(f"{path}/map")


def chunks_of(spark: SparkSession, path: str, region: Region, reach: bool = False) -> DataFrame:
    """start and folder of the chunks that may hold rows of the region; reach: also rows that begin before it and extend into it."""
    near = (F.col("reference") == region.reference) & (F.col("end") + (F.coalesce("max_span", F.lit(0)) if reach else F.lit(0)) > region.start)
    return read_map(spark, path).where(near if region.end is None else near & (F.col("start") < region.end)).select("start", "folder")


def query(spark: SparkSession, path: str, region: Region | str, mode: str = "start") -> DataFrame:
    """Rows of a region: mode "start" those that begin in it, "overlap" those that cover a base of it."""
    region = Region.parse(region) if isinstance(region, str) else region
    overlap = mode == "overlap"
    chunks = chunks_of(spark, path, region, overlap)
    few = chunks.limit(LISTED + 1).collect()
    files = spark.read.parquet(f"{path}/data").where(F.col("reference") == region.reference)
    if len(few) <= LISTED:
        rows = _of_files(files.where(F.col("chunk_start").isin(list({r.folder for r in few})))).where(F.col("chunk_start").isin([r.start for r in few]))
    else:
        rows = _of_files(files).join(chunks.select(F.col("start").alias("chunk_start")), "chunk_start", "left_semi")
    inside = (F.col("position") + F.col("span") > region.start) if overlap else (F.col("position") >= region.start)
    return rows.where(inside if region.end is None else inside & (F.col("position") < region.end))
