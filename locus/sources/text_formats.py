"""Text sources and sinks: aligned reads (SAM), variants (VCF), reads (FASTQ), regions (BED), sample sheets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from locus.functions.codecs import header_fields, reference_span, tag_text, tags_map

#: The eleven mandatory fields of an alignment line, in order.
FIELDS = ("name", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "sequence", "quality")


def sam_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def sam_header(lines: DataFrame) -> DataFrame:
    """number (order of the lines), kind (HD, SQ, RG, PG, CO) and fields (map; a comment's text under "text")."""
    head = lines.select(F.monotonically_increasing_id().alias("number"), "value").where(F.col("value").startswith("@"))
    kind = F.substring("value", 2, 2)
    return head.select("number", kind.alias("kind"), F.when(kind == "CO", F.create_map(F.lit("text"), F.substr("value", F.lit(5)))).otherwise(header_fields(F.col("value"))).alias("fields"))


def format_header(header: DataFrame) -> DataFrame:
    """number, value: the header's lines again, @HD first, then @SQ, the others, comments last; fields keep their order."""
    fields = F.transform(F.map_entries("fields"), lambda e: F.concat_ws(":", e["key"], e["value"]))
    line = F.when(F.col("kind") == "CO", F.concat_ws("\t", F.lit("@CO"), F.col("fields")["text"])).otherwise(F.concat_ws("\t", F.concat(F.lit("@"), "kind"), fields))
    rank = F.when(F.col("kind") == "HD", 0).when(F.col("kind") == "SQ", 1).when(F.col("kind") == "CO", 3).otherwise(2)
    return header.select(F.struct(rank.alias("rank"), "number").alias("number"), line.alias("value"))


def sam_references(spark: SparkSession, path: str) -> DataFrame:
    """reference_id (order of the header's SQ lines), reference, length.  Of several files each name counts once, where it comes first.  Headers are a bounded number of lines."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line"))
    listed = lines.where(F.col("value").startswith("@SQ")).select("file", "line", header_fields(F.col("value")).alias("f"))
    rows = listed.groupBy(F.col("f")["SN"].alias("reference")).agg(F.min(F.struct("file", "line", F.col("f")["LN"].cast("long").alias("length"))).alias("first"))
    every = rows.agg(F.array_sort(F.collect_list(F.struct("first.file", "first.line", "reference", "first.length"))).alias("all"))
    return every.select(F.posexplode("all").alias("reference_id", "r")).select("reference_id", "r.reference", "r.length")


def parse_sam(lines: DataFrame) -> DataFrame:
    """Rows of well-formed alignment lines (eleven fields or more, numbers where they belong); positions become 0-based, "*" null."""
    f = F.split("value", "\t")
    body = lines.where(~F.col("value").startswith("@")).select(f.alias("f")).where(F.size("f") >= len(FIELDS))
    field = {n: F.col("f")[k] for k, n in enumerate(FIELDS)}

    def text(name: str) -> Column:
        return F.nullif(field[name], F.lit("*"))

    def number(name: str) -> Column:
        return field[name].try_cast("int")

    rows = body.select(
        field["name"].alias("name"), number("flag").alias("flag"), text("rname").alias("reference"), (number("pos") - 1).alias("position"), number("mapq").alias("mapq"),
        text("cigar").alias("cigar"), F.when(field["rnext"] == "=", text("rname")).otherwise(text("rnext")).alias("mate_reference"), (number("pnext") - 1).alias("mate_position"),
        number("tlen").alias("template_length"), text("sequence").alias("sequence"), text("quality").alias("quality"), tags_map(F.slice("f", 12, F.size("f"))).alias("tags"),
    )
    return rows.where("flag is not null and position is not null and mapq is not null").withColumn("span", reference_span(F.col("cigar")).cast("int"))


def malformed(lines: DataFrame) -> DataFrame:
    """Alignment lines that parse_sam leaves out."""
    f = F.split("value", "\t")
    bad = (F.size(f) < len(FIELDS)) | f[1].try_cast("int").isNull() | f[3].try_cast("int").isNull() | f[4].try_cast("int").isNull()
    return lines.where(~F.col("value").startswith("@") & F.coalesce(bad, F.lit(True)))


def format_sam(rows: DataFrame) -> DataFrame:
    """One line a row, the inverse of parse_sam; mates, CIGAR and tags are kept."""

    def text(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit("*"))

    mate = F.when(F.col("mate_reference").isNull(), "*").when(F.col("mate_reference").eqNullSafe(F.col("reference")), "=").otherwise(F.col("mate_reference"))
    tags = F.transform(F.array_sort(F.map_entries(F.coalesce("tags", F.create_map().cast("map<string,string>")))), lambda t: tag_text(t["key"], t["value"]))
    columns = [F.col("name"), F.col("flag"), text("reference"), F.col("position") + 1, F.col("mapq"), text("cigar"), mate, F.col("mate_position") + 1, F.col("template_length"), text("sequence"), text("quality")]
    return rows.select(F.concat_ws("\t", *(c.cast("string") for c in columns), tags).alias("value"))


def format_simple(rows: DataFrame) -> DataFrame:
    """One line a row without mates and tags: the display form, not the inverse of parse_sam."""
    given = [F.coalesce(F.col(c), F.lit("*")) for c in ("reference", "cigar", "sequence", "quality")]
    columns = [F.col("name"), F.col("flag"), given[0], F.col("position") + 1, F.col("mapq"), given[1], F.lit("*"), F.lit(0), F.lit(0), *given[2:]]
    return rows.select(F.concat_ws("\t", *(c.cast("string") for c in columns)).alias("value"))


def write_sam(rows: DataFrame, references: DataFrame, path: str, header: DataFrame | None = None) -> None:
    """Part files in (reference_id, position) order, unmapped rows last; the header (as sam_header's, or without one the references alone) is a file of its own before them."""
    if header is None:
        header = references.select(F.col("reference_id").cast("long").alias("number"), F.lit("SQ").alias("kind"), F.create_map(F.lit("SN"), "reference", F.lit("LN"), F.col("length").cast("string")).alias("fields"))
    format_header(header).coalesce(1).sortWithinPartitions("number").select("value").write.mode("overwrite").text(f"{path}/header")
    order = rows.join(references.select("reference", "reference_id"), "reference", "left").orderBy(F.col("reference_id").asc_nulls_last(), "position", "name")
    format_sam(order).write.mode("overwrite").text(f"{path}/body")


def write_vcf(head: list[str], lines: DataFrame, path: str) -> None:
    """head (header lines) and lines (position, value) as a folder that reads as one file: the header's piece, and that of the variants in order of position, each task its range."""
    lines.sparkSession.createDataFrame([(h,) for h in head], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/piece=0")
    lines.repartitionByRange("position").sortWithinPartitions("position").select("value").write.mode("overwrite").text(f"{path}/piece=1")


def read_vcf_lines(spark: SparkSession, path: str) -> DataFrame:
    """value, file, line (order within a file's header); pieces of one folder, as write_vcf() leaves them, are one file."""
    file = F.regexp_replace(F.col("_metadata.file_path"), "/piece=[01]/[^/]*$", "")
    return spark.read.text(path).select("value", file.alias("file"), F.monotonically_increasing_id().alias("line"))


def vcf_sites(lines: DataFrame) -> DataFrame:
    """reference, position (0-based), id, ref, alt, qual, filter, depth (DP of INFO): one row a variant line; numbers that are none are null."""
    f = F.split("value", "\t")
    text = [F.nullif(f[k], F.lit(".")) for k in range(8)]
    depth = F.regexp_extract(f[7], "(?:^|;)DP=([0-9]+)", 1).try_cast("int")
    return lines.where(~F.col("value").startswith("#")).select(
        f[0].alias("reference"), (f[1].cast("long") - 1).alias("position"), text[2].alias("id"), f[3].alias("ref"), f[4].alias("alt"), text[5].try_cast("double").alias("qual"), text[6].alias("filter"), depth.alias("depth")
    )


def parse_vcf(lines: DataFrame) -> DataFrame:
    """sample, reference, position (0-based), ref, alt, genotype: only genotypes that differ from the reference and are called.  Each file's calls have the names of its own header; lines without a column file are one file's."""
    if "file" not in lines.columns:
        lines = lines.withColumn("file", F.lit(""))
    head = lines.where(F.col("value").startswith("#CHROM")).groupBy("file").agg(F.slice(F.split(F.first("value"), "\t"), 10, 1 << 30).alias("samples"))
    body = lines.where(~F.col("value").startswith("#")).select("file", F.split("value", "\t").alias("f")).join(head, "file")
    calls = body.select(
        F.col("f")[0].alias("reference"), (F.col("f")[1].cast("long") - 1).alias("position"), F.col("f")[3].alias("ref"), F.split(F.col("f")[4], ",").alias("alt"),
        F.explode(F.arrays_zip("samples", F.slice("f", 10, 1 << 30).alias("calls"))).alias("c"),
    )
    genotype = F.split(F.col("c.calls"), ":")[0]
    return calls.select(F.col("c.samples").alias("sample"), "reference", "position", "ref", "alt", genotype.alias("genotype")).where(~F.regexp_like("genotype", F.lit("^[0.]([/|][0.])*$")))


def concat_vcf(lines: DataFrame) -> DataFrame:
    """value, in order: variant files of regions (value, file, line) as one: header lines once each, then all variants by reference and position; lines that overlapping regions share stay once.

    The files must have the same samples; otherwise this is an error when it runs.
    """
    first = F.min(F.struct("file", "line")).alias("first")
    meta = lines.where(F.col("value").startswith("##")).groupBy("value").agg(first)
    chrom = lines.where(F.col("value").startswith("#CHROM")).agg(F.count_distinct("value").alias("n"), F.min("value").alias("value"), first)
    chrom = chrom.select(F.when(F.col("n") <= 1, F.col("value")).otherwise(F.raise_error(F.lit("the files have different samples"))).alias("value"), "first").where("value is not null")
    contig = F.regexp_extract("value", "^##contig=<ID=([^,>]+)", 1)
    order = meta.where(contig != "").groupBy(contig.alias("reference")).agg(F.min("first").alias("first"))
    f = F.split("value", "\t")
    body = lines.where(~F.col("value").startswith("#")).select("value").distinct().select("value", f[0].alias("reference"), f[1].cast("long").alias("position")).join(order, "reference", "left")
    none = [F.lit(None).cast("string").alias("reference"), F.lit(None).cast("long").alias("position")]
    rows = meta.select("value", F.lit(0).alias("rank"), "first", *none).unionByName(chrom.select("value", F.lit(1).alias("rank"), "first", *none))
    rows = rows.unionByName(body.select("value", F.lit(2).alias("rank"), "first", "reference", "position"))
    return rows.orderBy("rank", F.col("first").asc_nulls_last(), "reference", "position", "value").select("value")


def _fastq_pieces(spark: SparkSession, path: str) -> DataFrame:
    """file, number, f: the lines of each piece, numbered within its file."""
    raw = spark.read.option("lineSep", "\n@").text(path)
    pieces = raw.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    # One row a block: the number of a file's pieces before it.
    blocks = pieces.groupBy("file", "block").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("file", "block", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    numbered = pieces.join(starts, ["file", "block"]).withColumn("number", F.col("id") + F.col("shift"))
    # Only a file's first piece still has its "@".
    f = F.split(F.when(F.col("number") == 0, F.regexp_replace("value", "^@", "")).otherwise(F.col("value")), "\n")
    return numbered.select("file", "number", f.alias("f"))


def _fastq_records(pieces: DataFrame) -> DataFrame:
    """file, number, f, quality, tail: every piece with its quality line, if it has one, and whether that is the piece after it."""
    record = (F.size("f") >= 3) & F.get("f", F.lit(2)).startswith("+")
    tails = pieces.where((F.size("f") == 1) | ((F.size("f") == 2) & (F.get("f", F.lit(1)) == ""))).select("file", (F.col("number") - 1).alias("number"), F.concat(F.lit("@"), F.get("f", F.lit(0))).alias("next"))
    both = pieces.join(tails, ["file", "number"], "left")
    quality = F.when(record & (F.size("f") >= 4), F.get("f", F.lit(3))).when(record & (F.size("f") == 3), F.col("next"))
    fine = F.coalesce(F.length(F.get("f", F.lit(1))) == F.length(quality), F.lit(False))
    return both.select("file", "number", "f", F.when(fine, quality).alias("quality"), (fine & (F.size("f") == 3)).alias("tail"))


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """read_id, sequence, quality.  Records are split at line ends before "@"; a quality line that begins with "@" is the piece after its record's, and joined to it by the pieces' numbers in their file.  Other pieces are malformed_fastq()'s."""
    whole = _fastq_records(_fastq_pieces(spark, path)).where("quality is not null")
    return whole.select(F.split(F.col("f")[0], " ")[0].alias("read_id"), F.col("f")[1].alias("sequence"), "quality")


def malformed_fastq(spark: SparkSession, path: str) -> DataFrame:
    """file, number (the piece's place in the file), value: what read_fastq() leaves out: pieces that are no record, nor the quality line of the record before."""
    records = _fastq_records(_fastq_pieces(spark, path))
    used = records.where("tail").select("file", (F.col("number") + 1).alias("number"))
    rest = records.where("quality is null").join(used, ["file", "number"], "left_anti")
    return rest.select("file", "number", F.array_join("f", "\n").alias("value")).where("trim(value) <> ''")


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """name, reference, start, end."""
    rows = spark.read.csv(path, sep="\t", schema="reference string, start long, end long")
    return rows.select(F.concat_ws("_", "reference", "start", "end").alias("name"), "reference", "start", "end")


def first_lines(lines: DataFrame, n: int) -> DataFrame:
    """The first n lines in file order; Spark reads no further than it must."""
    return lines.limit(n)


def line_counts(lines: DataFrame, comment: str) -> DataFrame:
    """lines, records (lines that do not begin with comment)."""
    return lines.agg(F.count("*").alias("lines"), F.count_if(~F.col("value").startswith(comment)).alias("records"))


def read_sample_sheet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema="sample_id string, reads_r1 string, reads_r2 string")
