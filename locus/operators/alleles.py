"""Alleles in one form: trimmed, left-aligned, split and merged.

Sites are rows (reference, position (0-based), ref, alt).  A variant may be written in
several ways; its normal form shares no end with the reference allele but the base
before an insertion or deletion, and lies as far left as it can.

Trimming is column expressions.  How far an indel moves left depends on the reference
sequence before it, which comes in chunks of bases and is joined by chunk number: a
site sees the rest of its chunk to the left and, in further rounds, chunk after chunk,
until nothing moves any more, so no task holds a sequence.

split() makes one row of each alternative, merge() one site of all alternatives that
have one position, with the longest reference allele and the genotypes renumbered; a
site's alternatives are gathered, its samples stay rows of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from locus.sources.shared import materialised, scratch

#: Bases of a chunk of the reference sequence.
CHUNK = 1 << 14


def sequence_chunks(sequences: DataFrame, size: int = CHUNK) -> DataFrame:
    """reference, chunk, bases of (reference, sequence)."""
    n = F.greatest(F.ceil(F.length("sequence") / size), F.lit(1)).cast("int")
    cut = F.posexplode(F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.substr(F.col("sequence"), k * size + 1, F.lit(size)))).alias("chunk", "bases")
    return sequences.select("reference", cut)


def _shared(a: Column, b: Column) -> Column:
    """How many characters two texts begin with in common."""
    n = F.least(F.length(a), F.length(b))
    differ = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: F.substr(a, k, F.lit(1)) != F.substr(b, k, F.lit(1)))
    return F.when(n == 0, 0).otherwise(F.coalesce(F.get(differ, F.lit(0)) - 1, n))


def trimmed(sites: DataFrame) -> DataFrame:
    """sites with ref and alt in upper case, less what both end with, then less what both begin with but for one base; equal alleles stay as they are."""
    up = sites.withColumns({"ref": F.upper("ref"), "alt": F.upper("alt")})
    least = F.least(F.length("ref"), F.length("alt"))
    tail = F.least(_shared(F.reverse("ref"), F.reverse("alt")), least - 1)
    same = (F.col("ref") == F.col("alt")) | (least < 1)
    cut = up.withColumn("_t", F.when(same, 0).otherwise(tail))
    cut = cut.withColumns({c: F.left(c, F.length(c) - F.col("_t")) for c in ("ref", "alt")}).drop("_t")
    head = F.least(_shared(F.col("ref"), F.col("alt")), F.least(F.length("ref"), F.length("alt")) - 1)
    cut = cut.withColumn("_h", F.when((F.col("ref") == F.col("alt")) | (F.least(F.length("ref"), F.length("alt")) < 1), 0).otherwise(head))
    moved = {c: F.substr(F.col(c), F.col("_h") + 1) for c in ("ref", "alt")}
    return cut.withColumns({**moved, "position": (F.col("position") + F.col("_h")).cast("long")}).drop("_h")


def _left(position: int, ref: str, alt: str, first: int, bases: str) -> tuple[int, str, str, bool]:
    """An indel moved left within the bases, which begin at the place first; whether it could move on before them."""
    while ref and alt and ref[-1] == alt[-1] and (len(ref) > 1 or len(alt) > 1):
        if len(ref) > 1 and len(alt) > 1:
            ref, alt = ref[:-1], alt[:-1]
            continue
        if position == 0:
            break
        if position - 1 < first:
            return position, ref, alt, True
        before = bases[position - 1 - first]
        position, ref, alt = position - 1, before + ref[:-1], before + alt[:-1]
    return position, ref, alt, False


def normalised(sites: DataFrame, chunks: DataFrame, size: int = CHUNK) -> DataFrame:
    """sites in normal form; chunks: sequence_chunks().  Sites whose sequence is not there, and alleles that are no bases (such as <DEL>), are only trimmed, or left alone."""
    with scratch(sites.sparkSession) as folder:
        return materialised(_normalised(sites, chunks, size, folder))


def _normalised(sites: DataFrame, chunks: DataFrame, size: int, folder: str) -> DataFrame:
    plain = F.col("ref").rlike("^[A-Za-z]+$") & F.col("alt").rlike("^[A-Za-z]+$")
    others = sites.where(~F.coalesce(plain, F.lit(False)))
    rows = trimmed(sites.where(plain))
    indel = F.length("ref") != F.length("alt")
    done, at = [others, rows.where(~indel)], materialised(rows.where(indel), folder)
    schema = at.schema
    names = schema.names
    where = [names.index(c) for c in ("position", "ref", "alt")]

    def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = [batch.column(k).to_pylist() for k in where]
            chunk, bases = (batch.column(c).to_pylist() for c in (len(names), len(names) + 1))
            found = [(p, r, a, False) if b is None else _left(p, r, a, c * size, b.upper()) for p, r, a, c, b in zip(*given, chunk, bases, strict=True)]
            columns = list(batch.columns[: len(names)])
            for k, values in zip(where, zip(*found, strict=True), strict=False):
                columns[k] = pa.array(values, columns[k].type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array([f[3] for f in found], pa.bool_())], [*names, "_more"])

    # In the first round a site looks into the chunk of its position; one that goes on then needs the chunk before.
    place = F.expr(f"position div {size}")
    while at.limit(1).count():
        seen = at.withColumn("_chunk", place.cast("int")).join(chunks.select("reference", F.col("chunk").alias("_chunk"), F.col("bases").alias("_bases")), ["reference", "_chunk"], "left")
        out = materialised(seen.select(*names, "_chunk", "_bases").mapInArrow(moved, T.StructType([*schema.fields, T.StructField("_more", T.BooleanType())])), folder)
        done.append(out.where(~F.col("_more")).drop("_more"))
        at = out.where("_more").drop("_more")
        place = F.expr(f"(position - 1) div {size}")
    result = done[0]
    for d in done[1:]:
        result = result.unionByName(d.select(result.columns))
    return result


def split(calls: DataFrame) -> DataFrame:
    """One row for each alternative of rows (reference, position, ref, alts (array), sample, genotype): alt instead of alts, and genotypes in which this alternative is 1, the reference and every other one 0, a missing one missing."""
    each = calls.select("*", F.posexplode("alts").alias("_k", "alt"))
    slots = F.split("genotype", "[/|]")
    mark = F.when(F.contains("genotype", F.lit("|")), "|").otherwise("/")
    number = F.transform(slots, lambda s: F.when(s == ".", ".").when(s == (F.col("_k") + 1).cast("string"), "1").otherwise("0"))
    return each.withColumn("genotype", F.call_function("array_join", number, mark)).drop("alts", "_k")


def merge(calls: DataFrame) -> DataFrame:
    """Rows (reference, position, ref, alts, sample, genotype) of rows with one alternative each: the alternatives of one position, in order, on its longest reference allele.

    Of a sample's rows at a site each slot of the genotype takes the number of the
    alternative that one of them has there (the greatest, should several have one),
    0 if none has, and is missing if all that it has are.
    """
    site = ["reference", "position"]
    widest = calls.groupBy(*site).agg(F.max_by("ref", F.length("ref")).alias("wide"))
    wide = calls.join(widest, site)
    longer = wide.withColumn("alt", F.concat("alt", F.substr(F.col("wide"), F.length("ref") + 1)))
    alts = longer.groupBy(*site, "wide").agg(F.array_sort(F.collect_set("alt")).alias("alts"))
    numbered = longer.join(alts.select(*site, "alts"), site).withColumn("_k", F.array_position("alts", F.col("alt")).cast("string"))
    slots = F.transform(F.split("genotype", "[/|]"), lambda s: F.when(s == ".", F.lit(-1)).when(s == "0", F.lit(0)).otherwise(F.col("_k").cast("int")))
    rows = numbered.select(*site, F.col("wide").alias("ref"), "alts", "sample", F.contains("genotype", F.lit("|")).alias("phased"), F.posexplode(slots).alias("slot", "number"))
    best = rows.groupBy(*site, "ref", "alts", "sample", "slot").agg(F.max("number").alias("number"), F.max("phased").alias("phased"))
    text = F.when(F.col("number") < 0, ".").otherwise(F.col("number").cast("string"))
    joined = best.groupBy(*site, "ref", "alts", "sample").agg(F.array_sort(F.collect_list(F.struct("slot", text.alias("text")))).alias("s"), F.max("phased").alias("phased"))
    return joined.select(*site, "ref", "alts", "sample", F.call_function("array_join", F.transform("s", lambda x: x["text"]), F.when(F.col("phased"), "|").otherwise("/")).alias("genotype"))


def vcf_lines(merged: DataFrame, samples: list[str]) -> DataFrame:
    """reference, position, value: a variant line for each site of merge()'s rows, one genotype column for each of the samples (0/0 where a sample has no row)."""
    wide = merged.where(F.col("sample").isin(samples)).groupBy("reference", "position", "ref", "alts").pivot("sample", samples).agg(F.first("genotype"))
    columns = [F.coalesce(F.col(f"`{s}`"), F.lit("0/0")) for s in samples]
    line = F.concat_ws("\t", "reference", (F.col("position") + 1).cast("string"), F.lit("."), "ref", F.array_join("alts", ","), F.lit("."), F.lit("PASS"), F.lit("."), F.lit("GT"), *columns)
    return wide.select("reference", "position", line.alias("value"))
