"""All registered queries of the engine proper, with their SQL oracles."""

from __future__ import annotations

import functools
from collections.abc import Callable
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from locus import proxies as P
from locus.functions import codecs, scalars
from locus.operators import annotations, coverage, maintenance, ordering, regions, summaries, tiles, variants
from locus.operators.regions import Region
from locus.plans import manifest
from locus.sources import bam, chunk_files, dataset, shared, sidecars, text_formats
from locus.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
#: Folders that the query under way has written.
_OWN: ContextVar[list[str]] = ContextVar("own")

SIZE = P.SIZE
REGION = Region("A", 300, 700)
TIES = ordering.TIES

READS = """WITH reads AS (
    SELECT CASE WHEN l_tax = 0.0 THEN -1 WHEN l_returnflag = 'A' THEN 0 WHEN l_returnflag = 'N' THEN 1 ELSE 2 END AS reference_id,
        l_returnflag AS reference, l_partkey AS position, CAST(l_quantity AS INT) AS span, CAST(round(l_discount * 100) AS INT) * 6 AS mapq,
        CASE WHEN l_linestatus = 'F' THEN 1024 ELSE 0 END + CASE WHEN l_tax = 0.0 THEN 4 ELSE 0 END AS flag,
        l_orderkey, l_linenumber, l_suppkey, CASE WHEN l_tax = 0.0 THEN 0 ELSE l_partkey // 256 * 256 END AS chunk_start
    FROM lineitem
)"""
CALLS = "WITH calls AS (SELECT l_suppkey AS sample, l_partkey AS position, l_linenumber % 3 AS dosage FROM lineitem)"
EVENTS = "WITH e AS (SELECT event_id AS id, user_id AS participant, event_type AS code, CAST(floor(epoch(ts)) AS BIGINT) AS t, value FROM events)"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query.  What it writes to folders of _folder() is removed once its result is written down."""

    def register(f: Query) -> Query:
        @functools.wraps(f)
        def tidy(spark: SparkSession, d: str) -> DataFrame:
            own: list[str] = []
            before = _OWN.set(own)
            try:
                out = f(spark, d)
                return shared.materialised(out) if own else out
            finally:
                _OWN.reset(before)
                for folder in own:
                    shared.remove(spark, folder)

        _QUERIES[f.__name__] = tidy
        if sql is not None:
            _SQL[f.__name__] = sql
        return tidy

    return register


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _folder(spark: SparkSession) -> str:
    """A new folder under the shared one, which the query that asks for it does not leave behind."""
    folder = shared.new_folder(spark)
    _OWN.get().append(folder)
    return folder


def _few(spark: SparkSession, names: str, rows: list[tuple]) -> DataFrame:
    """A few rows as a table whose size Spark knows, so that joins with it may broadcast."""
    return spark.createDataFrame(pa.table({n: [r[k] for r in rows] for k, n in enumerate(names.split())}))


# Regions and chunks


@query(READS + " SELECT l_orderkey, l_linenumber, l_suppkey, position, span FROM reads WHERE reference_id >= 0 AND reference = 'A' AND position >= 300 AND position < 700")
def region_query_start(spark, d):
    return regions.starts_in(P.mapped(spark, d), REGION, SIZE).select("l_orderkey", "l_linenumber", "l_suppkey", "position", "span")


@query(READS + " SELECT l_orderkey, l_linenumber, l_suppkey, position, span FROM reads WHERE reference_id >= 0 AND reference = 'A' AND position < 700 AND position + span > 300")
def region_query_overlap(spark, d):
    return regions.overlapping(P.mapped(spark, d), REGION, SIZE, max_span=50).select("l_orderkey", "l_linenumber", "l_suppkey", "position", "span")


@query(READS + " SELECT count(*) AS reads FROM reads WHERE reference_id >= 0 AND reference = 'A' AND position >= 300 AND position < 700")
def region_count(spark, d):
    return regions.starts_in(P.mapped(spark, d), REGION, SIZE).agg(F.count("*").alias("reads"))


@query(READS + " SELECT reference, position, mapq, flag FROM reads WHERE reference_id >= 0 AND reference = 'R'")
def reference_scan(spark, d):
    return regions.starts_in(P.mapped(spark, d), Region("R"), SIZE).select("reference", "position", "mapq", "flag")


@query(READS + " SELECT DISTINCT reference, chunk_start FROM reads WHERE reference_id >= 0 AND reference = 'A' AND chunk_start + 256 > 300 AND chunk_start < 700")
def find_chunks(spark, d):
    return manifest.find_chunks(manifest.build(P.mapped(spark, d), SIZE), REGION, SIZE).select("reference", "chunk_start")


@query(READS + """, named AS (SELECT * FROM (VALUES ('r1', 'A', 100, 300), ('r2', 'N', 250, 900), ('r3', 'R', 0, 2000)) v(name, ref, s, e))
    SELECT name, count(*) AS reads FROM reads JOIN named ON reference = ref AND position >= s AND position < e WHERE reference_id >= 0 GROUP BY name""")
def multi_region(spark, d):
    named = _few(spark, "name reference start end", [("r1", "A", 100, 300), ("r2", "N", 250, 900), ("r3", "R", 0, 2000)])
    return regions.join_regions(P.mapped(spark, d), named, SIZE).groupBy("name").agg(F.count("*").alias("reads"))


@query(READS + """, named AS (SELECT * FROM (VALUES ('r1', 'A', 100, 300), ('r2', 'N', 250, 900)) v(name, ref, s, e))
    SELECT name, l_suppkey AS sample, count(*) AS reads FROM reads JOIN named ON reference = ref AND position >= s AND position < e WHERE reference_id >= 0 GROUP BY ALL""")
def sample_region_fanout(spark, d):
    named = _few(spark, "name reference start end", [("r1", "A", 100, 300), ("r2", "N", 250, 900)])
    return regions.join_regions(P.mapped(spark, d), named, SIZE).groupBy("name", F.col("l_suppkey").alias("sample")).agg(F.count("*").alias("reads"))


@query(READS + """, pairs AS (SELECT s_suppkey AS sample, 'N' AS ref, s_suppkey * 10 AS s, s_suppkey * 10 + 50 AS e FROM supplier)
    SELECT sample, count(*) AS reads FROM reads JOIN pairs ON reference = ref AND l_suppkey = sample AND position >= s AND position < e WHERE reference_id >= 0 GROUP BY sample""")
def sample_locus_join(spark, d):
    pairs = P.samples(spark, d).select("sample", F.lit("N").alias("reference"), (F.col("sample") * 10).alias("start"), (F.col("sample") * 10 + 50).alias("end"))
    return regions.join_regions(P.mapped(spark, d), pairs, SIZE).where("l_suppkey = sample").groupBy("sample").agg(F.count("*").alias("reads"))


@query(READS + " SELECT position, reference, mapq FROM reads WHERE mapq >= 30 AND flag & 4 = 0")
def mapq_filter(spark, d):
    return P.reads(spark, d).where((F.col("mapq") >= 30) & ~scalars.has_flag(F.col("flag"), 4)).select("position", "reference", "mapq")


@query(READS + " SELECT reference, count(*) AS reads FROM reads WHERE flag & 1024 = 0 GROUP BY reference")
def duplicate_filter(spark, d):
    return P.reads(spark, d).where(~scalars.has_flag(F.col("flag"), 1024)).groupBy("reference").agg(F.count("*").alias("reads"))


@query(READS + " SELECT reference, chunk_start, count(*) AS reads, CAST(max(position) - min(position) AS BIGINT) AS width FROM reads WHERE reference_id >= 0 GROUP BY ALL")
def per_chunk_function(spark, d):
    def measure(pdf):
        import pandas as pd

        return pd.DataFrame({"reference": pdf["reference"][:1], "chunk_start": pdf["chunk_start"][:1], "reads": [len(pdf)], "width": [pdf["position"].max() - pdf["position"].min()]})

    return regions.per_chunk(P.mapped(spark, d).select("reference", "chunk_start", "position"), measure, "reference string, chunk_start long, reads long, width long")


# Manifest, statistics, index


@query(READS + """ SELECT CASE WHEN reference_id >= 0 THEN reference END AS reference, CAST(chunk_start AS BIGINT) AS chunk_start, CAST(CASE WHEN reference_id < 0 THEN 0 ELSE chunk_start + 256 END AS BIGINT) AS chunk_end,
    count(*) AS reads, CAST(sum(span) AS BIGINT) AS bases, max(span) AS max_span, min(mapq) AS min_mapq, max(mapq) AS max_mapq, CAST(count(*) FILTER (flag & 1024 <> 0) AS BIGINT) AS duplicates,
    CASE WHEN reference_id < 0 THEN 'unmapped.chunk' ELSE reference || '/' || lpad(CAST(chunk_start AS VARCHAR), 9, '0') || '-' || lpad(CAST(chunk_start + 256 AS VARCHAR), 9, '0') || '.chunk' END AS path
    FROM reads GROUP BY 1, 2, 3, 10""")
def chunk_manifest(spark, d):
    return manifest.build(P.reads(spark, d), SIZE)


@query(READS + """, c AS (SELECT reference, chunk_start, count(*) AS n FROM reads WHERE reference_id >= 0 GROUP BY ALL)
    SELECT reference, count(*) AS chunks, min(chunk_start) AS "first", max(chunk_start) + 256 AS "last", CAST(sum(n) AS BIGINT) AS reads, CAST(CASE reference WHEN 'A' THEN 2000 WHEN 'N' THEN 3000 ELSE 0 END AS BIGINT) AS length FROM c GROUP BY reference""")
def spatial_index(spark, d):
    lengths = _few(spark, "reference length", [("A", 2000), ("N", 3000)])
    return manifest.spatial_index(manifest.build(P.reads(spark, d), SIZE), lengths)


@query(READS + """ SELECT count(*) AS total_reads, count(*) FILTER (reference_id >= 0) AS mapped_reads, count(*) FILTER (reference_id < 0) AS unmapped_reads, count(*) FILTER (flag & 1024 <> 0) AS duplicate_reads,
    CAST(sum(span) AS BIGINT) AS total_bases, round(sum(span) / 6000e0, 6) AS mean_coverage, round(count(*) FILTER (reference_id >= 0) * 100e0 / count(*), 6) AS percent_mapped FROM reads""")
def dataset_stats(spark, d):
    out = summaries.dataset_statistics(P.reads(spark, d), 6000)
    return out.withColumn("mean_coverage", F.round("mean_coverage", 6)).withColumn("percent_mapped", F.round("percent_mapped", 6))


@query(READS + " SELECT reference, count(*) FILTER (reference_id >= 0) AS mapped, count(*) FILTER (reference_id < 0) AS unmapped FROM reads GROUP BY reference")
def reads_per_reference(spark, d):
    return summaries.reads_per_reference(P.reads(spark, d))


@query(READS + ", b AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', {b})" for n, b in summaries.FLAGS.items()) + """) v(flag_name, bit))
    SELECT flag_name, count(*) FILTER (flag & bit <> 0) AS reads FROM reads, b GROUP BY flag_name UNION ALL SELECT 'total', count(*) FROM reads""")
def flagstat(spark, d):
    return summaries.flag_counts(P.reads(spark, d))


@query(READS + """, c AS (SELECT chunk_start, count(*) AS n, sum(span) AS b FROM reads WHERE reference_id >= 0 AND reference = 'A' GROUP BY 1), t AS (SELECT count(*) AS chunks, CAST(coalesce(sum(n), 0) AS BIGINT) AS reads, CAST(coalesce(sum(b), 0) AS DOUBLE) AS bytes FROM c WHERE chunk_start + 256 > 300 AND chunk_start < 700)
    SELECT chunks, reads, bytes, round(chunks / 1000e0 * 0.0004e0 + bytes / 1073741824e0 * 0.09e0, 12) AS cost FROM t""")
def cost_estimate(spark, d):
    return manifest.estimate(manifest.build(P.mapped(spark, d), SIZE), REGION, SIZE).withColumn("cost", F.round("cost", 12))


@query(READS + """ SELECT v.rule, CAST(CASE v.rule WHEN 'chunk_missing' THEN 0 WHEN 'chunk_not_listed' THEN 0 WHEN 'reads_differ' THEN (SELECT count(*) FROM (SELECT reference, chunk_start FROM reads WHERE reference_id >= 0 AND reference = 'R' GROUP BY ALL)) ELSE 0 END AS BIGINT) AS violations
    FROM (VALUES ('chunk_not_listed'), ('chunk_missing'), ('reads_differ'), ('wrong_width')) v(rule)""")
def validate_manifest(spark, d):
    rows = P.reads(spark, d)
    spoiled = manifest.build(rows, SIZE).withColumn("reads", F.col("reads") + F.when(F.col("reference") == "R", 1).otherwise(0))
    return manifest.violations(rows, spoiled, SIZE)


@query(READS + " SELECT reference, position // 1024 * 1024 AS chunk_start, count(*) AS reads FROM reads WHERE reference_id >= 0 GROUP BY ALL")
def rechunk(spark, d):
    return regions.with_chunks(P.mapped(spark, d), 1024).groupBy("reference", "chunk_start").agg(F.count("*").alias("reads"))


@query("SELECT 0::BIGINT AS different")
def roundtrip_diff(spark, d):
    """Rows through a written dataset, and from there through lines of text that are written, read and parsed."""
    folder = _folder(spark)
    fields = ["reference", "position", "span", "mapq", "flag", "l_orderkey", "l_linenumber", "l_suppkey"]
    rows = P.reads(spark, d)
    dataset.write(rows, f"{folder}/dataset", SIZE)
    stored = dataset.read(spark, f"{folder}/dataset")
    name = F.concat_ws(":", "l_orderkey", "l_linenumber", "l_suppkey")
    unset = {c: F.lit(None).cast("string") for c in ("mate_reference", "sequence", "quality")}
    lines = stored.withColumns({"name": name, "cigar": F.concat(F.col("span").cast("string"), F.lit("M")), "mate_position": F.lit(-1), "template_length": F.lit(0), "tags": F.create_map(F.lit("LN"), F.col("l_linenumber").cast("string")), **unset})
    text_formats.format_sam(lines).write.text(f"{folder}/text")
    key = F.split("name", ":")
    parsed = text_formats.parse_sam(text_formats.sam_lines(spark, f"{folder}/text")).withColumns({"l_orderkey": key[0], "l_linenumber": key[1], "l_suppkey": key[2]})
    # Unmapped rows have a reference of their own once stored.
    before = rows.withColumn("reference", F.when(F.col("reference_id") < 0, dataset.UNMAPPED).otherwise(F.col("reference")))
    before, stored, parsed = (x.select("reference", *(F.col(c).cast("long").alias(c) for c in fields[1:])) for x in (before, stored, parsed))
    return regions.difference(before, stored).unionByName(regions.difference(before, parsed)).agg(F.count("*").alias("different"))


def _checksum_sql(*columns: str) -> str:
    """Common tables h (a 60-bit number of each row) and c (a checksum of each chunk)."""
    text = ", ".join(f"coalesce(CAST({c} AS VARCHAR), '')" for c in columns)
    return f""", h AS (SELECT reference, chunk_start, CAST('0x' || md5(concat_ws(chr(9), {text}))[1:15] AS BIGINT) AS h FROM reads),
    c AS (SELECT reference, chunk_start, count(*) AS reads, sha256(concat_ws(':', count(*), bit_xor(h), sum(h))) AS checksum FROM h GROUP BY ALL)"""


@query(READS + _checksum_sql("position", "span") + " SELECT * FROM c")
def chunk_checksums(spark, d):
    return manifest.checksums(P.reads(spark, d), ["position", "span"])


@query(READS + _checksum_sql("position", "span", "mapq", "flag", "l_orderkey", "l_linenumber") + " SELECT * FROM c")
def chunk_checksum_values(spark, d):
    return manifest.checksums(P.reads(spark, d), ["position", "span", "mapq", "flag", "l_orderkey", "l_linenumber"])


# Coverage and order

_DEPTH = READS + """, s AS (SELECT reference, position AS p, 1 AS step FROM reads WHERE reference_id >= 0 UNION ALL SELECT reference, position + span, -1 FROM reads WHERE reference_id >= 0),
    g AS (SELECT reference, p, sum(step) AS step FROM s GROUP BY ALL), depth AS (SELECT reference, CAST(p AS BIGINT) AS position, CAST(sum(step) OVER (PARTITION BY reference ORDER BY p) AS BIGINT) AS depth FROM g)"""


@query(_DEPTH + " SELECT * FROM depth")
def coverage_depth(spark, d):
    return coverage.depth(P.mapped(spark, d), SIZE)


@query(_DEPTH + """, l AS (SELECT *, coalesce(lead(position) OVER (PARTITION BY reference ORDER BY position) - position, 0) AS n FROM depth)
    SELECT reference, max(depth) AS max_depth, CAST(sum(depth * n) AS BIGINT) AS bases, CAST(sum(CASE WHEN depth >= 100 THEN n ELSE 0 END) AS BIGINT) AS covered FROM l GROUP BY reference""")
def coverage_summary(spark, d):
    return coverage.summary(coverage.depth(P.mapped(spark, d), SIZE), 100, SIZE)


@query(READS + ", b AS (SELECT range AS position FROM range(300, 400)) SELECT b.position, count(*) AS depth FROM reads JOIN b ON reads.position <= b.position AND reads.position + span > b.position WHERE reference_id >= 0 AND reference = 'A' GROUP BY b.position")
def base_depth(spark, d):
    return coverage.base_depth(regions.overlapping(P.mapped(spark, d), Region("A", 300, 400), SIZE, 50), 300, 400)


@query(READS + " SELECT reference, position, l_orderkey, l_linenumber, l_suppkey, row_number() OVER (PARTITION BY reference ORDER BY position, l_orderkey, l_linenumber, l_suppkey) AS rank FROM reads")
def coordinate_sort(spark, d):
    return ordering.ranked(P.placed(spark, d), *TIES).select("reference", "position", *TIES, "rank")


@query(READS + " SELECT reference_id, reference, position, l_orderkey, l_linenumber, l_suppkey FROM reads")
def kway_merge(spark, d):
    """Runs that come as they are, and are sorted once, together."""
    rows = P.reads(spark, d).select("reference_id", "reference", "position", "l_orderkey", "l_linenumber", "l_suppkey")
    runs = [rows.where(F.col("l_orderkey") % 3 == k) for k in range(3)]
    return ordering.merge_sorted(*runs, by=["reference_id", "position", *TIES])


@query(READS + " SELECT reference_id, reference, position, l_orderkey, l_linenumber FROM reads")
def kway_merge_whole(spark, d):
    """Two runs, of even and of odd positions, as one sorted table."""
    rows = P.reads(spark, d).select("reference_id", "reference", "position", "l_orderkey", "l_linenumber")
    odd = F.coalesce(F.pmod("position", F.lit(2)) == 1, F.lit(False))
    return ordering.merge_sorted(rows.where(~odd), rows.where(odd), by=["reference_id", "position", "l_orderkey", "l_linenumber"])


@query(READS + " SELECT reference, chunk_start, count(*) AS reads FROM reads WHERE reference_id >= 0 GROUP BY ALL ORDER BY reads DESC, reference, chunk_start LIMIT 10")
def topk_chunks(spark, d):
    return manifest.build(P.mapped(spark, d), SIZE).select("reference", "chunk_start", "reads").orderBy(F.desc("reads"), "reference", "chunk_start").limit(10)


@query(READS + " SELECT reference, l_orderkey, l_linenumber, l_suppkey, position, coalesce(position - lag(position) OVER (PARTITION BY reference ORDER BY position, l_orderkey, l_linenumber, l_suppkey), position) AS delta FROM reads")
def delta_positions(spark, d):
    return ordering.deltas(P.placed(spark, d), *TIES).select("reference", *TIES, "position", F.coalesce("delta", "position").alias("delta"))


@query(READS + ", r AS (SELECT *, row_number() OVER (PARTITION BY reference ORDER BY position, l_orderkey, l_linenumber, l_suppkey) - 1 AS n FROM reads) SELECT reference, position, l_orderkey, l_linenumber, l_suppkey, n // 100 AS chunk_index, n % 100 AS offset_in_chunk FROM r")
def offset_in_chunk(spark, d):
    place = F.col("rank") - 1
    return ordering.ranked(P.placed(spark, d), *TIES).select("reference", "position", *TIES, (place / 100).cast("long").alias("chunk_index"), (place % 100).alias("offset_in_chunk"))


@query(READS + """, r AS (SELECT *, row_number() OVER (PARTITION BY reference ORDER BY position, l_orderkey, l_linenumber, l_suppkey) AS n, count(*) OVER (PARTITION BY reference) AS total FROM reads)
    SELECT reference, (n - 1) * 8 // total AS chunk, min(position) AS "first", max(position) AS "last", count(*) AS reads FROM r GROUP BY 1, 2""")
def adaptive_chunks(spark, d):
    return ordering.equal_count_chunks(P.placed(spark, d), 8, *TIES)


@query(READS + " SELECT coalesce(reference, 'all') AS reference, coalesce(l_suppkey % 4, -1) AS lane, count(*) AS reads, CAST(sum(span) AS BIGINT) AS bases FROM reads GROUP BY CUBE (reference, l_suppkey % 4)")
def cube_references(spark, d):
    rows = P.reads(spark, d).withColumn("lane", F.col("l_suppkey") % 4)
    out = rows.cube("reference", "lane").agg(F.count("*").alias("reads"), F.sum("span").alias("bases"))
    return out.select(F.coalesce("reference", F.lit("all")).alias("reference"), F.coalesce("lane", F.lit(-1)).alias("lane"), "reads", "bases")


# Variants


@query(CALLS + " SELECT position // 256 AS gchunk, sample // 25 AS schunk, count(*) AS dense, count(*) FILTER (dosage <> 0) AS stored FROM calls GROUP BY ALL")
def sparse_ratio(spark, d):
    return variants.sparse_ratio(P.calls(spark, d), 256, 25)


@query(CALLS + " SELECT DISTINCT position, dosage FROM calls WHERE sample = 5 AND dosage <> 0")
def sample_variants(spark, d):
    return variants.of_sample(P.calls(spark, d), 5)


@query(CALLS + " SELECT DISTINCT position, dosage FROM calls WHERE sample = 5 AND dosage <> 0 AND position >= 100 AND position < 500")
def sample_region(spark, d):
    return variants.of_sample(P.calls(spark, d), 5, 100, 500)


@query(CALLS + " SELECT DISTINCT sample FROM calls WHERE position = 42 AND dosage <> 0")
def variant_carriers(spark, d):
    return variants.carriers(P.calls(spark, d), 42)


@query(CALLS + " SELECT s_suppkey AS sample FROM supplier WHERE s_suppkey NOT IN (SELECT sample FROM calls WHERE position = 42 AND dosage <> 0)")
def noncarriers(spark, d):
    return variants.noncarriers(P.samples(spark, d), P.calls(spark, d), 42)


@query(CALLS + " SELECT position, CAST(sum(dosage) AS BIGINT) AS ac, count(*) * 2 AS an, round(sum(dosage) / (count(*) * 2e0), 6) AS af FROM calls GROUP BY position")
def allele_freq(spark, d):
    return variants.allele_frequency(P.calls(spark, d)).withColumn("af", F.round("af", 6))


@query(CALLS + """, n AS (SELECT sample, position, max(dosage) AS dosage FROM calls WHERE dosage <> 0 AND position >= 10 AND position < 30 GROUP BY ALL)
    SELECT s_suppkey AS sample, p.position, coalesce(dosage, 0) AS dosage FROM supplier CROSS JOIN (SELECT DISTINCT position FROM n) p LEFT JOIN n ON n.sample = s_suppkey AND n.position = p.position""")
def dense_genotypes(spark, d):
    return variants.dense(P.calls(spark, d), P.samples(spark, d), 10, 30)


@query(CALLS + " SELECT position FROM calls WHERE sample = 1 AND dosage <> 0 INTERSECT SELECT position FROM calls WHERE sample = 2 AND dosage <> 0")
def shared_variants(spark, d):
    return variants.shared(P.calls(spark, d), 1, 2)


@query(CALLS + ", b AS (SELECT position, sample, max(dosage) AS dosage FROM calls WHERE dosage <> 0 GROUP BY ALL) SELECT position, string_agg(sample || ':' || dosage, ',' ORDER BY sample) AS carriers FROM b GROUP BY position")
def merged_genotypes(spark, d):
    return variants.merged_genotypes(P.calls(spark, d))


@query("SELECT count(*) AS variants, count(*) FILTER (length(p_brand[8:]) = 1 AND length(p_name[1:1]) = 1) AS snps, count(*) FILTER (length(p_brand[8:]) <> 1) AS indels FROM part")
def variant_stats(spark, d):
    sites = P.table(spark, d, "part").select(F.substr("p_name", F.lit(1), F.lit(1)).alias("ref"), F.substr("p_brand", F.lit(8)).alias("alt"))
    return variants.variant_statistics(sites)


@query(CALLS + """, b AS (SELECT position, sample, max(dosage) AS dosage FROM calls WHERE dosage <> 0 AND sample IN (1, 2, 3) GROUP BY ALL),
    w AS (SELECT position, max(dosage) FILTER (sample = 1) AS a, max(dosage) FILTER (sample = 2) AS b, max(dosage) FILTER (sample = 3) AS c FROM b GROUP BY position)
    SELECT position, concat_ws(chr(9), '1', position, '.', 'A', 'G', '.', 'PASS', '.', 'GT', ['0/0', '0/1', '1/1'][coalesce(a, 0) + 1], ['0/0', '0/1', '1/1'][coalesce(b, 0) + 1], ['0/0', '0/1', '1/1'][coalesce(c, 0) + 1]) AS line FROM w""")
def vcf_export(spark, d):
    return variants.vcf_lines(P.calls(spark, d), [1, 2, 3])


# Annotations


@query(EVENTS + " SELECT t // 1800 AS segment, code, count(*) AS events FROM e GROUP BY ALL")
def segment_manifest(spark, d):
    return annotations.segments(P.annotations(spark, d), 1800)


@query(EVENTS + " SELECT code, t // 86400 AS segment, count(*) AS events, CAST(min(t) AS BIGINT) AS first_t, CAST(max(t) AS BIGINT) AS last_t FROM e GROUP BY ALL")
def code_index(spark, d):
    return annotations.code_index(P.annotations(spark, d), 86400)


@query("SELECT role AS speaker, count(*) AS utterances, CAST(sum(length(text)) AS BIGINT) AS total_chars, count(DISTINCT conv_id) AS conversations FROM conversations GROUP BY role")
def speaker_index(spark, d):
    return annotations.speaker_index(P.table(spark, d, "conversations"))


@query(EVENTS + " SELECT a.id AS first_id, b.id AS second_id, a.participant FROM e a JOIN e b ON a.participant = b.participant AND a.code = 'view' AND b.code = 'purchase' AND b.t > a.t AND b.t - a.t <= 21600")
def sequence_pattern(spark, d):
    return annotations.followed_by(P.annotations(spark, d), "view", "purchase", 21600)


@query(EVENTS + " SELECT a.id, a.t - 3600 AS clip_start, a.t + 3600 AS clip_end, count(*) AS events FROM e a JOIN e b ON a.participant = b.participant AND a.code = 'purchase' AND b.t BETWEEN a.t - 3600 AND a.t + 3600 GROUP BY ALL")
def context_clip(spark, d):
    return annotations.clips(P.annotations(spark, d), "purchase", 3600)


@query(EVENTS + " SELECT id, coalesce(t - lag(t) OVER (PARTITION BY participant ORDER BY t, id), -1) AS gap FROM e")
def turn_gaps(spark, d):
    return annotations.gaps(P.annotations(spark, d)).select("id", F.coalesce("gap", F.lit(-1)).alias("gap"))


@query(EVENTS + ", n AS (SELECT code, t, lead(code) OVER w AS c2, lead(t) OVER w AS t2 FROM e WINDOW w AS (PARTITION BY participant ORDER BY t, id)) SELECT count(*) AS pairs, CAST(coalesce(sum(t2 - t), 0) AS BIGINT) AS seconds FROM n WHERE code = 'view' AND c2 = 'click'")
def adjacent_pattern(spark, d):
    return annotations.adjacent(P.annotations(spark, d), "view", "click")


@query(EVENTS + """, m AS (SELECT *, CASE WHEN t - lag(t) OVER w < 7200 THEN 0 ELSE 1 END AS opens FROM e WINDOW w AS (PARTITION BY participant ORDER BY t, id)),
    s AS (SELECT *, sum(opens) OVER (PARTITION BY participant ORDER BY t, id) AS k FROM m) SELECT participant, min(t) AS session_start, count(*) AS events FROM s GROUP BY participant, k""")
def session_events(spark, d):
    return annotations.sessions(P.annotations(spark, d), 7200)


@query("""WITH n AS (SELECT quality, toxic, count(*) AS n FROM labels GROUP BY ALL), t AS (SELECT sum(n) AS n, sum(CASE WHEN quality = toxic THEN n ELSE 0 END) AS agree FROM n),
    p AS (SELECT sum(r * s) AS m FROM (SELECT quality AS c, sum(n) AS r FROM n GROUP BY 1) JOIN (SELECT toxic AS c, sum(n) AS s FROM n GROUP BY 1) USING (c))
    SELECT CAST(n AS BIGINT) AS n, CAST(agree AS BIGINT) AS agree, round((agree / n::DOUBLE - m / (n * n)::DOUBLE) / (1 - m / (n * n)::DOUBLE), 6) AS kappa FROM t, p""")
def rater_agreement(spark, d):
    return annotations.agreement(P.table(spark, d, "labels"), "quality", "toxic").withColumn("kappa", F.round("kappa", 6))


@query(EVENTS + """, c AS (SELECT id, participant, t FROM e WHERE code = 'purchase'), v AS (SELECT participant, t, max(id) AS view_id FROM e WHERE code = 'view' GROUP BY ALL)
    SELECT c.id, c.participant, c.t, coalesce(v.view_id, -1) AS view_id FROM c ASOF LEFT JOIN v ON c.participant = v.participant AND c.t >= v.t""")
def as_of_join(spark, d):
    e = P.annotations(spark, d)
    views = e.where("code = 'view'").groupBy("participant", "t").agg(F.max("id").alias("view_id"))
    return annotations.as_of(e.where("code = 'purchase'").select("id", "participant", "t"), views, "participant", "t", "view_id").withColumn("view_id", F.coalesce("view_id", F.lit(-1)))


@query("SELECT conv_id, turn, role FROM conversations WHERE contains(text, 'the')")
def transcript_contains(spark, d):
    return P.table(spark, d, "conversations").where(F.col("text").contains("the")).select("conv_id", "turn", "role")


# Tiles and shards


@query("SELECT o_custkey // 100 AS t_x, CAST(floor(o_totalprice) AS BIGINT) // 1000 AS t_y, count(*) AS points FROM orders WHERE o_custkey >= 150 AND o_custkey < 420 AND CAST(floor(o_totalprice) AS BIGINT) >= 2500 AND CAST(floor(o_totalprice) AS BIGINT) < 90000 GROUP BY ALL")
def tile_box(spark, d):
    sizes = {"x": 100, "y": 1000}
    points = tiles.with_tiles(P.table(spark, d, "orders").select(F.col("o_custkey").alias("x"), F.floor("o_totalprice").alias("y")), **sizes)
    return tiles.in_box(points, sizes, x=(150, 420), y=(2500, 90000)).groupBy("t_x", "t_y").agg(F.count("*").alias("points"))


@query("""WITH u AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS d FROM embeddings), c AS (SELECT label, d, avg(x) AS x FROM u GROUP BY ALL),
    s AS (SELECT u.vec_id, c.label, sum((u.x - c.x) * (u.x - c.x)) AS q FROM u JOIN c USING (d) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY q, label) AS n FROM s)
    SELECT vec_id, label, round(sqrt(q), 4) AS distance FROM r WHERE n = 1""")
def centroid_assign(spark, d):
    vectors = P.table(spark, d, "embeddings")
    return tiles.nearest_centroid(vectors, tiles.centroids(vectors)).withColumn("distance", F.round("distance", 4))


@query("SELECT c_nationkey, c_custkey, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS INT) AS rank FROM customer QUALIFY rank <= 3")
def top_per_group(spark, d):
    return tiles.top_per_group(P.table(spark, d, "customer"), "c_nationkey", [F.desc("c_acctbal"), "c_custkey"], 3).select("c_nationkey", "c_custkey", "rank")


@query("SELECT sha256(CAST(doc_id AS VARCHAR))[1:2] AS shard, count(*) AS objects FROM documents GROUP BY 1")
def shard_prefix(spark, d):
    return P.table(spark, d, "documents").groupBy(scalars.shard_prefix(F.col("doc_id").cast("string"), 8).alias("shard")).agg(F.count("*").alias("objects"))


@query("SELECT sha256(CAST(doc_id AS VARCHAR))[1:1] AS shard, count(*) AS objects FROM documents GROUP BY 1")
def shard_bits(spark, d):
    return P.table(spark, d, "documents").groupBy(scalars.shard_prefix(F.col("doc_id").cast("string"), 4).alias("shard")).agg(F.count("*").alias("objects"))


# Scalars and codecs


@query("""WITH t AS (SELECT p_partkey, p_size AS n, CASE p_partkey % 7 WHEN 0 THEN 'c' || p_size WHEN 1 THEN 'c' || p_size || ':' || p_partkey || '-' || (p_partkey + p_size) WHEN 2 THEN 'x:' || p_size || 'K-' || (p_size + 1) || 'k' WHEN 3 THEN 'x:1,' || lpad(CAST(p_partkey % 1000 AS VARCHAR), 3, '0') || '-2M'
        WHEN 4 THEN 'x:' || p_partkey WHEN 5 THEN 'x:' || (p_size + 5) || '-' || p_size ELSE 'a:' || p_size || ':1-2' END AS region FROM part)
    SELECT p_partkey, region, CASE WHEN k IN (0, 1) THEN 'c' || n WHEN k IN (2, 3) THEN 'x' END AS reference, CAST(CASE k WHEN 0 THEN 0 WHEN 1 THEN p_partkey WHEN 2 THEN n * 1000 WHEN 3 THEN 1000 + p_partkey % 1000 ELSE -1 END AS BIGINT) AS "start",
        CAST(CASE k WHEN 1 THEN p_partkey + n WHEN 2 THEN (n + 1) * 1000 WHEN 3 THEN 2000000 ELSE -1 END AS BIGINT) AS "end" FROM (SELECT *, p_partkey % 7 AS k FROM t)""")
def parse_region(spark, d):
    """Region texts of every form, and of none, made of the parts' numbers."""
    key, n = F.col("p_partkey"), F.col("p_size").cast("string")
    forms = [
        F.concat(F.lit("c"), n), F.concat(F.lit("c"), n, F.lit(":"), key.cast("string"), F.lit("-"), (key + F.col("p_size")).cast("string")), F.concat(F.lit("x:"), n, F.lit("K-"), (F.col("p_size") + 1).cast("string"), F.lit("k")),
        F.concat(F.lit("x:1,"), F.lpad((key % 1000).cast("string"), 3, "0"), F.lit("-2M")), F.concat(F.lit("x:"), key.cast("string")), F.concat(F.lit("x:"), (F.col("p_size") + 5).cast("string"), F.lit("-"), n), F.concat(F.lit("a:"), n, F.lit(":1-2")),
    ]
    texts = P.table(spark, d, "part").select("p_partkey", F.get(F.array(*forms), (key % 7).cast("int")).alias("region")).withColumn("r", scalars.parse_region(F.col("region")))
    return texts.select("p_partkey", "region", "r.reference", F.coalesce("r.start", F.lit(-1)).alias("start"), F.coalesce("r.end", F.lit(-1)).alias("end"))


@query("""WITH t AS (SELECT p_partkey, p_partkey % 6 AS k, CASE p_partkey % 6 WHEN 0 THEN p_size WHEN 1 THEN p_size * 1024 WHEN 2 THEN p_size * 1048576 WHEN 3 THEN p_size * 1073741824::BIGINT WHEN 4 THEN (256 << p_partkey % 7) * 1024 END::BIGINT AS n,
        CASE p_partkey % 6 WHEN 0 THEN '' || p_size WHEN 1 THEN p_size || 'K' WHEN 2 THEN p_size || 'm' WHEN 3 THEN p_size || 'G' WHEN 4 THEN (256 << p_partkey % 7) || 'k' ELSE 'x' || p_size END AS size FROM part)
    SELECT p_partkey, size, coalesce(n, -1) AS n_bytes, CASE WHEN n BETWEEN 262144 AND 8388608 AND (n & (n - 1)) = 0 THEN n ELSE -1 END AS chunk_size,
        CASE WHEN n >= 1048576 AND n % 1048576 = 0 THEN n // 1048576 || 'M' WHEN n >= 1024 AND n % 1024 = 0 THEN n // 1024 || 'K' ELSE CAST(n AS VARCHAR) END AS shown FROM t""")
def parse_size(spark, d):
    """Sizes in every unit, powers of two among them, and texts that are none, made of the parts' numbers."""
    n, power = F.col("p_size").cast("string"), F.expr("shiftleft(256, cast(p_partkey % 7 as int))").cast("string")
    forms = [n, F.concat(n, F.lit("K")), F.concat(n, F.lit("m")), F.concat(n, F.lit("G")), F.concat(power, F.lit("k")), F.concat(F.lit("x"), n)]
    texts = P.table(spark, d, "part").select("p_partkey", F.get(F.array(*forms), (F.col("p_partkey") % 6).cast("int")).alias("size"))
    bytes_of = scalars.parse_size(F.col("size"))
    known = lambda c: F.coalesce(c, F.lit(-1))
    return texts.select("p_partkey", "size", known(bytes_of).alias("n_bytes"), known(scalars.parse_chunk_size(F.col("size"))).alias("chunk_size"), scalars.format_chunk_size(bytes_of).alias("shown"))


@query("SELECT DISTINCT c // 3600 AS k, CASE WHEN c >= 3600 THEN (c // 3600) || 'h' || (c % 3600 // 60) || 'm' || (c % 60) || 's' WHEN c >= 60 THEN (c // 60) || 'm' || (c % 60) || 's' ELSE c || 's' END AS shown FROM (SELECT c_custkey * 7 AS c FROM customer)")
def format_duration(spark, d):
    c = F.col("c_custkey") * 7
    return P.table(spark, d, "customer").select(F.expr("c_custkey * 7 div 3600").alias("k"), scalars.format_duration(c).alias("shown")).distinct()


def _cigar() -> Column:
    return F.concat(F.col("l_linenumber").cast("string"), F.lit("S"), F.col("l_quantity").cast("int").cast("string"), F.lit("M2D"), (F.col("l_linenumber") + 1).cast("string"), F.lit("I5="))


@query("SELECT l_orderkey, l_linenumber, CAST(CAST(l_quantity AS INT) + 7 AS BIGINT) AS span FROM lineitem")
def cigar_span(spark, d):
    return P.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", codecs.reference_span(_cigar()).alias("span"))


@query("""WITH o AS (SELECT 'S' AS op, l_linenumber AS len FROM lineitem UNION ALL SELECT 'M', CAST(l_quantity AS INT) FROM lineitem UNION ALL SELECT 'D', 2 FROM lineitem UNION ALL SELECT 'I', l_linenumber + 1 FROM lineitem UNION ALL SELECT '=', 5 FROM lineitem)
    SELECT op, count(*) AS n, CAST(sum(len) AS BIGINT) AS total FROM o GROUP BY op""")
def cigar_ops(spark, d):
    round_trip = codecs.unpack_cigar(codecs.pack_cigar(codecs.cigar_ops(_cigar())))
    return P.table(spark, d, "lineitem").select(F.explode(round_trip).alias("o")).groupBy("o.op").agg(F.count("*").alias("n"), F.sum("o.len").alias("total"))


@query("SELECT p_partkey, translate(lpad(CAST(p_partkey AS VARCHAR), 9, '0'), '0123456789', 'ACGTNACGTN') AS sequence FROM part")
def seq_codec_roundtrip(spark, d):
    s = F.translate(F.lpad(F.col("p_partkey").cast("string"), 9, "0"), "0123456789", "ACGTNACGTN")
    return P.table(spark, d, "part").select("p_partkey", codecs.decode_sequence(codecs.encode_sequence(s), F.length(s)).alias("sequence"))


@query("SELECT p_partkey, round((p_size % 40 + 2 + 30) / 2e0, 6) AS average, chr(CAST(p_size % 40 + 35 AS INT)) || '?' AS quality FROM part")
def quality_stats(spark, d):
    q = F.concat(F.char(F.col("p_size").cast("long") % 40 + 35), F.lit("?"))
    return P.table(spark, d, "part").select("p_partkey", F.round(codecs.average_quality(q), 6).alias("average"), codecs.quality_text(codecs.quality_values(q)).alias("quality"))


@query("SELECT p_partkey, 'NM:i:' || p_size AS nm, 'RG:Z:' || p_brand AS rg FROM part")
def tag_codec(spark, d):
    tags = codecs.tags_map(F.array(F.concat(F.lit("NM:i:"), F.col("p_size").cast("string")), F.concat(F.lit("RG:Z:"), "p_brand"), F.lit("broken")))
    return P.table(spark, d, "part").withColumn("tags", tags).select("p_partkey", codecs.tag_text(F.lit("NM"), F.col("tags")["NM"]).alias("nm"), codecs.tag_text(F.lit("RG"), F.col("tags")["RG"]).alias("rg"))


@query("SELECT split_part(url, '/', 3) AS bucket, count(*) AS objects FROM pages GROUP BY 1")
def uri_parts(spark, d):
    return P.table(spark, d, "pages").groupBy(scalars.split_uri(F.col("url"))["bucket"].alias("bucket")).agg(F.count("*").alias("objects"))


@query("SELECT DISTINCT l_linenumber % 3 AS dosage, CAST(l_linenumber % 3 AS INT) AS code FROM lineitem")
def genotype_codes(spark, d):
    gt = F.element_at(F.array(F.lit("0/0"), F.lit("0|1"), F.lit("1/1")), F.col("dosage") + 1)
    return P.calls(spark, d).select("dosage", scalars.genotype_code(gt).alias("code")).distinct()


# Metadata-only plans, maintenance, text forms


@query(READS + " SELECT reference, chunk_start, count(*) AS reads FROM reads WHERE reference_id >= 0 GROUP BY ALL HAVING max(mapq) >= 60 AND count(*) FILTER (flag & 1024 <> 0) > 0")
def chunks_by_statistics(spark, d):
    return manifest.build(P.mapped(spark, d), SIZE).where("max_mapq >= 60 and duplicates > 0").select("reference", "chunk_start", "reads")


@query(READS + ", c AS (SELECT count(*) AS n FROM reads WHERE reference_id >= 0 GROUP BY reference, chunk_start) SELECT count(*) AS chunks, min(n) AS least, max(n) AS most, round(avg(n), 6) AS mean, round(max(n) / avg(n), 6) AS skew FROM c")
def chunk_sizes(spark, d):
    return maintenance.chunk_sizes(manifest.build(P.mapped(spark, d), SIZE)).withColumn("mean", F.round("mean", 6)).withColumn("skew", F.round("skew", 6))


@query(READS + """, m AS (SELECT reference, chunk_start, count(*) AS n FROM reads WHERE reference_id >= 0 GROUP BY ALL), k AS (SELECT reference || '/' || lpad(CAST(chunk_start AS VARCHAR), 9, '0') || '-' || lpad(CAST(chunk_start + 256 AS VARCHAR), 9, '0') || '.chunk' AS path, reference FROM m)
    SELECT path, CASE reference WHEN 'A' THEN 'removed' ELSE 'added' END AS change FROM k WHERE reference IN ('A', 'N')""")
def snapshot_changes(spark, d):
    m = manifest.build(P.mapped(spark, d), SIZE)
    both = dataset.snapshot(m.where("reference <> 'A'"), dataset.snapshot(m.where("reference <> 'N'"), None, 1), 2)
    return dataset.snapshot_changes(both, 1, 2)


@query(READS + """, m AS (SELECT DISTINCT reference || '/' || lpad(CAST(chunk_start AS VARCHAR), 9, '0') || '-' || lpad(CAST(chunk_start + 256 AS VARCHAR), 9, '0') || '.chunk' AS path FROM reads WHERE reference_id >= 0)
    SELECT sha256(path)[1:2] || '/' || path AS path FROM m""")
def sharded_paths(spark, d):
    return maintenance.sharded_paths(manifest.build(P.mapped(spark, d), SIZE), 8).select("path")


@query("""SELECT url AS path, CASE WHEN page_id % 7 = 0 THEN 'no metadata' WHEN page_id % 3 = 0 THEN 'compression cannot be entered in the middle' WHEN length(html) * 10000 > 67108864 AND page_id % 2 = 1 THEN 'large and without an index' ELSE 'ready' END AS verdict FROM pages""")
def storage_readiness(spark, d):
    listing = P.table(spark, d, "pages").select(
        F.col("url").alias("path"), (F.length("html").cast("long") * 10000).alias("n_bytes"), (F.col("page_id") % 2 == 0).alias("indexed"),
        (F.col("page_id") % 7 != 0).alias("has_metadata"), F.when(F.col("page_id") % 3 == 0, "gzip").otherwise("zstd").alias("codec"),
    )
    return maintenance.readiness(listing)


@query("""SELECT 'm' || l_linenumber AS method, l_returnflag AS operation, round(sum(l_quantity) / sum(l_extendedprice), 9) AS throughput,
    round((SELECT sum(l_extendedprice) FROM lineitem b WHERE b.l_linenumber = 1 AND b.l_returnflag = lineitem.l_returnflag) / sum(l_extendedprice), 6) AS speedup FROM lineitem GROUP BY l_linenumber, l_returnflag""")
def benchmark_report(spark, d):
    results = P.table(spark, d, "lineitem").groupBy(F.concat(F.lit("m"), F.col("l_linenumber").cast("string")).alias("method"), F.col("l_returnflag").alias("operation")).agg(F.sum("l_quantity").alias("n_bytes"), F.sum("l_extendedprice").alias("seconds"))
    out = maintenance.speedups(results.withColumn("success", F.lit(True)), "m1")
    return out.select("method", "operation", F.round("throughput", 9).alias("throughput"), F.round("speedup", 6).alias("speedup"))


def _alignments(spark, d) -> DataFrame:
    return P.reads(spark, d).select(
        F.concat_ws(":", "l_orderkey", "l_linenumber", "l_suppkey").alias("name"), "flag", F.when(F.col("reference_id") >= 0, F.col("reference")).alias("reference"), F.col("position").cast("int").alias("position"), "mapq",
        F.concat(F.col("span").cast("string"), F.lit("M")).alias("cigar"), F.lit(None).cast("string").alias("mate_reference"), F.lit(-1).alias("mate_position"), F.lit(0).alias("template_length"),
        F.lit("ACGT").alias("sequence"), F.lit("IIII").alias("quality"), F.create_map(F.lit("NM"), F.col("l_linenumber").cast("string")).alias("tags"),
    )


@query(READS + """ SELECT concat_ws(chr(9), l_orderkey || ':' || l_linenumber || ':' || l_suppkey, flag, CASE WHEN reference_id >= 0 THEN reference ELSE '*' END, position + 1, mapq, span || 'M', '*', 0, 0, 'ACGT', 'IIII', 'NM:i:' || l_linenumber) AS value FROM reads""")
def sam_export(spark, d):
    return text_formats.format_sam(_alignments(spark, d))


@query(READS + """ SELECT l_orderkey || ':' || l_linenumber || ':' || l_suppkey AS name, flag, coalesce(CASE WHEN reference_id >= 0 THEN reference END, '') AS reference, position, span, CAST(l_linenumber AS VARCHAR) AS nm FROM reads""")
def sam_roundtrip(spark, d):
    back = text_formats.parse_sam(text_formats.format_sam(_alignments(spark, d)))
    return back.select("name", "flag", F.coalesce("reference", F.lit("")).alias("reference"), F.col("position").cast("long").alias("position"), "span", codecs.tag_value(F.col("tags")["NM"]).alias("nm"))


@query("SELECT count(*) AS malformed FROM documents WHERE doc_id % 5 = 0")
def malformed_rows(spark, d):
    line = F.when(F.col("doc_id") % 5 == 0, F.lit("only\tthree\tfields")).otherwise(F.concat(F.lit("r\t0\tA\t"), F.col("doc_id").cast("string"), F.lit("\t9\t4M\t*\t0\t0\tACGT\tIIII")))
    return text_formats.malformed(P.table(spark, d, "documents").select(line.alias("value"))).agg(F.count("*").alias("malformed"))


@query("SELECT s_suppkey % 4 AS k, CAST(CASE s_suppkey % 4 WHEN 0 THEN -1 WHEN 1 THEN s_suppkey WHEN 2 THEN 1 ELSE -1 END AS BIGINT) AS mate_id, s_suppkey FROM supplier")
def mate_reference(spark, d):
    names = F.create_map(F.lit("A"), F.lit(0).cast("long"), F.lit("N"), F.lit(1).cast("long"))
    rnext = F.element_at(F.array(F.lit("*"), F.lit("="), F.lit("N"), F.lit("unknown")), (F.col("s_suppkey") % 4 + 1).cast("int"))
    return P.table(spark, d, "supplier").select((F.col("s_suppkey") % 4).alias("k"), scalars.mate_reference(rnext, F.col("s_suppkey"), names).cast("long").alias("mate_id"), "s_suppkey")


@query("SELECT s_suppkey, 'c' || s_suppkey AS sn, CAST(s_suppkey * 1000 AS BIGINT) AS ln FROM supplier")
def header_parse(spark, d):
    line = F.concat(F.lit("@SQ\tSN:c"), F.col("s_suppkey").cast("string"), F.lit("\tLN:"), (F.col("s_suppkey") * 1000).cast("string"))
    fields = codecs.header_fields(line)
    return P.table(spark, d, "supplier").select("s_suppkey", fields["SN"].alias("sn"), fields["LN"].cast("long").alias("ln"))


@query("SELECT p_partkey % 3 AS lane, count(*) AS reads, CAST(sum(2) AS BIGINT) AS bases, round(avg((p_size % 40 + 32) / 2e0), 6) AS avg_quality FROM part WHERE (p_size % 40 + 32) / 2e0 > 20 GROUP BY 1")
def fastq_statistics(spark, d):
    q = F.concat(F.char(F.col("p_size").cast("long") % 40 + 35), F.lit("?"))
    scored = P.table(spark, d, "part").select((F.col("p_partkey") % 3).alias("lane"), F.length(q).alias("n"), codecs.average_quality(q).alias("a")).where("a > 20")
    return scored.groupBy("lane").agg(F.count("*").alias("reads"), F.sum("n").alias("bases"), F.round(F.avg("a"), 6).alias("avg_quality"))


# Joins, set operations, windows and grouped forms over the proxies


@query("SELECT p_partkey, count(DISTINCT l_suppkey) AS carriers FROM part JOIN lineitem ON l_partkey = p_partkey AND l_linenumber % 3 <> 0 WHERE p_brand = 'Brand#1' OR p_size = 7 GROUP BY p_partkey")
def variant_id_lookup(spark, d):
    wanted = P.table(spark, d, "part").where((F.col("p_brand") == "Brand#1") | (F.col("p_size") == 7)).select(F.col("p_partkey").alias("position"))
    return variants.sparse(P.calls(spark, d)).join(wanted, "position").groupBy(F.col("position").alias("p_partkey")).agg(F.countDistinct("sample").alias("carriers"))


@query(READS + ", s AS (SELECT l_suppkey, count(*) AS n FROM reads WHERE reference_id >= 0 AND reference = 'N' AND position >= 250 AND position < 900 GROUP BY 1) SELECT count(*) AS samples, CAST(coalesce(sum(n), 0) AS BIGINT) AS reads FROM s")
def cohort_total(spark, d):
    each = regions.starts_in(P.mapped(spark, d), Region("N", 250, 900), SIZE).groupBy("l_suppkey").agg(F.count("*").alias("n"))
    return each.agg(F.count("*").alias("samples"), F.coalesce(F.sum("n"), F.lit(0)).alias("reads"))


@query("SELECT conv_id, turn, role, w AS word, count(*) AS times FROM (SELECT conv_id, turn, role, unnest(list_filter(string_split(text, ' '), lambda w: w <> '')) AS w FROM conversations) GROUP BY ALL")
def words_of_utterances(spark, d):
    """All words, each with its utterance's speaker, joined by the utterance."""
    turns = P.table(spark, d, "conversations")
    words = turns.select("conv_id", "turn", F.explode(F.split("text", " ")).alias("word")).where("word <> ''")
    counted = words.groupBy("conv_id", "turn", "word").agg(F.count("*").alias("times"))
    return counted.join(turns.select("conv_id", "turn", "role"), ["conv_id", "turn"])


@query(EVENTS + " SELECT t // 86400 AS day, count(*) FILTER (code = 'view') AS view, count(*) FILTER (code = 'click') AS click, count(*) FILTER (code = 'purchase') AS purchase FROM e GROUP BY 1")
def segment_tiers(spark, d):
    codes = ["view", "click", "purchase"]
    wide = P.annotations(spark, d).groupBy(F.expr("t div 86400").alias("day")).pivot("code", codes).agg(F.count(F.lit(1)))
    return wide.select("day", *(F.coalesce(c, F.lit(0)).alias(c) for c in codes))


@query(EVENTS + " SELECT participant, code, GROUPING_ID(participant, code) AS grouped, count(*) AS n, count(DISTINCT t // 86400) AS days FROM e GROUP BY ROLLUP (participant, code)")
def cross_session(spark, d):
    """By participant and code, by participant, and of all."""
    rolled = P.annotations(spark, d).withColumn("day", F.expr("t div 86400")).rollup("participant", "code")
    return rolled.agg(F.grouping_id().alias("grouped"), F.count("*").alias("n"), F.countDistinct("day").alias("days"))


@query(EVENTS + ", f AS (SELECT min(t) + 86400 AS s FROM e) SELECT id, t FROM e, f WHERE t >= s AND t < s + 7200")
def time_clip(spark, d):
    """The bound is read first, so that the clip is a range that the scan is given."""
    stamps = P.table(spark, d, "events").select("ts", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("t"))
    first = stamps.agg(F.min("t")).first()[0] or 0
    return annotations.clip(P.table(spark, d, "events"), "ts", first + 86400, 7200).select(F.col("event_id").alias("id"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("t"))


@query(EVENTS + " SELECT CAST(t - t % 3600 AS BIGINT) AS start, code, count(*) AS events FROM e GROUP BY ALL")
def tumbling_windows(spark, d):
    return ingest.windowed_counts(P.table(spark, d, "events"), "1 hour").select(F.unix_timestamp("start").alias("start"), "code", "events")


@query(EVENTS + " SELECT CAST(t - t % 3600 - k * 3600 AS BIGINT) AS start, code, count(*) AS events FROM e, (VALUES (0), (1)) v(k) GROUP BY ALL")
def sliding_windows(spark, d):
    return ingest.windowed_counts(P.table(spark, d, "events"), "2 hours", "1 hour").select(F.unix_timestamp("start").alias("start"), "code", "events")


@query(EVENTS + """ SELECT id, CAST(rank() OVER w AS INT) AS r, CAST(dense_rank() OVER w AS INT) AS dr, CAST(ntile(4) OVER x AS INT) AS q, round(percent_rank() OVER w, 6) AS pr, round(cume_dist() OVER w, 6) AS cd, first_value(id) OVER x AS f
    FROM e WINDOW w AS (PARTITION BY participant ORDER BY code), x AS (PARTITION BY participant ORDER BY code, id)""")
def ranking_family(spark, d):
    from pyspark.sql import Window

    w, x = (Window.partitionBy("participant").orderBy(*c) for c in (["code"], ["code", "id"]))
    return P.annotations(spark, d).select(
        "id", F.rank().over(w).alias("r"), F.dense_rank().over(w).alias("dr"), F.ntile(4).over(x).alias("q"), F.round(F.percent_rank().over(w), 6).alias("pr"), F.round(F.cume_dist().over(w), 6).alias("cd"), F.first("id").over(x).alias("f")
    )


@query(READS + " SELECT reference, count(DISTINCT position) AS positions, CAST(quantile_cont(span, 0.5) AS DOUBLE) AS median_span, min(span) AS least, max(span) AS most FROM reads GROUP BY reference")
def span_distribution(spark, d):
    return P.reads(spark, d).groupBy("reference").agg(F.countDistinct("position").alias("positions"), F.percentile("span", F.lit(0.5)).alias("median_span"), F.min("span").alias("least"), F.max("span").alias("most"))


@query("SELECT c_custkey, c_nationkey, coalesce(n, 0) AS orders FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def intervals_per_sample(spark, d):
    counts = P.table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return P.table(spark, d, "customer").join(counts, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", "c_nationkey", F.coalesce("n", F.lit(0)).alias("orders"))


@query("SELECT c_custkey, coalesce(n, 0) AS orders, coalesce(days, 0) AS days FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, count(DISTINCT o_orderdate) AS days FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def intervals_per_sample_whole(spark, d):
    counts = P.table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_distinct("o_orderdate").alias("days"))
    return P.table(spark, d, "customer").join(counts, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("orders"), F.coalesce("days", F.lit(0)).alias("days"))


@query("SELECT r_name, n_name, count(*) AS samples FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def population_counts(spark, d):
    joined = P.table(spark, d, "supplier").join(P.table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(P.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.groupBy("r_name", "n_name").agg(F.count("*").alias("samples"))


# Stored datasets: written to the shared folder, read back from there


def _stored(spark: SparkSession, d: str, rows: DataFrame | None = None) -> str:
    path = _folder(spark)
    dataset.write(P.reads(spark, d) if rows is None else rows, path, SIZE)
    return path


@query(READS + " SELECT l_orderkey, l_linenumber, l_suppkey, position, span FROM reads WHERE reference_id >= 0 AND reference = 'A' AND position >= 30 AND position < 90")
def stored_region(spark, d):
    return dataset.query(spark, _stored(spark, d), "A:30-90").select("l_orderkey", "l_linenumber", "l_suppkey", "position", "span")


@query(READS + " SELECT l_orderkey, l_linenumber, l_suppkey, position, span FROM reads WHERE reference_id >= 0 AND reference = 'N' AND position < 140 AND position + span > 120")
def stored_overlap(spark, d):
    return dataset.query(spark, _stored(spark, d), "N:120-140", mode="overlap").select("l_orderkey", "l_linenumber", "l_suppkey", "position", "span")


@query(READS + """, named AS (SELECT * FROM (VALUES ('r1', 'A', 10, 60), ('r2', 'N', 50, 300), ('r3', 'R', 0, 2000)) v(name, ref, s, e))
    SELECT name, l_orderkey, l_linenumber, l_suppkey, position FROM reads JOIN named ON reference = ref AND position >= s AND position < e WHERE reference_id >= 0""")
def stored_regions(spark, d):
    named = _few(spark, "name reference start end", [("r1", "A", 10, 60), ("r2", "N", 50, 300), ("r3", "R", 0, 2000)])
    return dataset.query_many(spark, _stored(spark, d), named).select("name", *TIES, "position")


@query(READS + " SELECT CASE WHEN reference_id < 0 THEN 'unmapped' ELSE reference END AS reference, position, l_orderkey, l_linenumber, l_suppkey FROM reads")
def stored_append(spark, d):
    """Three batches, one of them written twice as after a failure."""
    rows, path = P.reads(spark, d), _folder(spark)
    for k in (0, 1, 2, 1):
        dataset.append(rows.where(F.col("l_linenumber") % 3 == k), path, SIZE, batch=f"b{k}")
    return dataset.read(spark, path).select("reference", "position", *TIES)


@query(READS + " SELECT CASE WHEN reference_id < 0 THEN 'unmapped' ELSE reference END AS reference, CASE WHEN reference_id < 0 THEN 0 ELSE position // 1024 * 1024 END AS chunk_start, l_orderkey, l_linenumber, l_suppkey FROM reads")
def stored_rechunk(spark, d):
    path, target = _stored(spark, d), _folder(spark)
    dataset.rechunk(spark, path, target, 1024, "snappy")
    return dataset.read(spark, target).select("reference", "chunk_start", *TIES)


@query(READS.replace("reads AS (", "raw AS (").replace("FROM lineitem\n)", "FROM lineitem\n), reads AS (SELECT * REPLACE (CASE WHEN reference_id >= 0 THEN reference END AS reference) FROM raw)") + _checksum_sql("flag", "l_linenumber", "l_orderkey", "l_suppkey", "mapq", "position", "reference_id", "span") + """,
    m AS (SELECT reference, chunk_start, CAST(sum(span) AS BIGINT) AS bases, max(span) AS max_span FROM reads GROUP BY ALL)
    SELECT c.reference, CAST(c.chunk_start AS BIGINT) AS chunk_start, c.reads, bases, max_span, checksum FROM c JOIN m ON c.reference IS NOT DISTINCT FROM m.reference AND c.chunk_start = m.chunk_start""")
def stored_manifest(spark, d):
    """The manifest that three batches have left, merged."""
    rows, path = P.reads(spark, d), _folder(spark)
    for k in range(3):
        dataset.append(rows.where(F.col("l_linenumber") % 3 == k), path, SIZE, batch=f"b{k}")
    return dataset.read_manifest(spark, path).select("reference", "chunk_start", F.col("reads").cast("long").alias("reads"), "bases", "max_span", "checksum")


@query(READS + """, c AS (SELECT CASE WHEN reference_id >= 0 THEN reference END AS reference, chunk_start, count(*) AS n FROM reads GROUP BY ALL)
    SELECT rule, CAST(CASE rule WHEN 'chunk_not_listed' THEN (SELECT count(*) FROM c WHERE reference = 'A') WHEN 'reads_differ' THEN (SELECT count(*) FROM c WHERE reference = 'R') WHEN 'checksum_differs' THEN (SELECT count(*) FROM c WHERE reference = 'R')
        WHEN 'chunks_overlap' THEN (SELECT count(*) FROM c WHERE reference = 'N' AND chunk_start = 0) WHEN 'files_missing' THEN 1 WHEN 'wrong_width' THEN 1 ELSE 0 END AS BIGINT) AS violations
    FROM (VALUES ('files_missing'), ('chunk_not_listed'), ('reads_differ'), ('checksum_differs'), ('span_too_short'), ('wrong_width'), ('chunks_overlap'), ('row_outside_its_chunk')) v(rule)""")
def stored_violations(spark, d):
    """A dataset whose manifest was spoiled: no entries of A, other counts and sums for R, an entry of N that overlaps its first chunk and has no files."""
    path = _stored(spark, d)
    entries = spark.read.parquet(f"{path}/manifest").where("reference is null or reference <> 'A'")
    off = F.when(F.col("reference") == "R", 1).otherwise(0)
    spoiled = entries.withColumns({"reads": F.col("reads") + off, "hash_xor": F.col("hash_xor") + off})
    extra = entries.where("reference = 'N' and chunk_start = 0").withColumns({"chunk_start": F.lit(7).cast("long"), "path": F.lit("N/7")})
    # What is read from a folder is written to another one, which then takes its place.
    spoiled.unionByName(extra).write.partitionBy("batch").parquet(f"{path}/spoiled")
    shared.replace(spark, f"{path}/spoiled", f"{path}/manifest")
    return dataset.violations(spark, path)


@query(READS + " SELECT count(*) AS reads, count(*) FILTER (reference_id >= 0) AS mapped, CAST(sum(span) AS BIGINT) AS bases, count(DISTINCT CASE WHEN reference_id >= 0 THEN reference END) AS \"references\", (SELECT count(*) FROM (SELECT DISTINCT CASE WHEN reference_id >= 0 THEN reference END, chunk_start FROM reads)) AS chunks, true AS has_bytes FROM reads")
def ingest_counters(spark, d):
    """What is counted on the way in, and of the chunks and bytes that were written."""
    path = _folder(spark)
    rows, seen = dataset.counted_rows(P.reads(spark, d))
    dataset.write(rows, path, SIZE)
    got = seen.get
    files = dataset.chunk_files(spark, path).agg(F.count("*").alias("chunks"), (F.sum("bytes") > 0).alias("has_bytes"))
    counted = spark.createDataFrame([tuple(got[k] for k in ("reads", "mapped", "bases", "references"))], "reads long, mapped long, bases long, references long")
    return counted.join(files).select("*")


@query(READS + " SELECT l_suppkey, position, count(*) AS n FROM reads WHERE l_suppkey = 3 GROUP BY ALL")
def view_of_sample(spark, d):
    path = _folder(spark)
    dataset.write_views(P.reads(spark, d).drop("chunk_start"), path, "l_suppkey", "position")
    return dataset.read_view(spark, path, "l_suppkey").where("l_suppkey = 3").groupBy("l_suppkey", "position").agg(F.count("*").alias("n"))


@query(READS + " SELECT l_suppkey, position, count(*) AS n FROM reads WHERE position >= 20 AND position < 60 GROUP BY ALL")
def view_of_positions(spark, d):
    path = _folder(spark)
    dataset.write_views(P.reads(spark, d).drop("chunk_start"), path, "l_suppkey", "position")
    return dataset.read_view(spark, path, "position").where("position >= 20 and position < 60").groupBy("l_suppkey", "position").agg(F.count("*").alias("n"))


@query(READS + " SELECT position, l_orderkey, l_linenumber, l_suppkey FROM reads WHERE position >= 100 AND position < 150")
def hierarchy_range(spark, d):
    path = _folder(spark)
    dataset.write_hierarchy(P.reads(spark, d).drop("chunk_start"), path, "position", 1024, 64)
    return dataset.read_hierarchy(spark, path, "position", 100, 150, 1024, 64).select("position", *TIES)


@query(READS + " SELECT l_suppkey % 4 AS sample_id, reference, count(*) AS reads FROM reads WHERE reference_id >= 0 GROUP BY ALL")
def multi_sample(spark, d):
    """Four samples' datasets in one table."""
    rows = P.mapped(spark, d)
    paths = {k: _stored(spark, d, rows.where(F.col("l_suppkey") % 4 == k)) for k in range(4)}
    whole = dataset.union(dataset.read(spark, p).withColumn("sample_id", F.lit(k).cast("long")) for k, p in paths.items())
    return whole.groupBy("sample_id", "reference").agg(F.count("*").alias("reads"))


@query(READS + " SELECT source, target, CAST(n AS BIGINT) AS reads, written, true AS done FROM (SELECT count(*) AS n FROM reads), (VALUES ('a', 'x', true), ('a', 'y', true), ('a', 'x', false), ('a', 'x', true), ('a', 'y', true)) v(source, target, written)")
def batch_migration(spark, d):
    """A list of jobs: two new targets, one that is there already, and both again at another width or codec."""
    path, x, y = _stored(spark, d), _folder(spark), _folder(spark)
    names = F.create_map(*(F.lit(v) for pair in ((path, "a"), (x, "x"), (y, "y")) for v in pair))
    jobs = [(path, x, 512, "zstd"), (path, y, 1024, "snappy"), (path, x, 512, "zstd"), (path, x, 1024, "zstd"), (path, y, 1024, "zstd")]
    return dataset.migrate(spark, jobs).select(names[F.col("source")].alias("source"), names[F.col("target")].alias("target"), F.col("after").alias("reads"), "written", "done")


@query(READS + """, c AS (SELECT CASE WHEN reference_id >= 0 THEN reference ELSE 'unmapped' END AS reference, chunk_start, count(*) AS n FROM reads GROUP BY ALL)
    SELECT reference, count(*) AS chunks, CAST(max(chunk_start) AS BIGINT) AS last_start, CAST(sum(n) AS BIGINT) AS reads FROM c GROUP BY reference""")
def index_with_unmapped(spark, d):
    index = manifest.index_entries(manifest.build(P.reads(spark, d), SIZE))
    total = F.aggregate("chunks", F.lit(0).cast("long"), lambda a, c: a + c["reads"])
    return index.select("reference", F.size("chunks").cast("long").alias("chunks"), F.element_at("chunks", -1)["start"].alias("last_start"), total.alias("reads"))


@query(READS + """, c AS (SELECT reference || '/' || lpad(CAST(chunk_start AS VARCHAR), 9, '0') || '-' || lpad(CAST(chunk_start + 256 AS VARCHAR), 9, '0') || '.chunk' AS path, count(*) AS reads FROM reads WHERE reference_id >= 0 GROUP BY 1)
    SELECT p.path, coalesce(c.reads, -1) AS reads FROM (VALUES ('A/000000000-000000256.chunk'), ('N/000000000-000000256.chunk'), ('nowhere')) p(path) LEFT JOIN c ON c.path = p.path""")
def chunk_lookup(spark, d):
    paths = spark.createDataFrame([("A/000000000-000000256.chunk",), ("N/000000000-000000256.chunk",), ("nowhere",)], "path string")
    return manifest.chunk_info(manifest.build(P.reads(spark, d), SIZE), paths).select("path", F.coalesce("reads", F.lit(-1)).alias("reads"))


@query("""WITH c AS (SELECT 's' || lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS reference, l_partkey // 256 AS c, count(*) AS n, sum(CAST(l_quantity AS INT)) AS b FROM lineitem GROUP BY ALL), r AS (SELECT DISTINCT reference FROM c)
    SELECT (SELECT count(*) FROM c) AS chunks, (SELECT CAST(sum(n) AS BIGINT) FROM c) AS reads, (SELECT CAST(sum(b) AS BIGINT) FROM c) AS bases, (SELECT count(*) FROM r) AS "references",
        (SELECT string_agg(reference, ', ' ORDER BY reference) FROM (SELECT reference FROM r ORDER BY reference LIMIT 10)) || CASE WHEN (SELECT count(*) FROM r) > 10 THEN ' and ' || ((SELECT count(*) FROM r) - 10) || ' more' ELSE '' END AS first_references""")
def dataset_info(spark, d):
    rows = P.placed(spark, d).withColumns({"reference": F.concat(F.lit("s"), F.lpad(F.col("l_suppkey").cast("string"), 6, "0")), "reference_id": F.lit(0)})
    return manifest.info(manifest.build(rows, SIZE))


@query(READS + """, f AS (SELECT reference, greatest(max(position) - 128, 0) AS settled FROM reads WHERE reference_id >= 0 GROUP BY reference)
    SELECT reference, CAST(position // 64 * 64 AS BIGINT) AS chunk_start, count(*) AS reads FROM reads JOIN f USING (reference) WHERE reference_id >= 0 AND position // 64 * 64 + 64 <= settled GROUP BY ALL""")
def settled_chunks(spark, d):
    return ingest.settled_chunks(P.mapped(spark, d, 64), 64)


# Files of other formats, written and read


@query(READS + """ SELECT l_orderkey || ':' || l_linenumber || ':' || l_suppkey AS name, CASE WHEN reference_id >= 0 THEN reference ELSE '*' END AS reference, position, mapq, flag, span, CAST(l_linenumber AS VARCHAR) AS tag FROM reads""")
def bam_roundtrip(spark, d):
    """All rows as a binary alignment file and back."""
    rows = P.reads(spark, d).withColumns({"name": F.concat_ws(":", *TIES), "reference": F.when(F.col("reference_id") >= 0, F.col("reference")), "cigar": F.concat(F.col("span").cast("string"), F.lit("M")), "tags": F.create_map(F.lit("LN"), F.col("l_linenumber").cast("string"))})
    rows = rows.withColumns({c: F.lit(None).cast("string") for c in ("mate_reference", "sequence", "quality")} | {c: F.lit(0) for c in ("mate_position", "template_length")})
    path = _folder(spark)
    bam.write_bam(rows, "@HD\tVN:1.6\tSO:coordinate\n", [(r, 1 << 28) for r in "ANR"], path)
    back = bam.read_bam(spark, path)
    return back.select("name", F.coalesce("reference", F.lit("*")).alias("reference"), F.col("position").cast("long").alias("position"), "mapq", "flag", "span", codecs.tag_value(F.col("tags")["LN"]).alias("tag"))


@query("SELECT '@HD' || chr(9) || 'VN:1.6' AS value UNION ALL SELECT '@SQ' || chr(9) || 'SN:c' || s_suppkey || chr(9) || 'LN:' || s_suppkey * 1000 FROM supplier UNION ALL SELECT '@RG' || chr(9) || 'ID:rg1' || chr(9) || 'SM:s1' UNION ALL SELECT '@CO' || chr(9) || 'made: by hand'")
def header_roundtrip(spark, d):
    """Header lines parsed, stored as JSON beside a dataset, read and formatted again."""
    sq = P.table(spark, d, "supplier").select(F.concat(F.lit("@SQ\tSN:c"), F.col("s_suppkey").cast("string"), F.lit("\tLN:"), (F.col("s_suppkey") * 1000).cast("string")).alias("value"))
    others = spark.createDataFrame([("@HD\tVN:1.6",), ("@RG\tID:rg1\tSM:s1",), ("@CO\tmade: by hand",)], "value string")
    path = _folder(spark)
    dataset.write_header(text_formats.sam_header(sq.unionByName(others)), path)
    return text_formats.format_header(dataset.read_header(spark, path)).select("value")


@query(READS + " SELECT count(*) + 3 AS lines, count(*) AS records FROM reads")
def line_counts(spark, d):
    path = _folder(spark)
    body = P.reads(spark, d).select(F.concat_ws("\t", *TIES).alias("value"))
    spark.createDataFrame([("@HD",), ("@SQ",), ("@CO",)], "value string").unionByName(body).write.text(path)
    return text_formats.line_counts(spark.read.text(path), "@")


@query(READS + " SELECT concat_ws(chr(9), l_orderkey, flag, reference, position + 1, mapq, span || 'M', '*', 0, 0, '*', '*') AS value FROM reads")
def sam_display(spark, d):
    rows = P.reads(spark, d).withColumns({"name": F.col("l_orderkey").cast("string"), "cigar": F.concat(F.col("span").cast("string"), F.lit("M")), "sequence": F.lit(None).cast("string"), "quality": F.lit(None).cast("string")})
    return text_formats.format_simple(rows)


_VCF = """, b AS (SELECT position, sample, max(dosage) AS dosage FROM calls WHERE dosage <> 0 AND sample IN (1, 2, 3) GROUP BY ALL),
    w AS (SELECT position, max(dosage) FILTER (sample = 1) AS a, max(dosage) FILTER (sample = 2) AS b, max(dosage) FILTER (sample = 3) AS c FROM b GROUP BY position)"""


@query(CALLS + _VCF + """ SELECT '##fileformat=VCFv4.2' AS value UNION ALL SELECT concat_ws(chr(9), '#CHROM', 'POS', 'ID', 'REF', 'ALT', 'QUAL', 'FILTER', 'INFO', 'FORMAT', '1', '2', '3') UNION ALL
    SELECT concat_ws(chr(9), '1', position, '.', 'A', 'G', '.', 'PASS', '.', 'GT', ['0/0', '0/1', '1/1'][coalesce(a, 0) + 1], ['0/0', '0/1', '1/1'][coalesce(b, 0) + 1], ['0/0', '0/1', '1/1'][coalesce(c, 0) + 1]) FROM w""")
def vcf_concat(spark, d):
    """Variant files of two overlapping regions as one."""
    lines, path = variants.vcf_lines(P.calls(spark, d), [1, 2, 3]), _folder(spark)
    head = ["##fileformat=VCFv4.2", "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", "1", "2", "3"])]
    for k, part in enumerate((lines.where("position < 120"), lines.where("position >= 100"))):
        text_formats.write_vcf(head, part.select("position", F.col("line").alias("value")), f"{path}/part={k}")
    return text_formats.concat_vcf(text_formats.read_vcf_lines(spark, path))


@query(CALLS + _VCF + """ SELECT sample, position - 1 AS position, ['0/0', '0/1', '1/1'][dosage + 1] AS genotype FROM (SELECT position, unnest([{'s': '1', 'd': a}, {'s': '2', 'd': b}, {'s': '3', 'd': c}]) AS u FROM w) t, LATERAL (SELECT u.s AS sample, u.d AS dosage) WHERE dosage IS NOT NULL""")
def vcf_calls(spark, d):
    """Genotypes read back from two files whose sample columns are in another order."""
    calls, path = P.calls(spark, d), _folder(spark)
    for k, samples in enumerate(([1, 2, 3], [3, 1, 2])):
        lines = variants.vcf_lines(calls.where(F.col("position") % 2 == k), samples).select("position", F.col("line").alias("value"))
        head = "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *map(str, samples)])
        text_formats.write_vcf([head], lines, f"{path}/part={k}")
    return text_formats.parse_vcf(text_formats.read_vcf_lines(spark, path)).select("sample", "position", "genotype")


@query("SELECT p_partkey AS position, p_retailprice AS qual, p_size AS depth FROM part WHERE p_partkey >= 20 AND p_partkey < 180 AND p_retailprice >= 910 AND p_size > 30")
def variant_predicates(spark, d):
    """Site columns written as Parquet; reference, position, quality and depth reach the scan."""
    part, path = P.table(spark, d, "part"), _folder(spark)
    lines = part.select(F.concat_ws("\t", F.lit("1"), F.col("p_partkey") + 1, F.lit("."), F.lit("A"), F.lit("G"), F.col("p_retailprice"), F.lit("PASS"), F.concat(F.lit("AC=1;DP="), "p_size")).alias("value"))
    text_formats.vcf_sites(lines).write.parquet(path)
    return variants.filtered(spark.read.parquet(path), "1", 20, 180, 910.0, 31).select("position", F.col("qual"), F.col("depth").cast("long").alias("depth"))


@query()
def site_sketch(spark, d):
    return variants.site_sketch(P.calls(spark, d))


@query("SELECT s_suppkey || '_1' AS sample_id, 's3://reads/' || s_suppkey || '_R1.fastq' AS reads_r1, 's3://reads/' || s_suppkey || '_R2.fastq' AS reads_r2 FROM supplier")
def sample_sheet(spark, d):
    path, key = _folder(spark), F.col("s_suppkey").cast("string")
    sheet = P.table(spark, d, "supplier").select(F.concat(key, F.lit("_1")).alias("sample_id"), *(F.concat(F.lit("s3://reads/"), key, F.lit(f"_R{k}.fastq")).alias(f"reads_r{k}") for k in (1, 2)))
    sheet.write.csv(path, header=True)
    return text_formats.read_sample_sheet(spark, path)


@query(READS + ", b AS (SELECT 'A' AS ref, s_suppkey * 7 AS s, s_suppkey * 7 + 9 AS e FROM supplier) SELECT 'A_' || s || '_' || e AS name, count(*) AS reads FROM reads JOIN b ON reference = ref AND position >= s AND position < e WHERE reference_id >= 0 GROUP BY 1")
def bed_regions(spark, d):
    path = _folder(spark)
    P.samples(spark, d).select(F.lit("A"), F.col("sample") * 7, F.col("sample") * 7 + 9).write.csv(path, sep="\t")
    return regions.join_regions(P.mapped(spark, d), text_formats.read_bed(spark, path), SIZE).groupBy("name").agg(F.count("*").alias("reads"))


@query("SELECT s, count(*) AS n FROM (SELECT substr(sha256('reads/' || l_orderkey || '.chunk'), 1, 1) AS s FROM lineitem) WHERE s IN ('3', 'a') GROUP BY s")
def sharded_scan(spark, d):
    """Rows in folders by the hash prefix of their path; a scan of two prefixes reads two folders."""
    path = _folder(spark)
    rows = P.table(spark, d, "lineitem").select("l_orderkey", scalars.shard_prefix(F.concat(F.lit("reads/"), F.col("l_orderkey").cast("string"), F.lit(".chunk")), 4).alias("s"))
    rows.hint("rebalance", "s").write.partitionBy("s").parquet(path)
    return spark.read.schema("l_orderkey long, s string").parquet(path).where("s in ('3', 'a')").groupBy("s").agg(F.count("*").alias("n"))


# Transcripts, tiers and exports


_WORDS = "SELECT conv_id || ':' || turn AS id, unnest(list_filter(string_split(text, ' '), lambda w: w <> '')) AS word FROM conversations"


@query(f"SELECT word, count(*) AS times, count(DISTINCT id) AS utterances FROM ({_WORDS}) GROUP BY word")
def transcript_words(spark, d):
    """Conversations as transcripts, one a line, and their words from there."""
    words = F.filter(F.split("text", " "), lambda w: w != "")
    word = F.transform(words, lambda w, k: F.struct(w.alias("word"), k.cast("double").alias("start_time"), (k + 1).cast("double").alias("end_time")))
    spoken = P.table(spark, d, "conversations").select("conv_id", F.struct(F.concat_ws(":", "conv_id", "turn").alias("id"), F.col("role").alias("speaker"), F.col("turn").cast("double").alias("start_time"), F.col("text"), word.alias("words")).alias("u"))
    path = _folder(spark)
    spoken.groupBy("conv_id").agg(F.collect_list("u").alias("utterances")).select(F.to_json(F.struct("utterances")).alias("value")).write.text(path)
    return sidecars.read_words(spark, path, lines=True).groupBy("word").agg(F.count("*").alias("times"), F.count_distinct("utterance_id").alias("utterances"))


@query(EVENTS + " SELECT id, CAST(t AS DOUBLE) AS start_time FROM e WHERE code = 'click' AND participant % 3 = 1")
def tier_codes(spark, d):
    """Tiers as JSON lines, read, and one tier's annotations of one code."""
    path, tier = _folder(spark), F.concat(F.lit("t"), (F.col("participant") % 3).cast("string"))
    one = F.struct(F.col("id").cast("string").alias("id"), F.col("t").cast("double").alias("time"), "code", F.col("participant").cast("string").alias("participant"))
    files = P.annotations(spark, d).groupBy(tier.alias("tier"), F.expr("t div 86400").alias("day")).agg(F.collect_list(one).alias("annotations"))
    files.select(F.to_json(F.struct("tier", "annotations")).alias("value")).write.text(path)
    return annotations.of_tier(sidecars.read_tiers(spark, path, lines=True), "t1", "click").select(F.col("id").cast("long").alias("id"), "start_time")


@query(EVENTS + " SELECT 'all' AS tier, CAST(id AS VARCHAR) AS id, CAST(t AS DOUBLE) AS start_time, code, 'p' || participant || ';x' AS participants FROM e")
def annotation_export(spark, d):
    """Annotations exported as CSV, JSON and XML, counted to be the same, and the CSV's rows."""
    who = F.array(F.concat(F.lit("p"), F.col("participant").cast("string")), F.lit("x"))
    start = F.col("t").cast("double")
    rows = P.annotations(spark, d).select(F.lit("all").alias("tier"), F.col("id").cast("string").alias("id"), start.alias("start_time"), start.alias("end_time"), "code", who.alias("participants"), F.create_map(F.lit("v"), F.col("value").cast("string")).alias("metadata"))
    path = _folder(spark)
    sidecars.write_csv(rows, f"{path}/csv")
    sidecars.write_json(rows, f"{path}/json")
    sidecars.write_xml(rows, f"{path}/xml")
    names = "tier string, id string, start_time double, end_time double, code string, participants string, metadata string"
    csv = spark.read.schema(names).csv(f"{path}/csv", header=True).select("tier", "id", "start_time", "code", "participants")
    json = spark.read.schema("tier string, id string, start_time double, code string, participants array<string>").json(f"{path}/json").withColumn("participants", F.array_join("participants", ";"))
    xml = spark.read.schema(names).option("rowTag", "ANNOTATION").format("xml").load(f"{path}/xml").select(csv.columns)
    return csv.intersectAll(json).intersectAll(xml)


@query("""WITH u AS (SELECT role AS speaker, turn * 10 AS s, turn * 10 + length(text) % 45 + 1 AS e FROM conversations), k AS (SELECT speaker, s, e, unnest(range(s // 30, (e - 1) // 30 + 1)) AS segment FROM u)
    SELECT speaker, CAST(segment AS BIGINT) AS segment, count(*) AS utterances, CAST(sum(least(e, segment * 30 + 30) - greatest(s, segment * 30)) AS BIGINT) AS seconds FROM k GROUP BY ALL""")
def speaker_times(spark, d):
    start = (F.col("turn") * 10).cast("long")
    spoken = P.table(spark, d, "conversations").select(F.col("role").alias("speaker"), start.alias("start"), (start + F.length("text") % 45 + 1).alias("end"))
    return annotations.speaker_times(spoken, 30)


@query(EVENTS + " SELECT id, t // 30 AS segment, strftime(to_timestamp(t) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M') AS minute FROM e")
def segment_of_time(spark, d):
    return P.annotations(spark, d).select("id", scalars.segment_index(F.col("t")).alias("segment"), F.date_format(F.timestamp_seconds("t"), "yyyy-MM-dd HH:mm").alias("minute"))


@query(READS + " SELECT count(*) AS total_reads, count(*) FILTER (flag & 4 = 0) AS mapped_reads, count(*) FILTER (flag & 4 <> 0) AS unmapped_reads FROM reads")
def mapped_by_flag(spark, d):
    return summaries.dataset_statistics(P.reads(spark, d), 6000, mapped_by="flag").select("total_reads", "mapped_reads", "unmapped_reads")


@query(READS + " SELECT l_orderkey, position, mapq, span || 'M' AS cigar FROM reads WHERE reference_id >= 0 AND reference = 'A' AND position >= 30 AND position < 90")
def simple_projection(spark, d):
    rows = dataset.query(spark, _stored(spark, d), "A:30-90")
    return rows.select("l_orderkey", "position", "mapq", F.concat(F.col("span").cast("string"), F.lit("M")).alias("cigar"))


@query(READS + """, c AS (SELECT CASE WHEN reference_id < 0 THEN 'unmapped' ELSE reference END AS reference, CAST(chunk_start AS BIGINT) AS chunk_start FROM reads GROUP BY ALL) SELECT reference, chunk_start, true AS has_bytes FROM c""")
def stored_sizes(spark, d):
    return dataset.chunk_files(spark, _stored(spark, d)).select("reference", "chunk_start", ((F.col("files") >= 1) & (F.col("bytes") > 0)).alias("has_bytes"))


@query(READS + """, c AS (SELECT reference, chunk_start, count(*) AS n FROM reads WHERE reference_id >= 0 GROUP BY ALL) SELECT reference, CAST(chunk_start AS BIGINT) AS chunk_start, n AS reads, CAST(row_number() OVER (ORDER BY reference, chunk_start) AS BIGINT) AS place FROM c""")
def export_order(spark, d):
    """Chunks in the order of an export: references by name, then by start; places inside each reference, and what the references before it have."""
    return ordering.export_places(manifest.build(P.mapped(spark, d), SIZE)).select("reference", "chunk_start", "reads", "place")


@query(READS + ", c AS (SELECT sum(span) AS b FROM reads GROUP BY CASE WHEN reference_id >= 0 THEN reference END, chunk_start) SELECT count(*) AS chunks, CAST(sum(b) * 1.5e0 AS DOUBLE) AS bytes, round(count(*) * 2 / 1000e0 * 0.0004e0 + sum(b) * 1.5e0 / 1073741824e0 * 0.09e0, 12) AS cost FROM c")
def migration_estimate(spark, d):
    return maintenance.migration_estimate(manifest.build(P.reads(spark, d), SIZE), 1.5).withColumn("cost", F.round("cost", 12))


@query("""WITH u AS (SELECT conv_id AS conversation, role AS speaker, turn * 10 AS start, turn * 10 + length(text) % 25 AS e FROM conversations)
    SELECT conversation, start, speaker, coalesce(start - lag(e) OVER (PARTITION BY conversation ORDER BY start, e, speaker), -999) AS pause FROM u""")
def turn_taking(spark, d):
    start = (F.col("turn") * 10).cast("long")
    spoken = P.table(spark, d, "conversations").select(F.col("conv_id").alias("conversation"), F.col("role").alias("speaker"), start.alias("start"), (start + F.length("text") % 25).alias("end"))
    return annotations.turn_taking(spoken).withColumn("pause", F.coalesce("pause", F.lit(-999)))


@query(READS + " SELECT l_orderkey, l_linenumber, l_suppkey, position, flag, CAST(span AS VARCHAR) AS span_tag FROM reads")
def records_json(spark, d):
    """Records as JSON texts and parsed back."""
    rows = P.reads(spark, d).withColumn("tags", F.create_map(F.lit("SP"), F.col("span").cast("string")))
    text = rows.select(F.to_json(F.struct(*TIES, "position", "flag", "tags")).alias("json"))
    back = text.select(F.from_json("json", "l_orderkey long, l_linenumber int, l_suppkey long, position long, flag int, tags map<string,string>").alias("r"))
    return back.select(*(F.col(f"r.{c}").alias(c) for c in (*TIES, "position", "flag")), F.col("r.tags")["SP"].alias("span_tag"))


@query("SELECT p_partkey AS read_id, repeat('ACGT', p_size % 5 + 1) AS sequence, repeat('@+I', p_size % 5 + 1) || repeat('!', p_size % 5 + 1) AS quality FROM part")
def fastq_reads(spark, d):
    """Reads written as four lines each, in several files, and read in splits; many quality lines begin with "@"."""
    n, path = (F.col("p_size") % 5 + 1).cast("int"), _folder(spark)
    quality = F.concat(F.repeat(F.lit("@+I"), n), F.repeat(F.lit("!"), n))
    rows = P.table(spark, d, "part").select(F.concat_ws("\n", F.concat(F.lit("@"), F.col("p_partkey").cast("string"), F.lit(" x")), F.repeat(F.lit("ACGT"), n), F.lit("+"), quality).alias("value"))
    rows.repartition(3).write.text(path)
    return text_formats.read_fastq(spark, path).select(F.col("read_id").cast("long").alias("read_id"), "sequence", "quality")


@query("WITH m AS (SELECT p_brand AS brand, count(*) AS sites FROM part GROUP BY 1) SELECT line FROM (VALUES ('## Sites'), (''), ('| brand | sites |'), ('| --- | --- |')) v(line) UNION ALL SELECT '| ' || brand || ' | ' || sites || ' |' FROM m")
def markdown_report(spark, d):
    sites = P.table(spark, d, "part").groupBy(F.col("p_brand").alias("brand")).agg(F.count("*").alias("sites")).orderBy("brand")
    return maintenance.markdown(sites, "Sites").select("line")


@query(READS + " SELECT l_orderkey || ':' || l_linenumber || ':' || l_suppkey AS name, CAST(reference_id AS INT) AS reference_id, position, mapq, flag, span FROM reads")
def chunk_files_scan(spark, d):
    """Older chunk files, half of them packed and half JSON, told apart by their first bytes."""
    folder = _folder(spark)
    # About 2,000 rows a file, however many there are.
    chunks = max(8, P.table(spark, d, "lineitem").count() // 2000)
    rows = P.reads(spark, d).select(F.concat_ws(":", *TIES).alias("name"), "flag", "reference_id", F.col("position").cast("int").alias("position"), "mapq", F.concat(F.col("span").cast("string"), F.lit("M")).alias("cigar"), (F.col("l_orderkey") % chunks).alias("chunk"))
    record = F.struct("name", "flag", F.col("reference_id").alias("ref"), F.col("position").alias("pos"), "mapq", "cigar", F.lit("").alias("seq"), F.lit("").alias("qual"))
    rows.where("chunk % 2 = 1").groupBy("chunk").agg(F.to_json(F.collect_list(record)).alias("value")).select("value").write.option("maxRecordsPerFile", 1).text(f"{folder}/json")

    def packed(key, pdf):
        import pandas as pd

        records = [(*r, "", "", {}) for r in pdf[["name", "flag", "reference_id", "position", "mapq", "cigar"]].itertuples(index=False)]
        return pd.DataFrame({"value": [chunk_files.pack(records)]})

    chunks = rows.where("chunk % 2 = 0").groupBy("chunk").applyInPandas(packed, "value binary")
    # Spark has no sink for plain bytes; in a text file a chunk is followed by a line end, which unpacking leaves alone.
    chunks.select(F.col("value").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).text(f"{folder}/packed")
    return chunk_files.read_any(spark, folder, "part-*").select("name", "reference_id", F.col("position").cast("long").alias("position"), "mapq", "flag", "span")


from locus import registry_layouts  # noqa: E402, F401  (registers more queries)
