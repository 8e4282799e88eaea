"""Registered queries of streams, indexes, layouts and versions, with their SQL oracles."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from locus import proxies as P
from locus.functions import codecs
from locus.operators import agreement, alleles, intervals, patterns
from locus.operators.regions import Region
from locus.registry import CALLS, EVENTS, READS, SIZE, TIES, _folder, query
from locus.plans import sketches
from locus.sources import adaptive, bam, bam_index, clusters, dataset, sidecars, snapshots, text_formats, variant_store, zorder
from locus.streaming import frontier, ingest

# The frontier as a stream

#: Rows arrive in five batches by position, but for every eleventh order, which arrives in the last one.
_ARRIVAL = """, top AS (SELECT max(position) + 1 AS n FROM reads), arrived AS (
    SELECT reference, position // 64 * 64 AS chunk_start, position, span, CASE WHEN l_orderkey % 11 = 0 THEN 4 ELSE position * 4 // n END AS batch FROM reads, top WHERE reference_id >= 0
), passed AS (SELECT r.reference, b.batch, max(position) - 128 AS bound FROM (SELECT DISTINCT reference FROM arrived) r, range(5) b(batch) JOIN arrived a ON a.batch <= b.batch AND a.reference = r.reference GROUP BY ALL),
judged AS (SELECT a.*, coalesce(a.chunk_start + 64 <= p.bound, false) AS late FROM arrived a LEFT JOIN passed p ON p.reference = a.reference AND p.batch = a.batch - 1),
settles AS (SELECT reference, chunk_start, min(batch) FILTER (chunk_start + 64 <= bound) AS told FROM (SELECT DISTINCT reference, chunk_start FROM judged WHERE NOT late) JOIN passed USING (reference) GROUP BY ALL)
SELECT 'late' AS kind, reference, CAST(chunk_start AS BIGINT) AS chunk_start, count(*) AS reads, CAST(sum(span) AS BIGINT) AS bases FROM judged WHERE late GROUP BY ALL
UNION ALL SELECT CASE WHEN told IS NULL THEN 'open' ELSE 'settled' END, reference, CAST(chunk_start AS BIGINT), count(*), CAST(sum(span) AS BIGINT) FROM judged JOIN settles USING (reference, chunk_start) WHERE NOT late GROUP BY ALL"""


@query(READS + _ARRIVAL)
def frontier_stream(spark, d):
    """Rows that arrive as files in five batches, some of them late: chunks told as settled, late rows, and what is open at the end."""
    rows = P.mapped(spark, d).select("reference", "position", "span", "l_orderkey")
    top = rows.agg(F.max("position") + 1).first()[0] or 1
    batch = F.when(F.col("l_orderkey") % 11 == 0, 4).otherwise(F.expr(f"position * 4 div {top}"))
    arrivals, target, checkpoint = (_folder(spark) for _ in range(3))
    for k in range(5):  # one after the other: a file stream goes by the files' times
        rows.where(batch == k).drop("l_orderkey").write.parquet(f"{arrivals}/{k}")
    for k in range(5):
        stream = spark.readStream.schema("reference string, position long, span int").parquet(f"{arrivals}/[0-{k}]")
        frontier.start(stream, 64, target, checkpoint).awaitTermination()
    open_ones = frontier.open_chunks(spark, checkpoint).withColumn("kind", F.lit("open"))
    return frontier.told(spark, target).unionByName(open_ones).select("kind", "reference", "chunk_start", "reads", "bases")


# Binary alignment files through their offset index


@query(READS + " SELECT l_orderkey || ':' || l_linenumber || ':' || l_suppkey AS name, position, mapq, flag, span, l_linenumber AS tag FROM reads WHERE reference_id >= 0 AND reference = 'N' AND position < 140 AND position + span > 120")
def bam_region(spark, d):
    """All rows as a binary alignment file, its index, and what overlaps a region through that index."""
    rows = P.reads(spark, d).withColumns({"name": F.concat_ws(":", *TIES), "reference": F.when(F.col("reference_id") >= 0, F.col("reference")), "cigar": F.concat(F.col("span").cast("string"), F.lit("M")), "tags": F.create_map(F.lit("LN"), F.col("l_linenumber").cast("string"))})
    rows = rows.withColumns({c: F.lit(None).cast("string") for c in ("mate_reference", "sequence", "quality")} | {c: F.lit(0) for c in ("mate_position", "template_length")})
    path = _folder(spark)
    bam.write_bam(rows, "@HD\tVN:1.6\tSO:coordinate\n", [(r, 1 << 28) for r in "ANR"], f"{path}/bam")
    bam_index.write(spark, f"{path}/bam", f"{path}/index")
    found = bam_index.read_region(spark, f"{path}/index", "N:120-140")
    return found.select("name", F.col("position").cast("long").alias("position"), "mapq", "flag", "span", codecs.tag_value(F.col("tags")["LN"]).cast("int").alias("tag"))


_TAGGED = """ SELECT l_orderkey || ':' || l_linenumber || ':' || l_suppkey AS name, CAST(flag AS INT) AS flag, CASE WHEN reference_id >= 0 THEN reference ELSE '*' END AS reference, CAST(position AS INT) AS position, span || 'M' AS cigar,
    CASE WHEN l_suppkey % 2 = 0 THEN 'R' ELSE '*' END AS mate_reference, CAST(l_suppkey AS INT) AS mate_position, repeat('ACGTN', span)[1:span] AS sequence, repeat('I+5', span)[1:span] AS quality,
    'BC=Z:00' || l_linenumber || ',NM=i:' || l_linenumber || ',XA=A:q,XB=B:s,-3,' || l_linenumber || ',XF=f:1.5,XH=H:1AE3' AS tags FROM reads"""


def _tagged(spark, d):
    """Rows with sequences, qualities, mates and a tag of every type."""
    number, span = F.col("l_linenumber").cast("string"), F.col("span")
    tags = {"BC": F.concat(F.lit("Z:00"), number), "NM": F.concat(F.lit("i:"), number), "XA": F.lit("A:q"), "XB": F.concat(F.lit("B:s,-3,"), number), "XF": F.lit("f:1.5"), "XH": F.lit("H:1AE3")}
    return P.reads(spark, d).withColumns({
        "name": F.concat_ws(":", *TIES), "reference": F.when(F.col("reference_id") >= 0, F.col("reference")), "position": F.col("position").cast("int"), "cigar": F.concat(span.cast("string"), F.lit("M")),
        "mate_reference": F.when(F.col("l_suppkey") % 2 == 0, "R"), "mate_position": F.col("l_suppkey").cast("int"), "template_length": F.lit(0), "sequence": F.left(F.repeat(F.lit("ACGTN"), span), span), "quality": F.left(F.repeat(F.lit("I+5"), span), span),
        "tags": F.create_map(*(x for k, v in tags.items() for x in (F.lit(k), v))),
    })


def _untagged(rows):
    """What the tagged queries return: tags as text, in order."""
    text = F.array_join(F.transform(F.array_sort(F.map_entries("tags")), lambda t: F.concat_ws("=", t["key"], t["value"])), ",")
    return rows.select("name", "flag", F.coalesce("reference", F.lit("*")).alias("reference"), "position", "cigar", F.coalesce("mate_reference", F.lit("*")).alias("mate_reference"), "mate_position", "sequence", "quality", text.alias("tags"))


@query(READS + _TAGGED)
def bam_tags_roundtrip(spark, d):
    """Sequences, qualities, mates and tags of every type through a binary alignment file."""
    path = _folder(spark)
    bam.write_bam(_tagged(spark, d), "@HD\tVN:1.6\tSO:coordinate\n", [(r, 1 << 28) for r in "ANR"], path)
    return _untagged(bam.read_bam(spark, path))


@query(READS + _TAGGED)
def sam_tags_roundtrip(spark, d):
    """The same through lines of text."""
    path = _folder(spark)
    text_formats.format_sam(_tagged(spark, d)).write.text(path)
    return _untagged(text_formats.parse_sam(text_formats.sam_lines(spark, path)))


# Variant store


def _variant_calls(spark, d):
    return P.calls(spark, d).select(F.concat(F.lit("rs"), F.col("position").cast("string")).alias("variant_id"), "position", "sample", "dosage")


@query(CALLS + " SELECT 'rs' || position AS variant_id, position, sample, dosage FROM calls WHERE position IN (SELECT p_partkey FROM part WHERE p_size = 7)")
def variants_by_id(spark, d):
    """Calls of the variants that a table of ids names, through the id index."""
    path = _folder(spark)
    variant_store.write(_variant_calls(spark, d), path, 64)
    wanted = P.table(spark, d, "part").where("p_size = 7").select(F.concat(F.lit("rs"), F.col("p_partkey").cast("string")).alias("variant_id"))
    return variant_store.lookup(spark, path, wanted).select("variant_id", "position", "sample", "dosage")


@query(CALLS + " SELECT 'rs' || position AS variant_id, position, dosage FROM calls WHERE sample = 5 AND dosage <> 0")
def variants_of_sample(spark, d):
    """What one sample carries, from the chunks whose filters let it pass; two batches."""
    path, calls = _folder(spark), _variant_calls(spark, d)
    for k, mode in enumerate(("overwrite", "append")):
        variant_store.write(calls.where(F.col("sample") % 2 == k), path, 64, 1024, mode)
    return variant_store.of_sample(spark, path, 5).select("variant_id", "position", "dosage")


@query(CALLS + " SELECT CAST(position // 64 * 64 AS BIGINT) AS chunk_start, count(*) AS calls, count(*) FILTER (dosage <> 0) AS stored FROM calls GROUP BY ALL")
def variant_chunks(spark, d):
    """The manifest of two batches, merged."""
    path, calls = _folder(spark), _variant_calls(spark, d)
    for k, mode in enumerate(("overwrite", "append")):
        variant_store.write(calls.where(F.col("sample") % 2 == k), path, 64, 1024, mode)
    return variant_store.read_chunks(spark, path).select("chunk_start", "calls", "stored")


# Interval joins over hierarchical bins


_SPANS = """, wide AS (SELECT s_suppkey AS id, CASE s_suppkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'N' ELSE 'R' END AS ref, s_suppkey * 3 AS s, s_suppkey * 3 + CASE s_suppkey % 5 WHEN 0 THEN 1 WHEN 1 THEN 17 WHEN 2 THEN 300 WHEN 3 THEN 5000 ELSE 1000000000 END AS e FROM supplier)"""


def _wide(spark, d):
    """Intervals of very different lengths, some as long as a reference."""
    key = F.col("s_suppkey")
    length = F.when(key % 5 == 0, 1).when(key % 5 == 1, 17).when(key % 5 == 2, 300).when(key % 5 == 3, 5000).otherwise(1_000_000_000)
    reference = F.when(key % 3 == 0, "A").when(key % 3 == 1, "N").otherwise("R")
    return P.table(spark, d, "supplier").select(key.alias("id"), reference.alias("reference"), (key * 3).alias("start"), (key * 3 + length).alias("end"))


@query(READS + _SPANS + " SELECT id, count(*) AS reads, CAST(sum(least(position + span, e) - greatest(position, s)) AS BIGINT) AS bases FROM reads JOIN wide ON reference = ref AND position < e AND position + span > s WHERE reference_id >= 0 GROUP BY id")
def interval_overlaps(spark, d):
    """Reads that overlap each interval, and the bases they share with it."""
    rows = P.mapped(spark, d).select("reference", "position", (F.col("position") + F.col("span")).alias("stop"))
    met = intervals.overlap_totals(rows, _wide(spark, d), "reference", ("position", "stop"), ("start", "end"))
    return met.groupBy(F.col("right.id").alias("id")).agg(F.sum("rows").alias("reads"), F.sum("shared").alias("bases"))


@query(READS + _SPANS + " SELECT id, count(*) AS starts FROM reads JOIN wide ON reference = ref AND position >= s AND position < e WHERE reference_id >= 0 GROUP BY id")
def interval_points(spark, d):
    """Reads that start in each interval."""
    met = intervals.overlap_totals(P.mapped(spark, d).select("reference", "position"), _wide(spark, d), "reference", ("position", None), ("start", "end"))
    return met.groupBy(F.col("right.id").alias("id")).agg(F.sum("rows").alias("starts"))


@query(EVENTS + ", u AS (SELECT min(t) AS s0 FROM e), clip AS (SELECT o_orderkey AS id, o_custkey % 50 AS who, s0 + o_custkey * 97 AS s, s0 + o_custkey * 97 + CASE o_orderkey % 3 WHEN 0 THEN 60 WHEN 1 THEN 3600 ELSE 400000 END AS stop FROM orders, u) SELECT clip.id, code, count(*) AS events FROM clip JOIN e ON e.participant % 50 = who AND t >= s AND t < stop GROUP BY ALL")
def annotations_in_clips(spark, d):
    """Point annotations inside clips of any length, by group of participants."""
    events = P.annotations(spark, d).select((F.col("participant") % 50).alias("who"), "t", "code")
    first = events.agg(F.min("t")).first()[0] or 0
    key = F.col("o_orderkey") % 3
    start = F.col("o_custkey") * 97 + first
    clips = P.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 50).alias("who"), start.alias("start"), (start + F.when(key == 0, 60).when(key == 1, 3600).otherwise(400_000)).alias("stop"))
    met = intervals.overlap_join(events, clips, "who", ("t", None), ("start", "stop"))
    return met.groupBy(F.col("right.id").alias("id"), F.col("left.code").alias("code")).agg(F.count("*").alias("events"))


# Versions of a dataset


_VERSIONS = """, v AS (
    SELECT 1 AS version, * FROM reads WHERE l_linenumber % 3 = 0 UNION ALL SELECT 2, * FROM reads WHERE l_linenumber % 3 <= 1
    UNION ALL SELECT 3, * FROM reads WHERE l_linenumber % 3 <= 1
    UNION ALL SELECT 4, * FROM reads WHERE l_linenumber % 3 <= 1 AND NOT (reference_id >= 0 AND reference = 'A' AND position // 256 = 0) UNION ALL SELECT 4, * FROM reads WHERE reference_id >= 0 AND reference = 'A' AND position // 256 = 0 AND l_linenumber % 3 = 2
    UNION ALL SELECT 5, * FROM reads WHERE l_linenumber % 3 <= 1
) SELECT version, CASE WHEN reference_id < 0 THEN 'unmapped' ELSE reference END AS reference, CAST(chunk_start AS BIGINT) AS chunk_start, count(*) AS reads, CAST(sum(position) AS BIGINT) AS places FROM v GROUP BY ALL"""


@query(READS + _VERSIONS)
def read_as_of(spark, d):
    """Each version of a dataset: two appends (the second once more, as a copy), a replaced range of chunks, a rollback."""
    path, rows = _folder(spark), P.reads(spark, d)
    for k in (0, 1, 1):
        snapshots.append(rows.where(F.col("l_linenumber") % 3 == k), path, SIZE, skip_copies=True)
    other = rows.where(F.col("l_linenumber") % 3 == 2).where("reference_id >= 0 and reference = 'A'").where(F.col("position") < SIZE)
    snapshots.replace(other, path, SIZE, Region("A", 0, SIZE), base=3)
    snapshots.rollback(spark, path, 2)
    out = None
    for version in range(1, 6):
        each = snapshots.read(spark, path, version).groupBy("reference", "chunk_start").agg(F.count("*").alias("reads"), F.sum("position").alias("places")).withColumn("version", F.lit(version))
        out = each if out is None else out.unionByName(each)
    return out.select("version", "reference", "chunk_start", "reads", "places")


# Chunks as wide as the rows are dense


@query(READS + " SELECT l_orderkey, l_linenumber, l_suppkey, position, span FROM reads WHERE reference_id >= 0 AND reference = 'N' AND position < 140 AND position + span > 120")
def adaptive_region(spark, d):
    path = _folder(spark)
    adaptive.write(P.mapped(spark, d).drop("chunk_start"), path, 500)
    return adaptive.query(spark, path, "N:120-140", "overlap").select(*TIES, "position", "span")


@query(READS + " SELECT reference, count(*) AS rows, true AS even, true AS whole FROM reads WHERE reference_id >= 0 GROUP BY reference")
def adaptive_balance(spark, d):
    """Whether a reference's chunks differ by a factor of two at most, and follow one another without a gap."""
    chunks = adaptive.chunk_map(P.mapped(spark, d), 500)
    touching = F.lead("start").over(Window.partitionBy("reference").orderBy("start")) == F.col("end")
    each = chunks.withColumn("touching", F.coalesce(touching, F.lit(True)))
    return each.groupBy("reference").agg(F.sum("rows").alias("rows"), (F.max("rows") <= 2 * F.min("rows")).alias("even"), F.every("touching").alias("whole"))


# Statistics that batches leave as sketches


@query(READS + " SELECT CASE WHEN reference_id >= 0 THEN reference ELSE '*' END AS reference, count(*) AS rows, true AS samples_near, true AS median_near FROM reads GROUP BY 1")
def manifest_sketches(spark, d):
    """Three batches' sketches, merged by reference, held against the rows: distinct samples within 2 %, the median span within 2 % of the ranks."""
    rows = P.reads(spark, d).withColumn("reference", F.when(F.col("reference_id") >= 0, F.col("reference")).otherwise("*"))
    path = _folder(spark)
    for k in range(3):
        sketches.build(rows.where(F.col("l_linenumber") % 3 == k), ["reference"], ["l_suppkey"], ["span"]).write.mode("append").parquet(path)
    told = sketches.read_off(sketches.merge(spark.read.parquet(path), ["reference"]), {"span": [0.5]})
    held = rows.join(F.broadcast(told), "reference").groupBy("reference", "rows", "l_suppkey_distinct").agg(F.count_distinct("l_suppkey").alias("samples"), F.avg((F.col("span") < F.col("span_p50")).cast("int")).alias("below"), F.avg((F.col("span") <= F.col("span_p50")).cast("int")).alias("up_to"))
    near = F.abs(F.col("l_suppkey_distinct") - F.col("samples")) <= 0.02 * F.col("samples")
    return held.select("reference", "rows", near.alias("samples_near"), ((F.col("below") <= 0.52) & (F.col("up_to") >= 0.48)).alias("median_near"))


@query(READS + " SELECT reference, l_suppkey % 4 AS lane, GROUPING_ID(reference, lane) AS grouped, count(*) AS rows, count(DISTINCT position) AS position_distinct FROM reads GROUP BY GROUPING SETS ((reference), (lane), (reference, lane), ())")
def grouping_sets(spark, d):
    rows = P.reads(spark, d).withColumn("lane", F.col("l_suppkey") % 4)
    out = sketches.rolled_up(rows, [["reference"], ["lane"], ["reference", "lane"], []], ["position"])
    return out.select("reference", "lane", "grouped", "rows", "position_distinct")


# Patterns of several steps, agreement of many raters


@query(EVENTS + """, o AS (SELECT *, row_number() OVER (PARTITION BY participant ORDER BY t, id) AS n FROM e),
    nx AS (SELECT participant, n, id, t, code, min(CASE WHEN code IN ('click', 'error') THEN n END) OVER w AS to_click, min(CASE WHEN code IN ('purchase', 'error') THEN n END) OVER w AS to_purchase FROM o WINDOW w AS (PARTITION BY participant ORDER BY n ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))
    SELECT a.participant, a.id AS start_id, c.id AS end_id, a.t AS start, c.t AS "end", CAST(3 AS BIGINT) AS events FROM nx a JOIN nx b ON b.participant = a.participant AND b.n = a.to_click JOIN nx c ON c.participant = a.participant AND c.n = b.to_purchase
    WHERE a.code = 'view' AND b.code = 'click' AND c.code = 'purchase' AND b.t - a.t <= 86400 AND c.t - b.t <= 86400""")
def three_step_pattern(spark, d):
    """View, then click, then purchase, each within a day and without an error between."""
    steps = [patterns.Step("view"), patterns.Step("click"), patterns.Step("purchase")]
    return patterns.match(P.annotations(spark, d), steps, 86400, forbidden=("error",))


@query(EVENTS + """, o AS (SELECT *, row_number() OVER (PARTITION BY participant ORDER BY t, id) AS n FROM e),
    nx AS (SELECT participant, n, id, t, code, min(CASE WHEN code IN ('view', 'purchase') THEN n END) OVER w AS nxt FROM o WINDOW w AS (PARTITION BY participant ORDER BY n ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))
    , r AS (SELECT * FROM (WITH RECURSIVE walk(participant, start_id, start, n, id, t, code, events, nxt) AS (
        SELECT participant, id, t, n, id, t, code, CAST(1 AS BIGINT), nxt FROM nx WHERE code = 'view'
        UNION ALL SELECT w.participant, w.start_id, w.start, x.n, x.id, x.t, x.code, w.events + 1, x.nxt FROM walk w JOIN nx x ON x.participant = w.participant AND x.n = w.nxt WHERE w.code = 'view' AND x.t - w.t <= 43200) SELECT * FROM walk))
    SELECT participant, start_id, id AS end_id, start, t AS "end", events FROM r WHERE code = 'purchase'""")
def repeated_step_pattern(spark, d):
    """Views, as many as follow one another within half a day, and then a purchase."""
    return patterns.match(P.annotations(spark, d), [patterns.Step("view", repeat=True), patterns.Step("purchase")], 43200)


@query("""WITH r AS (SELECT l_partkey AS unit, l_linenumber AS rater, l_quantity::INT % 4 AS value FROM lineitem WHERE l_suppkey % 7 <> 0),
    c AS (SELECT unit, value, count(*) AS n FROM r GROUP BY ALL), u AS (SELECT unit, sum(n) AS m FROM c GROUP BY unit HAVING sum(n) > 1),
    p AS (SELECT x.value AS a, y.value AS b, sum(CASE WHEN x.value = y.value THEN x.n * (x.n - 1) ELSE x.n * y.n END / (m - 1)::DOUBLE) AS w FROM c x JOIN c y USING (unit) JOIN u USING (unit) GROUP BY ALL),
    t AS (SELECT a, sum(w) AS n FROM p GROUP BY a), s AS (SELECT sum(n) AS n FROM t)
    SELECT round((SELECT n FROM s), 3) AS pairable, round(1 - (SELECT sum(w) FROM p WHERE a <> b) / (SELECT n FROM s) / ((SELECT sum(x.n * y.n) FROM t x, t y WHERE x.a <> y.a) / ((SELECT n FROM s) * ((SELECT n FROM s) - 1))), 9) AS alpha""")
def raters_alpha(spark, d):
    """Line numbers as raters of parts, some ratings missing."""
    lines = P.table(spark, d, "lineitem").where("l_suppkey % 7 <> 0")
    ratings = lines.select(F.col("l_partkey").alias("unit"), (F.col("l_quantity").cast("int") % 4).alias("value"))
    return agreement.alpha(ratings).select(F.round("pairable", 3).alias("pairable"), F.round("alpha", 9).alias("alpha"))


# Points along a Z-order curve


@query("SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, l_extendedprice FROM lineitem WHERE l_partkey >= 40 AND l_partkey < 90 AND l_extendedprice >= 20000 AND l_extendedprice < 40000")
def zorder_box(spark, d):
    path = _folder(spark)
    points = P.table(spark, d, "lineitem").select(*TIES, "l_partkey", "l_extendedprice", "l_quantity")
    top = points.agg(F.max("l_partkey"), F.max("l_extendedprice"), F.max("l_quantity")).first()
    zorder.write(points, path, {c: (0, float(t or 1) + 1) for c, t in zip(("l_partkey", "l_extendedprice", "l_quantity"), top)}, bits=10)
    return zorder.in_box(spark, path, l_partkey=(40, 90), l_extendedprice=(20_000, 40_000)).drop("l_quantity")


# Vectors by cluster


@query("""WITH q AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS q FROM embeddings WHERE embedding IS NOT NULL),
    s AS (SELECT a.vec_id AS query_id, b.vec_id, list_sum(list_transform(list_zip(a.q, b.q), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS squared FROM q a JOIN q b ON a.vec_id % 50 = 0)
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY squared, vec_id)::INT AS rank, vec_id, squared FROM s QUALIFY rank <= 5""")
def cluster_search(spark, d):
    """The nearest vectors of some, exactly, by way of the clusters that can hold them."""
    path = _folder(spark)
    vectors = P.table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * 64).cast("double")).alias("embedding"))
    clusters.write(vectors, path, 16, rounds=4)
    found = clusters.search(spark, path, vectors.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id"), 5, 3, exact=True)
    return found.select("query_id", "rank", "vec_id", F.round(F.col("distance") * F.col("distance")).cast("long").alias("squared"))


# Alleles in one form


_SITES = """WITH s AS (SELECT p_partkey AS id, 10 + p_partkey * 20 AS pl, p_size % 4 AS kind FROM part)"""
#: The reference sequence of the next queries: "GATTTTTTCA" over and over, so an indel of T may be written in six places.


@query(_SITES + """ SELECT id, CASE kind WHEN 0 THEN pl + 1 WHEN 1 THEN pl + 1 WHEN 2 THEN pl + 2 ELSE pl END AS position, CASE kind WHEN 0 THEN 'AT' WHEN 1 THEN 'A' WHEN 2 THEN 'T' ELSE 'G' END AS ref, CASE kind WHEN 0 THEN 'A' WHEN 1 THEN 'AT' WHEN 2 THEN 'C' ELSE 'A' END AS alt FROM s""")
def normal_alleles(spark, d):
    """Deleted and inserted bases of a run, written at its right end or in its middle, and padded substitutions, in normal form."""
    parts = P.table(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") * 20 + 10).cast("long").alias("at"), (F.col("p_size") % 4).alias("kind"))
    offset = F.when(F.col("kind") == 0, 4 + F.col("id") % 3).when(F.col("kind") == 1, 3 + F.col("id") % 4).when(F.col("kind") == 2, 1).otherwise(0)
    ref = F.when(F.col("kind") == 0, "TT").when(F.col("kind") == 1, "T").when(F.col("kind") == 2, "ATT").otherwise("GAT")
    alt = F.when(F.col("kind") == 0, "T").when(F.col("kind") == 1, "TT").when(F.col("kind") == 2, "ACT").otherwise("AAT")
    sites = parts.select("id", F.lit("c").alias("reference"), (F.col("at") + offset).alias("position"), ref.alias("ref"), alt.alias("alt"))
    top = parts.agg(F.max("at")).first()[0] or 0
    sequence = spark.range(-(-(top + 30) // 40)).select(F.lit("c").alias("reference"), F.col("id").cast("int").alias("chunk"), F.lit("GATTTTTTCA" * 4).alias("bases"))
    return alleles.normalised(sites, sequence, 40).select("id", "position", "ref", "alt")


_MERGED = CALLS + """, b AS (SELECT position, sample, max(dosage) FILTER (sample % 2 = 0) AS g, max(dosage) FILTER (sample % 2 = 1) AS t FROM calls WHERE dosage <> 0 AND sample BETWEEN 1 AND 4 GROUP BY ALL),
    a AS (SELECT position, max(g) AS g, max(t) AS t FROM b GROUP BY position), l AS (SELECT position, CASE WHEN t IS NOT NULL THEN 'CAA' ELSE 'C' END AS ref, CASE WHEN t IS NULL THEN 'G' WHEN g IS NULL THEN 'C' ELSE 'C,GAA' END AS alts, g IS NOT NULL AND t IS NOT NULL AS two FROM a),
    w AS (SELECT position, s, coalesce(max(CASE WHEN sample = s THEN CASE WHEN g IS NOT NULL THEN ['0/1', '1/1'][g] ELSE ['0/1', '1/1'][t] END END), '0/0') AS gt, bool_or(sample = s AND g IS NOT NULL) AS is_g FROM b, range(1, 5) r(s) GROUP BY ALL)
    SELECT 'ref' || position % 3 || chr(9) || concat_ws(chr(9), position + 1, '.', ref, alts, '.', 'PASS', '.', 'GT', (SELECT string_agg(CASE WHEN two AND is_g THEN replace(gt, '1', '2') ELSE gt END, chr(9) ORDER BY s) FROM w WHERE w.position = l.position)) AS value FROM l"""


@query(_MERGED)
def vcf_alleles(spark, d):
    """Calls of two sets of samples, of a substitution and of a deletion at the same places, merged into sites of several alternatives and written with their own references and alleles."""
    calls = P.calls(spark, d).where("dosage <> 0 and sample between 1 and 4").groupBy("position", "sample").agg(F.max("dosage").alias("dosage"))
    even = F.col("sample") % 2 == 0
    genotype = F.when(F.col("dosage") == 1, "0/1").otherwise("1/1")
    rows = calls.select(F.concat(F.lit("ref"), (F.col("position") % 3).cast("string")).alias("reference"), "position", F.when(even, "C").otherwise("CAA").alias("ref"), F.when(even, "G").otherwise("C").alias("alt"), F.col("sample").cast("string").alias("sample"), genotype.alias("genotype"))
    return alleles.vcf_lines(alleles.merge(rows), ["1", "2", "3", "4"]).select("value")


# Sizes of what is stored, first lines


@query(READS + """, c AS (SELECT DISTINCT CASE WHEN reference_id >= 0 THEN reference END, chunk_start FROM reads)
    SELECT (SELECT count(*) FROM c) AS chunks, CAST(sum(length(reference_id || '') + length(position || '') + length(span || '') + length(mapq || '') + length(flag || '') + length(l_orderkey || '') + length(l_linenumber || '') + length(l_suppkey || '') + 8) AS BIGINT) AS plain_bytes, true AS smaller, true AS ordered FROM reads""")
def stored_compression(spark, d):
    """Chunks, bytes of the rows as text, and whether the files are smaller than that, chunk sizes being in order."""
    path = _folder(spark)
    dataset.write(P.reads(spark, d), path, SIZE * 64)
    out = dataset.compression(spark, path)
    chunks = P.reads(spark, d).select(F.when(F.col("reference_id") >= 0, F.col("reference")), "chunk_start").distinct().count()
    return out.select(F.lit(chunks).cast("long").alias("chunks"), "plain_bytes", (F.col("ratio") > 1).alias("smaller"), ((F.col("least") <= F.col("mean")) & (F.col("mean") <= F.col("most"))).alias("ordered"))


@query("SELECT * FROM (SELECT concat_ws(chr(9), p_partkey, p_name) AS value FROM part ORDER BY p_partkey LIMIT 7)")
def first_lines(spark, d):
    """The first lines of a text file; the limit is the feature."""
    path = _folder(spark)
    P.table(spark, d, "part").orderBy("p_partkey").select(F.concat_ws("\t", "p_partkey", "p_name").alias("value")).coalesce(1).write.text(path)
    return text_formats.first_lines(spark.read.text(path), 7)


# Annotations as other tools' documents

_DOCS = EVENTS + ", n AS (SELECT participant AS recording, code AS tier, id, t, row_number() OVER (PARTITION BY participant ORDER BY code, t, id) AS n FROM e)"


@query(_DOCS + """, t AS (SELECT recording, tier, min(n) AS first, string_agg('<TIME_SLOT TIME_SLOT_ID="ts' || (2 * n - 1) || '" TIME_VALUE="' || t * 1000 || '"/><TIME_SLOT TIME_SLOT_ID="ts' || 2 * n || '" TIME_VALUE="' || (t + 2) * 1000 || '"/>', '' ORDER BY n) AS slots,
        string_agg('<ANNOTATION><ALIGNABLE_ANNOTATION ANNOTATION_ID="a' || n || '" TIME_SLOT_REF1="ts' || (2 * n - 1) || '" TIME_SLOT_REF2="ts' || 2 * n || '"><ANNOTATION_VALUE>&lt;' || id || '&gt;</ANNOTATION_VALUE></ALIGNABLE_ANNOTATION></ANNOTATION>', '' ORDER BY n) AS els FROM n GROUP BY ALL)
    SELECT recording, '<?xml version="1.0" encoding="UTF-8"?><ANNOTATION_DOCUMENT AUTHOR="" DATE="1970-01-01T00:00:00+00:00" FORMAT="3.0" VERSION="3.0"><HEADER MEDIA_FILE="" TIME_UNITS="milliseconds"/><TIME_ORDER>' || string_agg(slots, '' ORDER BY first) || '</TIME_ORDER>' ||
        string_agg('<TIER LINGUISTIC_TYPE_REF="default-lt" TIER_ID="' || tier || '">' || els || '</TIER>', '' ORDER BY first) || '<LINGUISTIC_TYPE GRAPHIC_REFERENCES="false" LINGUISTIC_TYPE_ID="default-lt" TIME_ALIGNABLE="true"/></ANNOTATION_DOCUMENT>' AS xml FROM t GROUP BY recording""")
def annotations_as_eaf(spark, d):
    return sidecars.eaf_documents(_recorded(spark, d))


@query(_DOCS + """, t AS (SELECT recording, tier, min(n) AS first, string_agg('<el index="' || k || '" start="' || t || '.000" end="' || (t + 2) || '.000"><attribute name="code">&lt;' || id || '&gt;</attribute></el>', '' ORDER BY n) AS els FROM (SELECT *, n - min(n) OVER (PARTITION BY recording, tier) AS k FROM n) GROUP BY ALL)
    SELECT recording, '<?xml version="1.0" encoding="UTF-8"?><annotation><head/><body>' || string_agg('<track name="' || tier || '" type="primary">' || els || '</track>', '' ORDER BY first) || '</body></annotation>' AS xml FROM t GROUP BY recording""")
def annotations_as_anvil(spark, d):
    return sidecars.anvil_documents(_recorded(spark, d))


def _recorded(spark, d):
    """Events as annotations of two seconds: participants as recordings, codes as tiers."""
    start = F.col("t").cast("double")
    return P.annotations(spark, d).select(F.col("participant").alias("recording"), F.col("code").alias("tier"), "id", start.alias("start_time"), (start + 2).alias("end_time"), F.concat(F.lit("<"), F.col("id").cast("string"), F.lit(">")).alias("code"))


# Streams over files that arrive, and older datasets


def _sam(spark, d):
    rows = P.reads(spark, d).withColumns({"name": F.concat_ws(":", *TIES), "reference": F.when(F.col("reference_id") >= 0, F.col("reference")), "cigar": F.concat(F.col("span").cast("string"), F.lit("M")), "tags": F.create_map(F.lit("LN"), F.col("l_linenumber").cast("string"))})
    return rows.withColumns({c: F.lit(None).cast("string") for c in ("mate_reference", "sequence", "quality")} | {c: F.lit(0) for c in ("mate_position", "template_length")})


@query(READS + " SELECT l_orderkey || ':' || l_linenumber || ':' || l_suppkey AS name, CASE WHEN reference_id < 0 THEN 'unmapped' ELSE reference END AS reference, CAST(position AS INT) AS position, span FROM reads")
def ingest_stream(spark, d):
    """Lines of alignments that arrive in three lots, the last one with rows of every place, taken in by a stream that is stopped and started again between them."""
    rows, source, target, checkpoint = _sam(spark, d), *(_folder(spark) for _ in range(3))
    references = spark.createDataFrame([(k, r) for k, r in enumerate("ANR")], "reference_id int, reference string")
    for k in range(3):
        lot = F.when(F.col("l_linenumber") % 5 == 0, 2).otherwise(F.col("position") % 2)
        text_formats.format_sam(rows.where(lot == k)).write.text(f"{source}/{k}")
        ingest.ingest_sam(spark, f"{source}/*", target, references, SIZE, checkpoint).awaitTermination()
    return dataset.read(spark, target).select("name", "reference", "position", "span")


@query(READS + " SELECT l_orderkey || ':' || l_linenumber || ':' || l_suppkey AS name, CASE WHEN reference_id < 0 THEN 'unmapped' ELSE reference END AS reference, CASE WHEN reference_id < 0 THEN 0 ELSE position // 512 * 512 END AS chunk_start, position FROM reads")
def upgraded_dataset(spark, d):
    """Older JSON chunk files as a dataset of the present format."""
    path, target = _folder(spark), _folder(spark)
    rows = P.reads(spark, d)
    chunks = max(8, P.table(spark, d, "lineitem").count() // 2000)
    record = F.struct(F.concat_ws(":", *TIES).alias("name"), "flag", F.col("reference_id").alias("ref"), F.col("position").alias("pos"), "mapq", F.concat(F.col("span").cast("string"), F.lit("M")).alias("cigar"), F.lit("").alias("seq"), F.lit("").alias("qual"))
    rows.groupBy(F.col("l_orderkey") % chunks).agg(F.to_json(F.collect_list(record)).alias("value")).select("value").write.option("maxRecordsPerFile", 1).text(path)
    references = spark.createDataFrame([(k, r) for k, r in enumerate("ANR")], "reference_id int, reference string")
    dataset.upgrade(spark, path, references, target, 512, "part-*")
    return dataset.read(spark, target).select("name", "reference", "chunk_start", F.col("position").cast("long").alias("position"))


@query("SELECT event_id, user_id, event_type FROM events")
def stream_dedup(spark, d):
    """Events that arrive twice, the second time in another file, each told once."""
    events, source, target, checkpoint = P.table(spark, d, "events"), *(_folder(spark) for _ in range(3))
    for k in range(2):
        events.coalesce(1).write.parquet(f"{source}/{k}")
        arriving = spark.readStream.schema(events.schema).parquet(f"{source}/[0-{k}]")
        once = ingest.deduplicated(arriving, ["event_id"]).select("event_id", "user_id", "event_type")
        once.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(target)


@query(EVENTS + " SELECT a.id AS left_id, b.id AS right_id FROM e a JOIN e b ON a.participant = b.participant AND a.code = 'view' AND b.code = 'purchase' AND b.t >= a.t AND b.t <= a.t + 7200")
def stream_pairs(spark, d):
    """Two streams of the same events joined: purchases within two hours after a view."""
    events, source, target, checkpoint = P.table(spark, d, "events"), *(_folder(spark) for _ in range(3))
    # Bounds are in whole seconds, as the annotations' are.
    events.withColumn("ts", F.timestamp_seconds(F.unix_timestamp(F.col("ts").cast("timestamp")))).write.parquet(source)
    schema = spark.read.parquet(source).schema
    views, purchases = (spark.readStream.schema(schema).parquet(source).where(F.col("event_type") == c) for c in ("view", "purchase"))
    met = ingest.paired(views, purchases, "user_id", "2 hours").select("left_id", "right_id")
    met.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(target)
