"""Sidecar files of recordings: transcripts and annotation tiers as JSON, and exports of annotations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TRANSCRIPT = "utterances array<struct<id:string,speaker:string,start_time:double,end_time:double,text:string,confidence:double,words:array<struct<word:string,start_time:double,end_time:double,confidence:double>>>>"
TIER = (
    "tier string, annotations array<struct<id:string,time:double,start_time:double,end_time:double,code:string,participant:string,participants:array<string>,metadata:map<string,string>>>"
)


def _documents(spark: SparkSession, path: str, schema: str, lines: bool) -> DataFrame:
    """One row a document: a file is one (or an array of them), or with lines has one in each line, and is read in splits; compressed files are read as far as the cluster has Hadoop's codec for their suffix."""
    return spark.read.schema(schema).option("multiLine", not lines).option("recursiveFileLookup", True).json(path).withColumn("file", F.col("_metadata.file_path"))


def read_utterances(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """file, id, speaker, start_time, end_time, text, confidence."""
    return _documents(spark, path, TRANSCRIPT, lines).select("file", F.explode("utterances").alias("u")).select("file", "u.id", "u.speaker", "u.start_time", "u.end_time", "u.text", "u.confidence")


def read_words(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """file, utterance_id, place (from 0), word, start_time, end_time, confidence."""
    spoken = _documents(spark, path, TRANSCRIPT, lines).select("file", F.explode("utterances").alias("u"))
    return spoken.select("file", F.col("u.id").alias("utterance_id"), F.posexplode("u.words").alias("place", "w")).select("file", "utterance_id", "place", "w.*")


def read_tiers(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """file, tier, id, start_time, end_time (equal for point annotations), code, participants (array), metadata."""
    rows = _documents(spark, path, TIER, lines).select("file", "tier", F.explode("annotations").alias("a"))
    start = F.coalesce("a.start_time", "a.time")
    who = F.coalesce("a.participants", F.when(F.col("a.participant").isNotNull(), F.array("a.participant")))
    return rows.select("file", "tier", "a.id", start.alias("start_time"), F.coalesce("a.end_time", start).alias("end_time"), "a.code", who.alias("participants"), "a.metadata")


def annotation_table(annotations: DataFrame) -> DataFrame:
    """Annotations as flat columns of text: participants joined by ";", metadata as JSON."""
    return annotations.select("tier", "id", "start_time", "end_time", "code", F.array_join("participants", ";").alias("participants"), F.to_json("metadata").alias("metadata"))


def write_csv(annotations: DataFrame, path: str) -> None:
    annotation_table(annotations).write.mode("overwrite").csv(path, header=True)


def write_json(annotations: DataFrame, path: str) -> None:
    """JSON lines, one an annotation."""
    annotations.drop("file").write.mode("overwrite").json(path)


def write_xml(annotations: DataFrame, path: str, row_tag: str = "ANNOTATION") -> None:
    """XML elements, one an annotation, for annotation tools that import such files."""
    annotation_table(annotations).write.mode("overwrite").option("rowTag", row_tag).option("rootTag", "ANNOTATIONS").format("xml").save(path)


def _xml(text: Column) -> Column:
    """A text as XML content or attribute."""
    for raw, code in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(raw), F.lit(code))
    return F.coalesce(text, F.lit(""))


def _joined(pieces: Column) -> Column:
    """The pieces (number, text) in order, one after the other."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(pieces)), lambda p: p["text"]), "")


def _numbered(annotations: DataFrame) -> DataFrame:
    """recording, tier, n (from 1 in the recording, by tier, start, end and id), start, end (milliseconds), code."""
    order = Window.partitionBy("recording").orderBy("tier", "start_time", "end_time", "id")
    milliseconds = [F.round(F.col(c) * 1000).cast("long").alias(c.split("_")[0]) for c in ("start_time", "end_time")]
    return annotations.select("recording", F.coalesce("tier", F.lit("")).alias("tier"), "id", "start_time", F.coalesce("end_time", "start_time").alias("end_time"), "code").withColumn("n", F.row_number().over(order)).select("recording", "tier", "n", *milliseconds, "code")


def eaf_documents(annotations: DataFrame) -> DataFrame:
    """recording, xml: a time-aligned annotation document of each recording, as ELAN reads them: two time slots an annotation, a tier for each tier.

    annotations: recording, tier, id, start_time, end_time (null: a point), code.  A document holds one recording's annotations.
    """
    rows = _numbered(annotations)
    slot = lambda k, value: F.concat(F.lit('<TIME_SLOT TIME_SLOT_ID="ts'), (F.col("n") * 2 - 1 + k).cast("string"), F.lit('" TIME_VALUE="'), F.col(value).cast("string"), F.lit('"/>'))
    number = (F.col("n") * 2).cast("string")
    element = F.concat(
        F.lit('<ANNOTATION><ALIGNABLE_ANNOTATION ANNOTATION_ID="a'), F.col("n").cast("string"), F.lit('" TIME_SLOT_REF1="ts'), (F.col("n") * 2 - 1).cast("string"), F.lit('" TIME_SLOT_REF2="ts'), number, F.lit('"><ANNOTATION_VALUE>'), _xml(F.col("code")),
        F.lit("</ANNOTATION_VALUE></ALIGNABLE_ANNOTATION></ANNOTATION>"),
    )
    tiers = rows.groupBy("recording", "tier").agg(
        F.min("n").alias("first"), _joined(F.struct("n", F.concat(slot(0, "start"), slot(1, "end")).alias("text"))).alias("slots"), _joined(F.struct("n", element.alias("text"))).alias("elements")
    )
    tier = F.concat(F.lit('<TIER LINGUISTIC_TYPE_REF="default-lt" TIER_ID="'), _xml(F.col("tier")), F.lit('">'), F.col("elements"), F.lit("</TIER>"))
    whole = tiers.groupBy("recording").agg(_joined(F.struct("first", F.col("slots").alias("text"))).alias("slots"), _joined(F.struct("first", tier.alias("text"))).alias("tiers"))
    head = '<?xml version="1.0" encoding="UTF-8"?><ANNOTATION_DOCUMENT AUTHOR="" DATE="1970-01-01T00:00:00+00:00" FORMAT="3.0" VERSION="3.0"><HEADER MEDIA_FILE="" TIME_UNITS="milliseconds"/><TIME_ORDER>'
    tail = '<LINGUISTIC_TYPE GRAPHIC_REFERENCES="false" LINGUISTIC_TYPE_ID="default-lt" TIME_ALIGNABLE="true"/></ANNOTATION_DOCUMENT>'
    return whole.select("recording", F.concat(F.lit(head), "slots", F.lit("</TIME_ORDER>"), "tiers", F.lit(tail)).alias("xml"))


def anvil_documents(annotations: DataFrame) -> DataFrame:
    """recording, xml: the same as tracks of elements with start and end in seconds, as Anvil reads them."""
    rows = _numbered(annotations)
    seconds = lambda c: F.format_string("%d.%03d", F.expr(f"{c} div 1000"), F.expr(f"{c} % 1000"))
    place = (F.col("n") - F.min("n").over(Window.partitionBy("recording", "tier"))).cast("string")
    element = F.concat(F.lit('<el index="'), place, F.lit('" start="'), seconds("start"), F.lit('" end="'), seconds("end"), F.lit('"><attribute name="code">'), _xml(F.col("code")), F.lit("</attribute></el>"))
    tracks = rows.withColumn("element", element).groupBy("recording", "tier").agg(F.min("n").alias("first"), _joined(F.struct("n", F.col("element").alias("text"))).alias("elements"))
    track = F.concat(F.lit('<track name="'), _xml(F.col("tier")), F.lit('" type="primary">'), F.col("elements"), F.lit("</track>"))
    whole = tracks.groupBy("recording").agg(_joined(F.struct("first", track.alias("text"))).alias("tracks"))
    return whole.select("recording", F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?><annotation><head/><body>'), "tracks", F.lit("</body></annotation>")).alias("xml"))


def write_documents(documents: DataFrame, path: str) -> None:
    """xml as one file for each recording, in a folder named after it."""
    documents.write.mode("overwrite").partitionBy("recording").text(path)
