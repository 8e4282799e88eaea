"""A training-data pipeline over the documents table: each stage applies one operator to all that its predecessor kept."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locus.llm import decontaminate, pieces, pii, quality, simjoin, vocabulary
from locus.sources.shared import shared_dir

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def aside(docs: DataFrame, *names: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs without columns of those names (in any letter case), which a stage's operator uses for itself: they go under other names, and what is returned puts them back."""
    taken, other = {n.lower() for n in names}, {}
    for c in docs.columns:
        if c.lower() in taken:
            other[c] = f"{c}_{uuid.uuid4().hex}"
    columns = docs.columns
    return docs.withColumnsRenamed(other), lambda out: out.withColumnsRenamed({v: k for k, v in other.items()}).select(*columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; columns named like its results keep their own values."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    docs, back = aside(docs, "score", "predicted")
    return back(quality.score(docs, model).where("predicted = 1").drop("score", "predicted"))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one document stays, that with the smallest id (without ids, or of several with that id: with the smallest text hash); texts without words are in no group and go only as repeated rows."""
    docs, back = aside(docs, "text_key", "first_id", "first_key")
    text_key = F.xxhash64("text")
    classes = simjoin.jaccard_classes(docs.select("doc_id", "text", text_key.alias("text_key")), keep=("text_key",))
    # A row is known by its id and its text's hash: an id may name rows of several classes, or be missing.
    wordless = F.when(F.col("class").isNull(), F.col("text_key")).alias("wordless")
    firsts = classes.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("class", "doc_id", wordless).agg(F.min("text_key").alias("first_key"), F.count("*").alias("count"))
    first = firsts.select(F.col("doc_id").alias("first_id"), "first_key")
    kept = docs.join(first, F.col("doc_id").eqNullSafe(F.col("first_id")) & (text_key == F.col("first_key")), "left_semi")
    # Ids that name several rows are rare; only then are whole rows compared.
    return back(kept.dropDuplicates(["doc_id", "text"]) if firsts.where("count > 1").limit(1).count() else kept)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by placeholders, and n_chars follows the text."""
    masked = pii.mask(docs)
    return masked.withColumn("n_chars", F.length("text").cast(masked.schema["n_chars"].dataType)) if "n_chars" in masked.columns else masked


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and whether they decode to its text; a column of the corpus named like one of these results is returned as source_<name>."""
    results = ("ids", "n_tokens", "round_trip", "text_sha256")
    docs = docs.withColumnsRenamed({c: f"source_{c}" for c in docs.columns if c.lower() in results})
    decoded = pieces.there_and_back(docs.withColumn("text_sha256", F.sha2("text", 256)), vocabulary.load())
    exact = F.sha2("text", 256).eqNullSafe(F.col("text_sha256"))
    return decoded.select(*(c for c in docs.columns if c != "text"), "ids", F.coalesce(F.size("ids"), F.lit(0)).alias("n_tokens"), exact.alias("round_trip"))


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality_stage),
    ("ngram_jaccard_join", dedup_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("sentencepiece", encoding_stage),
]

#: No SQL expresses the learned classifier or the encoder; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another, each written to the shared folder as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        out.write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{k}-{name}")
    raise ValueError("no stages")
