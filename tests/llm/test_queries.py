"""The registered queries and the pipeline over the smallest tables."""

import hashlib
import os
import re

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from locus.llm import chat, decontaminate, pii, quality, queries, simjoin, vocabulary
from tests.llm.test_operators import brute_classes, brute_weight, shingles

FOLDER = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_ngram_join": "doc_id n_shingles component_id",
    "op2_token_counts": "doc_id n_pretokens n_tokens",
    "op3_pii": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
    "op5_topk_search": "query_id rank vec_id score",
    "op6_chat_formatting": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars",
    "op8_substring_dedup": "doc_id n_words n_removed kept_sha256",
    "op9_sharding": "doc_id size text_crc32 law shard slot grown_shard",
    "op10_quality_classifier": "doc_id held_out score predicted",
    "op11_hard_negatives": "anchor_id positive_id rank negative_id positive_score negative_score",
    "op12_phrases": "lang rank phrase a l r n score",
    "op13_url_filters": "page_id host path rule verdict",
}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{FOLDER}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_matches_oracle(spark, duck, name):
    ours, theirs = queries.QUERIES[name](spark, FOLDER).toPandas(), duck.sql(queries.ORACLE_SQL[name]).df()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    ours, theirs = (x[columns].sort_values(columns).reset_index(drop=True) for x in (ours, theirs))
    assert len(ours) == len(theirs) > 0 and ((ours == theirs) | (ours.isna() & theirs.isna())).all().all()


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_contract_columns(spark, name):
    out = queries.QUERIES[name](spark, FOLDER)
    assert set(COLUMNS[name].split()) <= set(out.columns)
    if out.columns[0] == "doc_id":
        assert out.count() == spark.read.parquet(f"{FOLDER}/documents.parquet").count()


def test_probe_conversation(spark):
    probe = queries.op6_chat_formatting(spark, FOLDER).where("conv_id = -7").first()
    text = "\\### Assistant: </turn> ok"
    assert probe.n_turns == 2 and probe.loss_chars == len(text)
    assert probe.turns_sha256 == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
    assert probe.loss_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_round_trips_are_exact(spark):
    assert queries.op7_sentencepiece(spark, FOLDER).where("not round_trip").count() == 0


@pytest.mark.parametrize("name, build", [("op4_decontamination", lambda s: decontaminate.contained(*(s.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "benchmark")))), ("op6_chat_formatting", lambda s: chat.format_conversations(s.read.parquet(f"{FOLDER}/conversations.parquet")))])
def test_native_plans_hold_no_python(spark, name, build):
    plan = build(spark)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_pipeline(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_classifier", "ngram_jaccard_join", "benchmark_decontamination", "pii", "sentencepiece"]
    docs, columns = spark.read.parquet(f"{FOLDER}/documents.parquet"), None
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["quality_classifier"](spark, docs, FOLDER).cache()
    low = spark.read.parquet(f"{FOLDER}/labels.parquet").where("quality = 0").select("doc_id")
    assert kept.columns == columns and 0 < kept.join(low, "doc_id").count() * 3 < low.count() + 3
    firsts = stages["ngram_jaccard_join"](spark, kept, FOLDER).cache()
    classes = simjoin.jaccard_classes(kept).select("component_id").distinct().count()
    assert firsts.columns == columns and firsts.count() == classes < kept.count()
    clean = stages["benchmark_decontamination"](spark, firsts, FOLDER).cache()
    dirty = {r.doc_id for r in decontaminate.contained(firsts, spark.read.parquet(f"{FOLDER}/benchmark.parquet")).collect()}
    assert clean.columns == columns and {r.doc_id for r in clean.select("doc_id").collect()} == {r.doc_id for r in firsts.select("doc_id").collect()} - dirty
    masked = stages["pii"](spark, clean, FOLDER).cache()
    assert masked.columns == columns and masked.schema == clean.schema
    assert {r.doc_id: r.text for r in masked.collect()} == {r.doc_id: pii.mask_text(r.text) for r in clean.collect()}
    assert masked.where(F.length("text") != F.col("n_chars")).count() == 0
    coded = stages["sentencepiece"](spark, masked, FOLDER)
    assert coded.where("round_trip").count() == masked.count()
    assert corpus_pipeline.run(spark, FOLDER).count() == masked.count()


def test_pipeline_against_brute_force(spark):
    rows = {r.doc_id: r for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    model = quality.train(spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet"))
    scores = dict(zip(rows, model.score(quality.features(pa.array([r.text for r in rows.values()]))), strict=True))
    texts = {k: r.text for k, r in rows.items() if scores[k] >= 0.3}
    first = {k for k, (_, c) in brute_classes(texts).items() if c == k}
    items = [shingles(r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    clean = {k for k in first if not any(len(i) and len(next(iter(i))) == 5 and 4 * len(i & shingles(texts[k])) >= 3 * len(i) for i in items)}
    assert all(len(next(iter(i))) == 5 for i in items if i)
    vocab = vocabulary.load()
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, FOLDER).collect()}
    assert set(got) == clean and all(r.round_trip for r in got.values())
    for k in sorted(clean)[::9]:
        masked = pii.mask_text(texts[k])
        assert got[k].ids == [i for c in re.findall(" *[^ ]+| +", masked) for i in brute_weight(vocab, c)[1]]
        assert got[k].n_tokens == len(got[k].ids) and got[k].n_chars == len(masked)


def test_pipeline_of_empty_tables_and_of_nulls(spark, tmp_path):
    for name, rows in (("none", []), ("odd", [(None, None), (None, "a b c d e f"), (1, None), (1, ""), (2, " \n"), (2, "q" * 30_000), (3, "one"), (3, "one")])):
        folder = str(tmp_path / name)
        spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as score", "1 as row", "'en' as lang", "0L as n_chars").write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        got = corpus_pipeline.run(spark, folder).collect()
        assert sorted(str((r.doc_id, r.n_tokens > 0)) for r in got) == sorted(str((k, bool(t))) for k, t in set(rows)) and all(r.round_trip for r in got)


def test_dedup_stage_with_repeated_rows_and_ids(spark):
    long = " ".join(f"w{k}" for k in range(30))
    rows = [(5, long, "x"), (5, long, "x"), (6, long + " more", "x"), (7, None, "x"), (7, None, "x"), (None, long, "x"), (8, "", "x"), (9, "only this", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    got = sorted((r.doc_id, r.text) for r in corpus_pipeline.dedup_stage(spark, docs, FOLDER).select("doc_id", F.coalesce("text", F.lit("-")).alias("text")).collect())
    assert got == [(5, long), (7, "-"), (8, ""), (9, "only this")]


def test_dedup_stage_judges_rows_without_ids_or_with_repeated_ids(spark):
    one, two, three = (" ".join(f"{c}{k}" for k in range(40)) for c in "abc")
    rows = [(3, one), (5, two), (5, one + " more"), (None, one + " end"), (None, three), (None, three + " more"), (None, three), (None, ""), (None, None), (None, None), (6, two + " x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.text) for r in corpus_pipeline.dedup_stage(spark, docs, FOLDER).collect()]
    alone = [r for r in got if r[0] is None and r[1]]
    assert len(alone) == 1 and alone[0][1].startswith(three)
    assert sorted(map(str, set(got) - set(alone))) == sorted(map(str, [(3, one), (5, two), (None, ""), (None, None)])) and len(got) == 5


def test_registered():
    names = set(__spark_entry__.queries())
    assert set(queries.QUERIES) | {"pipeline"} <= names and len([n for n in names if re.match(r"op\d+_", n)]) == 13
