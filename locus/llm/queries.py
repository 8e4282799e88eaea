"""The numbered queries of this subpackage: thin forms of its operators over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locus.llm import chat, decontaminate, negatives, phrases, pieces, pii, quality, sharding, simjoin, substrings, tokencount, topk, urlfilter, vocabulary


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model, carry=["doc_id"]).select("doc_id", quality.held_out().alias("held_out"), "score", "predicted")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simjoin.jaccard_classes(table(spark, sf_dir, "documents").select("doc_id", "text"), links=True)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokencount.count_tokens(docs, vocabulary.load(), carry=["doc_id"])


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.detect(table(spark, sf_dir, "documents").select("doc_id", "text"), carry=["doc_id"])
    return found.withColumn("base_sha256", F.sha2("base_spans", 256)).select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"
    )


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP4_SQL = r"""
WITH split AS (
    SELECT 'd' AS kind, doc_id AS id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
    UNION ALL
    SELECT 'i', item_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') FROM benchmark
), item AS (
    SELECT DISTINCT id AS item_id, least(len(w), 5) AS width, unnest(list_transform(range(1, greatest(len(w) - 5, 0) + 2), lambda i: array_to_string(w[i:i + 4], ' '))) AS shingle
    FROM split WHERE kind = 'i' AND len(w) > 0
), doc AS (
    SELECT DISTINCT id AS doc_id, width, unnest(list_transform(range(1, len(w) - width + 2), lambda i: array_to_string(w[i:i + width - 1], ' '))) AS shingle
    FROM split, (SELECT DISTINCT width FROM item) WHERE kind = 'd' AND len(w) >= width
), size AS (SELECT item_id, count(*) AS n_item FROM item GROUP BY item_id)
SELECT doc_id, item_id, count(*) AS n_shared, n_item, count(*)::DOUBLE / n_item AS containment
FROM doc JOIN item USING (width, shingle) JOIN size USING (item_id)
GROUP BY doc_id, item_id, n_item HAVING count(*) >= 0.75 * n_item
"""


def op5_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.top_k(vectors, vectors.where(F.col("vec_id") % 20 == 0), k=20).select("query_id", "rank", "vec_id", "score")


OP5_SQL = """
WITH q AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS q FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT a.vec_id AS query_id, b.vec_id, list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2]))::BIGINT AS score
    FROM q a JOIN q b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


PROBE = "\\### Assistant: </turn> ok"


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(PROBE).alias("text"),
    )
    read = chat.read_back(chat.format_conversations(turns.unionByName(probe)))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        "formatted_chars",
    )


OP6_SQL = r"""
WITH rows AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
    UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), escaped AS (
    SELECT *,
        length(replace(replace(replace(replace(replace(text, '\', '\0'), '### ', '\1'), '</turn>', '\2'), '<+>', '\3'), ': ', '\4')) AS text_chars,
        length(replace(replace(replace(replace(replace(role, '\', '\0'), '### ', '\1'), '</turn>', '\2'), '<+>', '\3'), ': ', '\4')) AS role_chars,
        lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before
    FROM rows
)
SELECT conv_id,
    count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    (8 + sum(text_chars + CASE WHEN before IS NULL THEN 6 + role_chars WHEN before = role THEN 3 ELSE 14 + role_chars END))::BIGINT AS formatted_chars
FROM escaped GROUP BY conv_id
"""


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.sha2("text", 256).alias("text_sha256"))
    back = pieces.there_and_back(docs, vocabulary.load())
    return back.select(
        "doc_id",
        F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_tokens"),
        F.xxhash64("ids").alias("ids_hash"),
        F.sha2("text", 256).alias("decoded_sha256"),
        F.sha2("text", 256).eqNullSafe(F.col("text_sha256")).alias("round_trip"),
    )


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substrings.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), size=20)
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_by_bytes(table(spark, sf_dir, "documents").select("doc_id", "text"), shards=8)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(vectors, F.col("vec_id") % 100 == 0, scale=256, label=label)


OP11_SQL = """
WITH q AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS alike, list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2]))::BIGINT AS score
    FROM q a JOIN q b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
r AS (
    SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
    FROM p JOIN s USING (anchor_id) WHERE NOT alike AND 100 * score BETWEEN 30 * positive_score AND 90 * positive_score
)
SELECT * FROM r WHERE rank <= 10
"""


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH piece AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), split AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') AS w FROM piece),
gram AS (
    SELECT lang, 1 AS size, unnest(w) AS phrase FROM split
    UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM split
    UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM split
), f AS (SELECT lang, size, phrase, count(*) AS f FROM gram GROUP BY ALL HAVING count(*) >= 10),
total AS (SELECT lang, count(*) AS n FROM gram WHERE size = 1 GROUP BY lang),
cut AS (
    SELECT lang, phrase, f AS a, size, k, array_to_string(string_split(phrase, ' ')[:k], ' ') AS one, array_to_string(string_split(phrase, ' ')[k + 1:], ' ') AS two FROM f, (VALUES (1), (2)) v(k) WHERE k < size
), score AS (
    SELECT cut.lang, cut.phrase, a, x.f AS l, y.f AS r, k, (1000000 * a::HUGEINT * a // (x.f::HUGEINT * y.f))::BIGINT AS score
    FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = one JOIN f y ON y.lang = cut.lang AND y.phrase = two
), best AS (SELECT * FROM score QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
outside AS (SELECT lang, unnest([array_to_string(string_split(phrase, ' ')[:2], ' '), array_to_string(string_split(phrase, ' ')[2:], ' ')]) AS phrase, f FROM f WHERE size = 3),
most AS (SELECT lang, phrase, max(f) AS f FROM outside GROUP BY ALL),
kept AS (SELECT best.* FROM best LEFT JOIN most USING (lang, phrase) WHERE most.f IS NULL OR 100 * most.f < 50 * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept)
SELECT lang, rank::INT AS rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""


URL_RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))


def op13_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urlfilter.judge(table(spark, sf_dir, "pages").select("page_id", "url", "html"), rules, carry=("page_id",))


OP13_SQL = r"""
WITH RECURSIVE rules(rule_host, rule_path, rule_verdict) AS (
    VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), tags AS (
    SELECT url, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\s[^<>]*>')) AS tag FROM pages WHERE url IS NOT NULL
), found AS (
    SELECT url, CASE WHEN regexp_matches(tag, '(?is)^<link.*\brel\s*=\s*["'']?\s*canonical\b') THEN regexp_extract(tag, '(?is)\bhref\s*=\s*["'']?\s*([^"''\s>]+)', 1)
        WHEN regexp_matches(tag, '(?is)^<meta.*\bhttp-equiv\s*=\s*["'']?\s*refresh\b') THEN regexp_extract(tag, '(?is)\burl\s*=\s*["'']?\s*([^"''\s>]+)', 1) END AS link FROM tags
), seen AS (
    SELECT url, replace(link, '&amp;', '&') AS link, regexp_extract(url, '^(?s:.*?)://', 0) AS scheme, regexp_extract(url, '^((?s:.*?)://[^/?#]*)', 1) AS site, regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path FROM found WHERE link <> ''
), edge AS (
    SELECT url AS a, CASE WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN link WHEN link LIKE '//%' THEN replace(scheme, '//', '') || link WHEN link LIKE '/%' THEN site || link
        WHEN link LIKE '?%' THEN site || path || link WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL ELSE site || CASE WHEN path = '' THEN '/' ELSE regexp_extract(path, '^((?s:.*)/)', 1) END || link END AS b FROM seen
), noded AS (
    SELECT lower(regexp_extract(a, '^((?s:.*?)://[^/?#]*)', 1)) || regexp_extract(a, '^(?s:.*?)://[^/?#]*([^#]*)', 1) AS a, lower(regexp_extract(b, '^((?s:.*?)://[^/?#]*)', 1)) || regexp_extract(b, '^(?s:.*?)://[^/?#]*([^#]*)', 1) AS b FROM edge WHERE contains(b, '://')
), ends AS (SELECT a, b FROM noded UNION SELECT b, a FROM noded),
reach(node, other) AS (SELECT a, b FROM ends UNION SELECT node, b FROM reach JOIN ends ON other = a),
urls AS (SELECT page_id, url, NULL::VARCHAR AS node FROM pages UNION ALL SELECT NULL, other, other FROM (SELECT DISTINCT other FROM reach)),
parts AS (
    SELECT *, coalesce(lower(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1)), '') AS host, coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path,
        CASE WHEN contains(url, '://') THEN lower(regexp_extract(url, '^((?s:.*?)://[^/?#]*)', 1)) || regexp_extract(url, '^(?s:.*?)://[^/?#]*([^#]*)', 1) END AS own
    FROM urls
), judged AS (
    SELECT *, (SELECT max({n: length(rule_host || rule_path), rule: rule_host || rule_path, verdict: rule_verdict}) FROM rules WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)) AS best FROM parts
), tainted AS (SELECT DISTINCT reach.node FROM reach JOIN judged ON judged.node = other AND best.verdict = 'block')
SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, CASE WHEN own IN (SELECT node FROM tainted) THEN 'block' ELSE 'allow' END) AS verdict
FROM judged WHERE node IS NULL
"""


QUERIES = {
    "op1_ngram_join": op1_ngram_join,
    "op2_token_counts": op2_token_counts,
    "op3_pii": op3_pii,
    "op4_decontamination": op4_decontamination,
    "op5_topk_search": op5_topk_search,
    "op6_chat_formatting": op6_chat_formatting,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_sharding": op9_sharding,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_phrases": op12_phrases,
    "op13_url_filters": op13_url_filters,
}
ORACLE_SQL = {
    "op4_decontamination": OP4_SQL,
    "op5_topk_search": OP5_SQL,
    "op6_chat_formatting": OP6_SQL,
    "op11_hard_negatives": OP11_SQL,
    "op12_phrases": OP12_SQL,
    "op13_url_filters": OP13_SQL,
}
