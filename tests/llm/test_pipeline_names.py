"""The pipeline over a corpus whose columns are named like its operators' own."""

import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_columns_named_like_results(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    plain = {r.doc_id: r for r in run_over(spark, docs, f"{tmp_path}/plain").collect()}
    own = {"score": "'mine'", "Predicted": "7", "first_id": "1", "first_key": "2L", "text_key": "3", "class": "'c'", "component_id": "'d'", "dirty_id": "4", "dirty_digest": "5", "row": "6", "ids": "'i'", "n_tokens": "8", "round_trip": "'r'", "text_sha256": "'s'", "node": "9", "name": "'n'", "spans": "10", "n_shingles": "11"}
    given = docs.selectExpr("*", *(f"{v} AS {k}" for k, v in own.items()))
    out = run_over(spark, given, f"{tmp_path}/named")
    got = {r.doc_id: r for r in out.collect()}
    assert {k: (r.ids, r.n_tokens) for k, r in got.items()} == {k: (r.ids, r.n_tokens) for k, r in plain.items()} and got
    kept = {k: f"source_{k}" if k in ("ids", "n_tokens", "round_trip", "text_sha256") else k for k in own}
    first = next(iter(got.values())).asDict()
    assert {str(first[name]) for name in kept.values()} == {v.strip("'L") for v in own.values()} and set(kept.values()) <= set(out.columns)
    assert all(r.round_trip is True for r in got.values())


def run_over(spark, docs, folder):
    docs.write.parquet(f"{folder}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{folder}/{name}.parquet")
    return corpus_pipeline.run(spark, folder)
