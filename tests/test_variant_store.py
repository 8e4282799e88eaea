"""The variant store: lookups read the chunks that the indexes name, filters miss nothing."""

import random

import pytest
from pyspark.sql import functions as F

from locus.sources import variant_store


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("variants"))
    rng = random.Random(9)
    rows = [(f"rs{p}", p, s, rng.choice([0, 1, 2])) for p in range(0, 6000, 3) for s in rng.sample(range(300), 5)]
    rows += [("rs-twice", 17, 1, 1), ("rs-twice", 5017, 1, 2), (None, 40, 2, 1), ("rs9", 9, None, 1)]
    frame = spark.createDataFrame(rows, "variant_id string, position long, sample long, dosage int")
    variant_store.write(frame.where("position < 3000"), path, 200, bits=2048)
    variant_store.write(frame.where("position >= 3000"), path, 200, bits=2048, mode="append")
    return path, rows, frame


def test_lookup_reads_only_listed_chunks(spark, stored):
    path, rows, _ = stored
    ids = [f"rs{p}" for p in range(300, 360, 3)] + ["rs-twice", "unknown"]
    wanted = spark.createDataFrame([(i,) for i in ids + ids[:2]], "variant_id string")
    got = variant_store.lookup(spark, path, wanted)
    assert sorted(map(tuple, got.select("variant_id", "position", "sample", "dosage").collect())) == sorted(r for r in rows if r[0] in ids)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "chunk_start" in plan.split("PartitionFilters: [")[1].split("]")[0]
    chunks = variant_store.find_ids(spark, path, wanted).select("chunk_start").distinct()
    read = variant_store._of_chunks(spark, path, chunks).select(F.input_file_name().alias("f")).distinct().collect()
    assert {int(r.f.split("chunk_start=")[1].split("/")[0]) for r in read} == {0, 200, 5000}
    index = variant_store.find_ids(spark, path, wanted.limit(1))
    assert "bucket" in index._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1].split("]")[0]


def test_lookup_of_very_many_ids_is_a_join(spark, stored, monkeypatch):
    path, rows, _ = stored
    monkeypatch.setattr(variant_store, "LISTED", 2)
    wanted = spark.createDataFrame([(f"rs{p}",) for p in range(0, 6000, 9)], "variant_id string")
    got = variant_store.lookup(spark, path, wanted).count()
    assert got == sum(r[0] is not None and r[0][2:].isdigit() and int(r[0][2:]) % 9 == 0 for r in rows)


def test_samples_through_filters(spark, stored):
    path, rows, frame = stored
    for sample in (1, 7, 150, 9999):
        got = sorted(map(tuple, variant_store.of_sample(spark, path, sample).select("variant_id", "position", "dosage").collect()))
        assert got == sorted((r[0], r[1], r[3]) for r in rows if r[2] == sample and r[3])
        chunks = {r.chunk_start for r in variant_store.chunks_with(spark, path, sample).collect()}
        assert {r[1] // 200 * 200 for r in rows if r[2] == sample and r[3]} <= chunks
    rate = variant_store.false_positive_rate(spark, path, frame.select("sample")).first()
    assert rate.pairs > 1000 and rate.rate < 0.05
    assert len(variant_store.chunks_with(spark, path, 9999).collect()) < 5


def test_manifest_merges_batches(spark, stored):
    path, rows, frame = stored
    variant_store.write(frame.where("position < 400"), path + "-b", 200, bits=128)
    variant_store.write(frame.where("position < 200"), path + "-b", 200, bits=128, mode="append")
    got = {r.chunk_start: (r.calls, r.stored, len(r.words)) for r in variant_store.read_chunks(spark, path + "-b").collect()}
    near = [r for r in rows if r[1] < 400]
    calls = {a: [r for r in near if r[1] // 200 * 200 == a] for a in (0, 200)}
    stored_of = {a: sum(bool(r[3]) for r in c) for a, c in calls.items()}
    assert got == {0: (2 * len(calls[0]), 2 * stored_of[0], 2), 200: (len(calls[200]), stored_of[200], 2)}
    with pytest.raises(ValueError):
        variant_store.write(frame, path + "-c", 200, bits=100)
