"""Narrow chunks share folders and files; what is read, pruned and told of each chunk stays."""

from pathlib import Path

from pyspark.sql import functions as F

from locus.operators.regions import Region
from locus.sources import adaptive, dataset, snapshots, variant_store


def narrow(spark, n=4000, step=25):
    """Rows of hundreds of chunks of 100 places, and a few that are unmapped."""
    return spark.range(n).select(
        F.when(F.col("id") % 50 == 0, -1).otherwise(F.col("id") % 2).cast("int").alias("reference_id"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("reference"),
        (F.col("id") * step).alias("position"), F.lit(30).alias("span"), F.lit(9).alias("mapq"), F.lit(0).alias("flag"), "id",
    )


def folders(path: Path) -> int:
    return len({f.parent for f in path.rglob("*.parquet")})


def test_folders_of_a_dataset_hold_many_chunks(spark, tmp_path):
    rows, path = narrow(spark), str(tmp_path)
    for k in range(2):
        dataset.append(rows.where(F.expr(f"id % 4 div 2 = {k}")), path, 100, batch=f"b{k}")
    mapped = rows.where("reference_id >= 0")
    chunks = mapped.selectExpr("reference", "position div 100 * 100 as chunk_start").distinct().count() + 1
    assert chunks > 900 and folders(tmp_path / "data") <= 2 * 2 * 20
    stored = dataset.read(spark, path)
    assert stored.count() == rows.count() and stored.where("reference <> 'unmapped' and chunk_start <> position div 100 * 100").count() == 0
    assert dataset.read_manifest(spark, path).count() == chunks and dataset.violations(spark, path).agg(F.sum("violations")).first()[0] == 0
    sizes = dataset.chunk_files(spark, path)
    assert sizes.count() == chunks and sizes.where("files >= 1 and bytes > 0").count() == chunks
    told, size = dataset.compression(spark, path).first(), sum(f.stat().st_size for f in (tmp_path / "data").rglob("*.parquet"))
    assert (told.chunks, told.bytes) == (chunks, size) and told.least <= told.mean <= told.most
    for start, end in ((12_790, 12_830), (6_400, 6_500), (0, 100)):
        near = dataset.query(spark, path, Region("a", start, end), "overlap")
        want = mapped.where(f"reference = 'a' and position < {end} and position + span > {start}")
        assert sorted(r.id for r in near.select("id").collect()) == sorted(r.id for r in want.collect()) != []
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "chunk_start" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert 0 < near.select(F.input_file_name()).distinct().count() <= 4


def test_versions_leave_out_chunks_inside_a_folder(spark, tmp_path):
    rows, path = narrow(spark), f"file://{tmp_path}"
    snapshots.append(rows, path, 100)
    snapshots.replace(rows.where("reference_id = 0 and position between 300 and 399").limit(1), path, 100, Region("a", 300, 400), base=1)
    gone = rows.where("reference_id = 0 and position between 300 and 399").count()
    assert gone > 1 and snapshots.read(spark, path, 1).count() == rows.count() and snapshots.read(spark, path, 2).count() == rows.count() - gone + 1
    assert snapshots.read(spark, path, 2, Region("a", 300, 400)).count() == 1
    assert folders(tmp_path / "data") <= 20 * 2 + 2


def test_folders_of_variants_are_bounded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(variant_store, "FOLDERS", 8)
    calls = spark.range(3000).selectExpr("concat('v', id) as variant_id", "id - 500 as position", "id % 7 as sample", "cast(id % 3 as int) as dosage")
    path = str(tmp_path)
    # Batches of other extents have folders of other widths.
    variant_store.write(calls.where("position < 50"), path, 10, 128)
    variant_store.write(calls.where("position >= 40"), path, 10, 128, mode="append")
    assert folders(tmp_path / "calls") <= 2 * 9 and variant_store.read_chunks(spark, path).count() == 300
    wanted = calls.where("position in (-500, -1, 45, 55, 2499)").select("variant_id")
    want = calls.where("position in (-500, -1, 55, 2499)").collect() + 2 * calls.where("position = 45").collect()
    got = variant_store.lookup(spark, path, wanted)
    assert sorted(map(tuple, got.select(*calls.columns).collect())) == sorted(map(tuple, want))
    named = variant_store.find_ids(spark, path, wanted).select("chunk_start").distinct()
    assert variant_store._of_chunks(spark, path, named).select(F.input_file_name()).distinct().count() <= 6
    for listed in (10_000, 3):
        monkeypatch.setattr(variant_store, "LISTED", listed)
        mine = [r.position for r in variant_store.of_sample(spark, path, 5).collect()]
        both = calls.where("sample = 5 and dosage <> 0")
        assert sorted(mine) == sorted(r.position for r in both.union(both.where("position between 40 and 49")).collect())


def test_folders_of_adaptive_chunks_are_bounded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(adaptive, "FOLDERS", 12)
    rows, path = narrow(spark).drop("reference_id"), str(tmp_path)
    adaptive.write(rows, path, 20)
    assert adaptive.read_map(spark, path).count() > 150 and folders(tmp_path / "data") <= 12 + 2
    stored = adaptive.read(spark, path)
    assert stored.count() == rows.count() and sorted(stored.columns) == sorted([*rows.columns, "chunk_start"])
    met = stored.join(adaptive.read_map(spark, path).withColumnRenamed("start", "chunk_start"), ["reference", "chunk_start"])
    assert met.where("position >= chunk_start and position < end").count() == rows.count()
    for mode, low in (("start", "position >= 30010"), ("overlap", "position + span > 30010")):
        for listed in (10_000, 1):
            monkeypatch.setattr(adaptive, "LISTED", listed)
            near = adaptive.query(spark, path, Region("a", 30_010, 33_000), mode)
            assert sorted(r.id for r in near.collect()) == sorted(r.id for r in rows.where(f"reference = 'a' and {low} and position < 33000").collect()) != []
        monkeypatch.setattr(adaptive, "LISTED", 10_000)
        assert adaptive.query(spark, path, Region("a", 30_010, 33_000), mode).select(F.input_file_name()).distinct().count() <= 4
