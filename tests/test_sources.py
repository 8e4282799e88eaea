"""Datasets, text formats, older chunk files, streams."""

import json
import random

import pytest
from pyspark.sql import functions as F

from locus import proxies
from locus.operators import annotations, maintenance, regions, tiles, variants
from locus.operators.regions import Region
from locus.sources import bam, chunk_files, dataset, text_formats
from locus.streaming import ingest

SF = "/root/testdata/sf0.001"
SAM = [
    "@HD\tVN:1.6\tSO:coordinate",
    "@SQ\tSN:chr2\tLN:8000000",
    "@SQ\tSN:chr1\tLN:10000000",
    "@CO\tmade by hand",
    "r1\t99\tchr1\t101\t60\t5M\t=\t201\t105\tACGTN\tIIIII\tNM:i:0\tRG:Z:rg1",
    "r2\t4\t*\t0\t0\t*\t*\t0\t0\tACG\tIII",
    "r3\t0\tchr2\t300\t30\t2S3M1D2M\t*\t0\t0\tACGTACG\t!!!!!!!",
    "broken line",
    "r4\tx\tchr1\t1\t1\t1M\t*\t0\t0\tA\tI",
]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("data"))
    dataset.write(proxies.reads(spark, SF), path, 256)
    return path


def test_region_reads_prune_partitions(spark, stored):
    found = dataset.query(spark, stored, Region("A", 30, 90))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "chunk_start" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "PushedFilters: [" in plan and "GreaterThanOrEqual(position,30)" in plan
    want = proxies.mapped(spark, SF).where("reference = 'A' and position >= 30 and position < 90")
    assert found.count() == want.count() > 0


def test_overlap_sees_rows_from_before(spark, stored):
    want = proxies.mapped(spark, SF).where("reference = 'A' and position < 140 and position + span > 120").count()
    assert dataset.query(spark, stored, "A:120-140", mode="overlap").count() == want
    assert dataset.query(spark, stored, "A").count() == proxies.mapped(spark, SF).where("reference = 'A'").count()


def test_all_rows_are_stored_and_rechunk_keeps_them(spark, stored, tmp_path):
    columns = ["position", "span", "mapq", "flag", "l_orderkey", "l_linenumber"]
    assert regions.difference(dataset.read(spark, stored).select(columns), proxies.reads(spark, SF).select(columns)).count() == 0
    dataset.rechunk(spark, stored, str(tmp_path / "wide"), 1024, "snappy")
    again = dataset.read(spark, str(tmp_path / "wide"))
    assert regions.difference(again.select(columns), proxies.reads(spark, SF).select(columns)).count() == 0
    assert again.where("reference <> 'unmapped' and chunk_start % 1024 <> 0").count() == 0
    m = dataset.read_manifest(spark, stored)
    assert m.agg(F.sum("reads")).first()[0] == proxies.reads(spark, SF).count()
    assert regions.difference(maintenance.unsharded_paths(maintenance.sharded_paths(m, 8)).select("path"), m.select("path")).count() == 0


def test_append_and_snapshots(spark, tmp_path):
    rows = proxies.reads(spark, SF)
    path = str(tmp_path / "d")
    dataset.write(rows.where("l_linenumber <= 3"), path, 256)
    first = dataset.snapshot(dataset.read_manifest(spark, path), None, 1)
    first = spark.createDataFrame(first.collect(), first.schema)
    dataset.append(rows.where("l_linenumber > 3"), path, 256)
    assert dataset.read(spark, path).count() == rows.count()
    both = dataset.snapshot(dataset.read_manifest(spark, path), first, 2)
    assert dataset.snapshot_changes(both, 1, 2).where("change = 'added'").count() > 0


def test_sam_round_trip(spark, tmp_path):
    (tmp_path / "x.sam").write_text("\n".join(SAM) + "\n")
    lines = text_formats.sam_lines(spark, str(tmp_path / "x.sam"))
    rows = text_formats.parse_sam(lines)
    got = {r.name: r for r in rows.collect()}
    assert set(got) == {"r1", "r2", "r3"} and text_formats.malformed(lines).count() == 2
    assert got["r1"].position == 100 and got["r1"].mate_reference == "chr1" and got["r1"].tags == {"NM": "i:0", "RG": "Z:rg1"}
    assert got["r2"].reference is None and got["r2"].cigar is None and got["r3"].span == 6
    assert sorted(r.value for r in text_formats.format_sam(rows).collect()) == sorted(SAM[4:7])
    assert [tuple(r) for r in text_formats.sam_references(spark, str(tmp_path / "x.sam")).collect()] == [(0, "chr2", 8000000), (1, "chr1", 10000000)]
    assert {r.kind for r in text_formats.sam_header(lines).collect()} == {"HD", "SQ", "CO"}


def test_stream_ingest_appends_late_rows(spark, tmp_path):
    source, target = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    (source / "a.sam").write_text("\n".join(SAM) + "\n")
    references = spark.createDataFrame([(0, "chr2"), (1, "chr1")], "reference_id int, reference string")
    for _ in range(2):
        ingest.ingest_sam(spark, str(source), str(target), references, 1000, str(tmp_path / "cp")).awaitTermination()
        (source / "late.sam").write_text("late\t0\tchr1\t5\t9\t1M\t*\t0\t0\tA\tI\n")
    stored = dataset.read(spark, str(target))
    assert stored.where("reference = 'chr1' and chunk_start = 0").count() == 2 and stored.count() == 4


def test_stream_windows(spark):
    events = spark.readStream.schema(spark.read.parquet(f"{SF}/events.parquet").schema).parquet(f"{SF}/events*.parquet")
    query = ingest.windowed_counts(events, "1 day").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.sql("select sum(events) from w").first()[0] == spark.read.parquet(f"{SF}/events.parquet").count()


def test_older_chunk_files(spark, tmp_path):
    records = [("r1", 99, 0, 100, 60, "5M", "ACGTN", "IIIII", {"NM": "i:0", "RG": "Z:a b"}), ("r2", 4, -1, -1, 0, None, "ACG", "III", {}), ("", 0, 1, 7, 1, "2S3M", "ACGTA", "!!!!!", {})]
    import zstandard

    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "x.chunk").write_bytes(chunk_files.pack(records))
    (tmp_path / "b" / "y.chunk").write_bytes(zstandard.ZstdCompressor().compress(chunk_files.pack(records[:1])))
    rows = chunk_files.read_packed(spark, str(tmp_path / "b")).drop("span").collect()
    assert sorted((*r[:-1], sorted(r[-1].items())) for r in map(tuple, rows) if r[5]) == sorted((*r[:-1], sorted(r[-1].items())) for r in records + records[:1] if r[5])
    assert [tuple(r) for r in rows if r.cigar is None] == [records[1]]
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "x.chunk").write_text(json.dumps([{"name": "a", "flag": 0, "ref": 1, "pos": 5, "mapq": 3, "cigar": "4M", "seq": "ACGT", "qual": "IIII"}, {"name": "b", "flag": 4, "reference_id": -1, "position": -1, "mapping_quality": 0, "cigar": None, "sequence": "A", "quality": "I", "tags": {"X1": "q"}}]))
    got = {r.name: r for r in chunk_files.read_json(spark, str(tmp_path / "j")).collect()}
    assert got["a"].position == 5 and got["a"].span == 4 and got["b"].tags == {"X1": "Z:q"} and got["b"].reference_id == -1


def test_vcf_fastq_bed(spark, tmp_path):
    (tmp_path / "v").write_text("##x\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2\n1\t11\t.\tA\tG,T\t9\tPASS\t.\tGT:DP\t0/1:3\t0/0:1\n1\t12\t.\tA\tG\t9\tPASS\t.\tGT\t./.\t1|1\n")
    assert [(r.sample, r.position, r.genotype) for r in text_formats.parse_vcf(spark.read.text(str(tmp_path / "v"))).orderBy("position").collect()] == [("s1", 10, "0/1"), ("s2", 11, "1|1")]
    (tmp_path / "f").write_text("@r1 x\nACGT\n+\nIIII\n@r2\nAC\n+r2\nI!\n")
    assert [tuple(r) for r in text_formats.read_fastq(spark, str(tmp_path / "f")).orderBy("read_id").collect()] == [("r1", "ACGT", "IIII"), ("r2", "AC", "I!")]
    (tmp_path / "b").write_text("chr1\t50\t150\nchr2\t100\t200\n")
    assert text_formats.read_bed(spark, str(tmp_path / "b")).first().name == "chr1_50_150"


def test_region_text():
    assert Region.parse("chr1:1,000-2,000") == Region("chr1", 1000, 2000) and Region.parse("x") == Region("x")
    for bad in ("chr1:5", "a:9-3", "a:b:1-2", ""):
        with pytest.raises(ValueError):
            Region.parse(bad)


def test_fastq_keeps_qualities_that_begin_with_at(spark, tmp_path):
    rng = random.Random(4)
    want = []
    for part in range(3):
        lines = []
        for k in range(400):
            n = rng.randint(1, 12)
            quality = "".join(rng.choice("@@@I+#") for _ in range(n))
            want.append((f"r{part}.{k}", "".join(rng.choice("ACGT") for _ in range(n)), quality))
            lines += [f"@r{part}.{k} extra", want[-1][1], "+", quality]
            if k % 50 == 7:
                lines += ["@cut", "ACGT", "+"]  # a record without its quality loses nobody else
        (tmp_path / f"{part}.fastq").write_text("\n".join(lines) + "\n" * (part % 2))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        got = text_formats.read_fastq(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(map(tuple, got)) == sorted(want)
    bad = text_formats.malformed_fastq(spark, str(tmp_path)).collect()
    assert bad and all(r.value.startswith("cut") for r in bad)


def test_rechunk_onto_itself_and_shipping(spark, tmp_path):
    import zipfile

    import locus

    path = f"file://{tmp_path}/d"
    dataset.write(proxies.reads(spark, SF), path, 64)
    before = dataset.read(spark, path).count()
    dataset.rechunk(spark, path, path, 128)
    assert dataset.read(spark, path).count() == before and {r.chunk_size for r in dataset.read_manifest(spark, path).select("chunk_size").collect()} == {128}
    locus.ship(spark)
    files = [f for f in spark.sparkContext._python_includes if f == "locus.zip"]
    assert files and "locus/sources/dataset.py" in zipfile.ZipFile(f"{spark.sparkContext._temp_dir and __import__('pyspark').SparkFiles.get('locus.zip')}").namelist()


def aligned(spark, n=1500, seed=3):
    rng, rows = random.Random(seed), []
    for k in range(n):
        unmapped, size = rng.random() < 0.1, rng.randint(1, 120)
        rows.append((
            f"r{k}", 4 if unmapped else rng.choice([0, 16, 99, 1024]), None if unmapped else rng.choice(["chr1", "chr2"]), -1 if unmapped else rng.randint(0, 10**6), 0 if unmapped else 60,
            None if unmapped else rng.choice([f"{size}M", f"{size}M2D", f"1S{size}="]), rng.choice([None, "chr1"]), rng.randint(-1, 1000), rng.randint(-500, 500), "".join(rng.choice("ACGTN") for _ in range(size)),
            None if rng.random() < 0.1 else "".join(chr(33 + rng.randint(0, 60)) for _ in range(size)), {"NM": f"i:{k % 7}", "RG": "Z:rg1", "BC": "Z:0012", "XA": "A:q", "XF": "f:1.5", "XB": "B:s,-3,4", "XI": f"i:{2**31 + k}"} if rng.random() < 0.8 else {}, 0 if unmapped else size,
        ))
    schema = "name string, flag int, reference string, position int, mapq int, cigar string, mate_reference string, mate_position int, template_length int, sequence string, quality string, tags map<string,string>, span int"
    return rows, spark.createDataFrame(rows, schema).repartition(5)


REFERENCES = [("chr2", 8_000_000), ("chr1", 10_000_000)]


def test_bam_round_trip_over_members_and_splits(spark, tmp_path):
    import gzip

    rows, frame = aligned(spark)
    text = "@HD\tVN:1.6\n" + "".join(f"@SQ\tSN:{n}\tLN:{size}\n" for n, size in REFERENCES)
    bam.write_bam(frame, text, REFERENCES, str(tmp_path / "out"), payload=700)
    whole = b"".join(p.read_bytes() for p in sorted((tmp_path / "out").glob("part-*")))
    assert gzip.decompress(whole)[:4] == bam.MAGIC and whole.endswith(bam.LAST)
    (tmp_path / "whole.bam").write_bytes(whole)
    assert bam.read_header(spark, str(tmp_path / "whole.bam")) == (text, REFERENCES)
    want = sorted(str((*r[:11], sorted(r[11].items()))) for r in rows)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("128m", "3000", "20000"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = bam.read_bam(spark, str(tmp_path / "whole.bam")).select(*frame.columns[:12]).collect()
            assert sorted(str((*r[:11], sorted(r[11].items()))) for r in map(tuple, got)) == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    # Several parts, of which the first is not the largest.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    bam.write_bam(frame, text, REFERENCES, str(tmp_path / "parts"), payload=700)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list((tmp_path / "parts").glob("part-*"))) > 1 and bam.read_header(spark, str(tmp_path / "parts")) == (text, REFERENCES)
    assert sorted(str((*r[:11], sorted(r[11].items()))) for r in map(tuple, bam.read_bam(spark, str(tmp_path / "parts")).select(*frame.columns[:12]).collect())) == want
    order = [(r.reference_id, r.position) for r in bam.read_bam(spark, str(tmp_path / "whole.bam")).collect()]
    mapped = [x for x in order if x[0] >= 0]
    assert sorted(mapped) == [(r, p) for r, p in sorted(mapped)] and len(order) == len(rows)


def test_bam_of_broken_files(spark, tmp_path):
    _, frame = aligned(spark, 50)
    bam.write_bam(frame, "@HD\tVN:1.6\n", REFERENCES, str(tmp_path / "out"))
    whole = b"".join(p.read_bytes() for p in sorted((tmp_path / "out").glob("part-*")))
    (tmp_path / "cut.bam").write_bytes(whole[: len(whole) // 2])
    (tmp_path / "other.bam").write_bytes(bam.member(b"no such file") + bam.LAST)
    with pytest.raises(Exception):
        bam.read_bam(spark, str(tmp_path / "cut.bam")).collect()
    with pytest.raises(ValueError):
        bam.read_header(spark, str(tmp_path / "other.bam"))
    bam.write_bam(frame.limit(0), "@HD\tVN:1.6\n", REFERENCES, str(tmp_path / "none"))
    assert bam.read_bam(spark, str(tmp_path / "none")).count() == 0


def test_bam_tags_of_every_type():
    import struct

    data = b"XAAq" + b"Xcc\xff" + b"XsS" + struct.pack("<H", 65535) + b"XfF"[:2] + b"f" + struct.pack("<f", 1.5) + b"XZZab\0" + b"XBBs" + struct.pack("<ihh", 2, -3, 4)
    typed = {"XA": "A:q", "Xc": "i:-1", "Xs": "i:65535", "Xf": "f:1.5", "XZ": "Z:ab", "XB": "B:s,-3,4"}
    assert dict(bam._tags(data)) == typed and dict(bam._tags(data + b"XAAz")) == typed
    assert dict(bam._tags(b"".join(bam._packed_tag(*t) for t in typed.items()))) == typed
    for plain, full in (("0012", "Z:0012"), ("5", "i:5"), ("1.5", "f:1.5"), ("x", "Z:x"), ("Z:7", "Z:7"), ("H:1AE3", "H:1AE3"), ("99999999999", "Z:99999999999"), ("B:f,0.5,1.0", "B:f,0.5,1.0")):
        assert dict(bam._tags(bam._packed_tag("Xx", plain))) == {"Xx": full}


def test_references_of_several_files_count_once(spark, tmp_path):
    for k, names in enumerate((["b", "a"], ["b", "a", "c"])):
        (tmp_path / f"{k}.sam").write_text("@HD\tVN:1.6\n" + "".join(f"@SQ\tSN:{n}\tLN:{len(names)}\n" for n in names))
    assert [tuple(r) for r in text_formats.sam_references(spark, str(tmp_path)).collect()] == [(0, "b", 2), (1, "a", 2), (2, "c", 3)]


def test_sam_files_keep_their_header(spark, tmp_path):
    (tmp_path / "x.sam").write_text("\n".join(SAM[:7]) + "\n@RG\tID:rg1\tSM:a:b\n@PG\tID:p\tCL:x y\n")
    lines = text_formats.sam_lines(spark, str(tmp_path / "x.sam"))
    references = text_formats.sam_references(spark, str(tmp_path / "x.sam"))
    text_formats.write_sam(text_formats.parse_sam(lines), references, str(tmp_path / "out"), text_formats.sam_header(lines))
    header = [r.value for r in spark.read.text(str(tmp_path / "out" / "header")).collect()]
    assert header == [SAM[0], SAM[1], SAM[2], "@RG\tID:rg1\tSM:a:b", "@PG\tID:p\tCL:x y", SAM[3]]
    assert [r.value.split("\t")[0] for r in spark.read.text(str(tmp_path / "out" / "body")).collect()] == ["r3", "r1", "r2"]
    text_formats.write_sam(text_formats.parse_sam(lines), references, str(tmp_path / "short"))
    assert spark.read.text(str(tmp_path / "short" / "header")).count() == 2


def test_vcf_files_with_other_samples_keep_their_names(spark, tmp_path):
    head = "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT"
    (tmp_path / "a").write_text(f"##x\n{head}\ts1\ts2\n1\t11\t.\tA\tG\t9\tPASS\tDP=31;AF=1\tGT\t0/1\t0\n")
    (tmp_path / "b").write_text(f"##y\n{head}\ts9\n1\t12\trs1\tA\tG\t.\tq10\tXDP=4\tGT\t1\n")
    lines = text_formats.read_vcf_lines(spark, str(tmp_path))
    assert sorted((r.sample, r.position, r.genotype) for r in text_formats.parse_vcf(lines).collect()) == [("s1", 10, "0/1"), ("s9", 11, "1")]
    assert sorted(tuple(r) for r in text_formats.vcf_sites(lines).select("position", F.coalesce("id", F.lit("-")), F.coalesce("qual", F.lit(-1.0)), "filter", F.coalesce("depth", F.lit(-1))).collect()) == [(10, "-", 9.0, "PASS", 31), (11, "rs1", -1.0, "q10", -1)]
    with pytest.raises(Exception, match="different samples"):
        text_formats.concat_vcf(lines).collect()


def test_vcf_concat_orders_contigs_as_the_header_does(spark, tmp_path):
    head = "##contig=<ID=2,length=9>\n##contig=<ID=10>\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts"
    for k, body in enumerate((["10\t5", "2\t9"], ["2\t30", "2\t9"])):
        (tmp_path / str(k)).write_text(f"{head}\n" + "".join(f"{b}\t.\tA\tG\t.\t.\t.\tGT\t0/1\n" for b in body))
    got = [r.value for r in text_formats.concat_vcf(text_formats.read_vcf_lines(spark, str(tmp_path))).collect()]
    assert got[:3] == head.split("\n") and [v.split("\t")[:2] for v in got[3:]] == [["2", "9"], ["2", "30"], ["10", "5"]]


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    source, target = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    (source / "a.sam").write_text("\n".join(SAM) + "\n")
    references = spark.createDataFrame([(0, "chr2"), (1, "chr1")], "reference_id int, reference string")
    for k in range(2):  # the second run has lost its checkpoint and plays the batch again
        ingest.ingest_sam(spark, str(source), target, references, 1000, str(tmp_path / f"cp{k}")).awaitTermination()
    assert dataset.read(spark, target).count() == 3
    m = {(r.reference, r.chunk_start): (r.reads, r.max_span) for r in dataset.read_manifest(spark, target).collect()}
    assert m == {("chr1", 0): (1, 5), ("chr2", 0): (1, 6), (None, 0): (1, 0)}
    assert dataset.query(spark, target, "chr2:303-305", mode="overlap").count() == 1


def test_append_adds_entries_of_its_own_rows_only(spark, tmp_path):
    rows, path = proxies.reads(spark, SF), str(tmp_path / "d")
    dataset.write(rows.where("l_linenumber <= 3"), path, 256)
    parts = set((tmp_path / "d" / "manifest").glob("batch=*/*.parquet"))
    dataset.append(rows.where("l_linenumber > 3"), path, 256)
    assert parts < set((tmp_path / "d" / "manifest").glob("batch=*/*.parquet"))
    dataset.write(rows, str(tmp_path / "e"), 256)
    both = [dataset.read_manifest(spark, p).orderBy("reference", "chunk_start").collect() for p in (path, str(tmp_path / "e"))]
    assert both[0] == both[1] and dataset.violations(spark, path).agg(F.sum("violations")).first()[0] == 0


def test_a_lost_file_is_a_violation(spark, tmp_path):
    path = tmp_path / "d"
    dataset.write(proxies.reads(spark, SF), str(path), 256)
    gone = next((path / "data" / "batch=0" / "reference=R").glob("chunk_start=*/*.parquet"))
    gone.rename(tmp_path / "gone")
    found = {r.rule: r.violations for r in dataset.violations(spark, str(path)).collect()}
    assert found["files_missing"] == 1 and sum(found.values()) == 1


def test_older_datasets_become_new_ones(spark, tmp_path):
    import zstandard

    records = [(f"r{k}", 0, k % 2, 10 * k, 60, "5M", "ACGTN", "IIIII", {"NM": "i:0"}) for k in range(20)]
    old = tmp_path / "old"
    old.mkdir()
    (old / "a.chunk").write_bytes(chunk_files.pack(records[:8]))
    (old / "b.chunk").write_bytes(zstandard.ZstdCompressor().compress(chunk_files.pack(records[8:12])))
    as_json = json.dumps([{"name": r[0], "flag": r[1], "ref": r[2], "pos": r[3], "mapq": r[4], "cigar": r[5], "seq": r[6], "qual": r[7], "tags": r[8]} for r in records[12:]]).encode()
    (old / "c.chunk").write_bytes(zstandard.ZstdCompressor().compress(as_json))
    got = [tuple(r)[:9] for r in chunk_files.read_any(spark, str(old)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, records))
    references = spark.createDataFrame([(0, "x"), (1, "y")], "reference_id int, reference string")
    dataset.upgrade(spark, str(old), references, str(tmp_path / "new"), 64)
    assert dataset.query(spark, str(tmp_path / "new"), "y:0-100").count() == 5 and dataset.read(spark, str(tmp_path / "new")).count() == 20


def test_views_prune(spark, tmp_path):
    rows = proxies.reads(spark, SF).drop("chunk_start")
    dataset.write_hierarchy(rows, str(tmp_path), "position", 64, 16)
    near = dataset.read_hierarchy(spark, str(tmp_path), "position", 40, 60, 64, 16)
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "coarse" in plan.split("PartitionFilters: [")[1].split("]")[0] and "GreaterThan(fine,24)" in plan
    assert near.count() == rows.where("position >= 40 and position < 60").count() > 0


def test_sites_reach_the_scan(spark, tmp_path):
    text_formats.vcf_sites(spark.createDataFrame([("1\t5\t.\tA\tG\t30\tPASS\tDP=40",), ("1\t6\t.\tA\tG\t.\tPASS\t.",)], "value string")).write.parquet(str(tmp_path / "v"))
    found = variants.filtered(spark.read.parquet(str(tmp_path / "v")), "1", 0, 10, 20.0, 30)
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = found._jdf.queryExecution().executedPlan().toString().split("PushedFilters: [")[1].split("]")[0]
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert found.count() == 1 and "GreaterThanOrEqual(qual,20.0)" in plan and "GreaterThanOrEqual(depth,30)" in plan


def test_nearest_centroid_in_blocks(spark):
    rng = random.Random(2)
    vectors = spark.createDataFrame([(k, [rng.random() for _ in range(4)]) for k in range(60)], "vec_id long, embedding array<double>")
    centres = spark.createDataFrame([(k, [rng.random() for _ in range(4)]) for k in range(25)], "label long, centroid array<double>")
    whole, cut = ({r.vec_id: (r.label, r.distance) for r in tiles.nearest_centroid(vectors, centres, block).collect()} for block in (256, 3))
    assert whole == cut and len(cut) == 60


def test_stream_joins_and_dedup(spark, tmp_path):
    rows = [(k, "2024-01-01 00:00:%02d" % (k % 50), k % 5, "view", 1.0) for k in range(50)]
    spark.createDataFrame(rows + rows[:7], "event_id long, ts string, user_id long, event_type string, value double").write.parquet(str(tmp_path / "e"))
    events = spark.readStream.schema("event_id long, ts string, user_id long, event_type string, value double").parquet(str(tmp_path / "e"))

    def ran(frame, name):
        frame.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start().awaitTermination()
        return spark.table(name)

    assert ran(ingest.deduplicated(events, ["event_id"]), "dedup").count() == 50
    pairs = ran(ingest.paired(events, events, "user_id", "10 seconds"), "pairs")
    stamps = [(k, k % 50, k % 5) for k in [*range(50), *range(7)]]
    assert pairs.count() == sum(a[2] == b[2] and 0 <= b[1] - a[1] <= 10 for a in stamps for b in stamps)


def test_stream_frontier(spark):
    rows = proxies.mapped(spark, SF, 64)
    found = {(r.reference, r.chunk_start) for r in ingest.settled_chunks(rows, 64).collect()}
    last = {r.reference: r.m for r in rows.groupBy("reference").agg(F.max("position").alias("m")).collect()}
    want = {(r.reference, r.chunk_start) for r in rows.select("reference", "chunk_start").distinct().collect() if r.chunk_start + 64 <= last[r.reference] - 128}
    assert found == want


def test_other_format_versions_are_refused(spark, tmp_path):
    path = str(tmp_path / "d")
    dataset.write(proxies.reads(spark, SF), path, 256)
    entries = spark.createDataFrame(spark.read.parquet(f"{path}/manifest").collect(), spark.read.parquet(f"{path}/manifest").schema)
    entries.withColumn("version", F.lit("9")).write.mode("overwrite").partitionBy("batch").parquet(f"{path}/manifest")
    with pytest.raises(ValueError, match="version"):
        dataset.query(spark, path, "A")


def test_stream_sessions(spark, tmp_path):
    stamps = [(1, 0), (1, 20), (1, 400), (2, 5), (2, 50)]
    rows = [(k, f"2024-01-01 00:{t // 60:02d}:{t % 60:02d}", u, "view", 1.0) for k, (u, t) in enumerate(stamps)]
    # Late enough to close all sessions before it.
    rows.append((99, "2024-01-02 00:00:00", 3, "view", 1.0))
    schema = "event_id long, ts string, user_id long, event_type string, value double"
    for k, part in enumerate((rows[:-1], rows[-1:])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / "e" / str(k)))
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "e"))
    ingest.session_counts(events, "1 minute").writeStream.format("memory").queryName("s").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    assert sorted((r.user_id, r.events) for r in spark.table("s").collect()) == [(1, 1), (1, 2), (2, 2)]


def test_edges_of_buckets(spark):
    rng = random.Random(6)
    rows = [(k, rng.randint(0, 2), rng.choice("abc"), rng.randint(0, 400)) for k in range(200)]
    events = spark.createDataFrame(rows, "id long, participant long, code string, t long")
    for width in (7, 100, 10_000):
        got = {r.id: r.gap for r in annotations.gaps(events, width).collect()}
        pairs = annotations.adjacent(events, "a", "b", width).first()
        want, n, seconds = {}, 0, 0
        for p in range(3):
            own = sorted((t, k, c) for k, q, c, t in rows if q == p)
            for before, at in zip([None, *own], own):
                want[at[1]] = at[0] - before[0] if before else None
                if before and before[2] == "a" and at[2] == "b":
                    n, seconds = n + 1, seconds + at[0] - before[0]
        assert got == want and tuple(pairs) == (n, seconds)
        right = events.where("code = 'b'").groupBy("participant", "t").agg(F.max("id").alias("v"))
        last = {r.id: r.v for r in annotations.as_of(events.select("id", "participant", "t"), right, "participant", "t", "v", width).collect()}
        known = [(r.participant, r.t, r.v) for r in right.collect()]
        assert last == {k: max(((t2, v) for q, t2, v in known if q == p and t2 <= t), default=(0, None))[1] for k, p, _, t in rows}
