"""The offset index: every record is found through it, and a small region inflates few members."""

import pytest
from pyspark.sql import functions as F

from locus.operators.regions import Region
from locus.sources import bam, bam_index
from tests.test_sources import REFERENCES, aligned


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("bam")
    rows, frame = aligned(spark, 2500, seed=8)
    bam.write_bam(frame, "@HD\tVN:1.6\n", REFERENCES, str(path / "parts"), payload=900)
    whole = b"".join(p.read_bytes() for p in sorted((path / "parts").glob("part-*")))
    (path / "whole.bam").write_bytes(whole)
    return path, frame


@pytest.mark.parametrize("split", ["128m", "2500", "40000"])
def test_index_lists_every_record_once(spark, stored, split):
    path, frame = stored
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        index = bam_index.build(spark, str(path / "whole.bam")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sum(r.reads for r in index) == frame.count()
    data = (path / "whole.bam").read_bytes()
    assert all(data[r.offset : r.offset + len(bam.MEMBER)] == bam.MEMBER for r in index)
    spans = {(r.reference_id, r.offset): (r.least, r.end, r.first, r.reads) for r in index}
    if split == "128m":
        stored[0].joinpath("want").write_text(repr(sorted(spans.items())))
    else:
        assert repr(sorted(spans.items())) == stored[0].joinpath("want").read_text()


@pytest.mark.parametrize("name", ["whole.bam", "parts"])
def test_regions_through_the_index(spark, stored, name):
    path, frame = stored
    bam_index.write(spark, str(path / name), str(path / f"{name}.index"))
    total = spark.read.parquet(str(path / f"{name}.index" / "members")).select("file", "offset").distinct().count()
    columns = [c for c in frame.columns if c != "tags"]
    for region, few in ((Region("chr1", 400_000, 420_000), True), (Region("chr2", 0, 5000), True), (Region("chr2", 999_000, None), True), (Region("chr1"), False), (Region("nowhere"), True)):
        seen = spark.sparkContext.accumulator(0)
        got = bam_index.read_region(spark, str(path / f"{name}.index"), region, seen)
        own = frame.where((F.col("reference") == region.reference) & (F.col("position") < (region.end or 1 << 30)) & (F.col("position") + bam.reference_span(F.col("cigar")) > region.start))
        found = sorted(map(str, got.select(*columns[:-1]).collect()))
        assert found == sorted(map(str, own.select(*columns[:-1]).collect())) and (few or found)
        assert not few or seen.value < total / 8


def test_index_of_nothing_and_of_other_bytes(spark, stored, tmp_path):
    path, frame = stored
    bam.write_bam(frame.limit(0), "@HD\tVN:1.6\n", REFERENCES, str(tmp_path / "none"))
    bam_index.write(spark, str(tmp_path / "none"), str(tmp_path / "none.index"))
    assert bam_index.read_region(spark, str(tmp_path / "none.index"), "chr1").count() == 0
    (tmp_path / "moved.bam").write_bytes((path / "whole.bam").read_bytes())
    bam_index.write(spark, str(tmp_path / "moved.bam"), str(tmp_path / "moved.index"))
    (tmp_path / "moved.bam").write_bytes(b"x" + (path / "whole.bam").read_bytes())
    with pytest.raises(Exception, match="no member"):
        bam_index.read_region(spark, str(tmp_path / "moved.index"), "chr1:1-100000").collect()
