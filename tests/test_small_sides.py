"""Tables of a few references never deal the rows out by reference, also where Spark would broadcast nothing by itself."""

import pytest

from locus.sources import bam, dataset


@pytest.fixture
def no_broadcast(spark):
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k in conf:
        spark.conf.unset(k)


def plan_of(rows):
    return rows._jdf.queryExecution().executedPlan().toString()


def test_binary_records_meet_their_references_in_place(spark, tmp_path, no_broadcast):
    kind = "name string, flag int, reference string, position int, mapq int, cigar string, mate_reference string, mate_position int, template_length int, sequence string, quality string, tags map<string,string>, span int"
    rows = spark.createDataFrame([(f"r{k}", 0, "AN"[k % 2], k, 1, "5M", None, -1, 0, None, None, {}, 5) for k in range(40)] + [("u", 4, None, -1, 0, None, None, -1, 0, None, None, {}, None)], kind)
    bam.write_bam(rows, "@HD\tVN:1.6\n", [("A", 1000), ("N", 1000)], str(tmp_path))
    back = bam.read_bam(spark, str(tmp_path))
    assert "SortMergeJoin" not in plan_of(back) and plan_of(back).count("BroadcastHashJoin") >= 2
    assert {(r.name, r.reference, r.position) for r in back.collect()} == {(r.name, r.reference, r.position) for r in rows.collect()}


def test_upgraded_rows_meet_their_references_in_place(spark, tmp_path, no_broadcast, monkeypatch):
    seen = []
    whole = dataset.write
    monkeypatch.setattr(dataset, "write", lambda rows, *a, **k: (seen.append(plan_of(rows)), whole(rows, *a, **k)))
    (tmp_path / "part-0").write_text('[{"name":"a","flag":0,"ref":1,"pos":7,"mapq":1,"cigar":"5M","seq":"","qual":""},{"name":"b","flag":4,"ref":-1,"pos":-1,"mapq":0,"cigar":"","seq":"","qual":""}]')
    dataset.upgrade(spark, str(tmp_path), spark.createDataFrame([(0, "A"), (1, "N")], "reference_id int, reference string"), str(tmp_path / "new"), 512, "part-*")
    assert "SortMergeJoin" not in seen[0] and "BroadcastHashJoin" in seen[0]
    assert {(r.name, r.reference) for r in dataset.read(spark, str(tmp_path / "new")).collect()} == {("a", "N"), ("b", "unmapped")}
