"""Appends that leave out copies: what is one, that it is not stored, and other writers in between."""

import pytest
from pyspark.sql import functions as F

from locus import registry
from locus.operators.regions import Region
from locus.sources import dataset, snapshots

SIZE = 100


def rows(spark, n, start=0, **more):
    columns = ["CAST(CASE WHEN id % 7 = 6 THEN -1 ELSE id % 2 END AS INT) AS reference_id", "CASE WHEN id % 2 = 0 THEN 'a' ELSE 'b' END AS reference", f"CAST({start} + id * 3 AS LONG) AS position", "10 AS span", "60 AS mapq", "0 AS flag"]
    return spark.range(n).selectExpr(*columns, *(f"{text} AS {name}" for name, text in more.items()))


def seen(spark, path, version=None):
    return snapshots.read(spark, path, version).count()


def test_the_query_appends_a_copy(spark, monkeypatch):
    made, append = [], snapshots.append

    def kept(given, path, *args, **options):
        made.append((sorted(map(tuple, given.collect())), append(given, path, *args, **options), dataset.read(spark, path).count()))
        return made[-1][1]

    monkeypatch.setattr(snapshots, "append", kept)
    told = registry.queries()["read_as_of"](spark, "/root/testdata/sf0.001").collect()
    (first, _, _), (second, _, stored), (third, version, after) = made
    assert second == third != first and version == 3 and after == stored == len(first) + len(second)
    by_version = {v: sorted(tuple(r)[1:] for r in told if r.version == v) for v in range(1, 6)}
    assert by_version[2] == by_version[3] == by_version[5] != by_version[4] and len(by_version[1])


@pytest.mark.parametrize(
    "one, two",
    [
        ({"tags": "map('NM', 'i:1')"}, {"tags": "map('NM', 'i:2')"}),
        ({"parts": "named_struct('x', 1, 'm', map('a', 1))"}, {"parts": "named_struct('x', 1, 'm', map('a', 2))"}),
        ({"tag": "CAST(NULL AS STRING)"}, {"tag": "''"}),
        ({"tag": "'x\ty'", "tail": "'z'"}, {"tag": "'x'", "tail": "'y\tz'"}),
        ({"tag": "'x'"}, {"tail": "'x'"}),
    ],
)
def test_chunks_with_the_same_digests_are_no_copies_if_their_rows_differ(spark, tmp_path, one, two):
    path = f"file://{tmp_path}/d"
    for given in (one, two):
        snapshots.append(rows(spark, 20, **given), path, SIZE, skip_copies=True)
    assert seen(spark, path) == 40


def test_rows_that_repeat_are_counted(spark, tmp_path):
    path = f"file://{tmp_path}/d"
    a, b = (rows(spark, 20, **{"tags": f"map('NM', 'i:{k}')"}) for k in (1, 2))
    snapshots.append(a.union(a).union(b), path, SIZE, skip_copies=True)
    snapshots.append(a.union(b).union(b), path, SIZE, skip_copies=True)
    snapshots.append(b.union(a).union(a), path, SIZE, skip_copies=True)
    assert seen(spark, path, 1) == 60 and seen(spark, path, 2) == 120 == seen(spark, path, 3)


def test_copies_are_not_stored(spark, tmp_path):
    path = f"file://{tmp_path}/d"
    for _ in range(2):
        snapshots.append(rows(spark, 40), path, SIZE, skip_copies=True)
        assert dataset.read(spark, path).count() == 40 == seen(spark, path)
    # As before, and then some: only chunks that are new or hold more are stored.
    snapshots.append(rows(spark, 60), path, SIZE, skip_copies=True)
    assert dataset.read(spark, path).count() == seen(spark, path) < 100
    fields = ("reference_id", "reference", "position")
    whole = rows(spark, 60).withColumn("reference", F.expr("if(reference_id < 0, 'unmapped', reference)")).select(*fields)
    assert whole.exceptAll(snapshots.read(spark, path).select(*fields)).count() == 0
    assert dataset.read_manifest(spark, path).agg(F.sum("reads")).first()[0] == seen(spark, path)
    assert not list((tmp_path / "d" / "drafts").iterdir())


def test_a_copy_counts_by_the_version_it_goes_on_top_of(spark, tmp_path, monkeypatch):
    path, whole, turns = f"file://{tmp_path}/d", snapshots.commit, []
    snapshots.append(rows(spark, 40), path, SIZE)
    gone = snapshots.entries(spark, path, 1).where("reference = 'a' and chunk_start = 0").first().reads
    assert gone

    def raced(s, p, base, *args):
        if not turns:
            turns.append(base)
            empty = snapshots.entries(s, p, 1).withColumn("live", F.expr("not (reference = 'a' and chunk_start = 0)"))
            whole(s, p, base, "other", empty)
        return whole(s, p, base, *args)

    # All was a copy, until another writer removed a chunk: that one is stored again.
    monkeypatch.setattr(snapshots, "commit", raced)
    assert snapshots.append(rows(spark, 40), path, SIZE, skip_copies=True) == 3
    assert seen(spark, path, 2) == 40 - gone and seen(spark, path, 3) == 40 and dataset.read(spark, path).count() == 40 + gone


def test_two_writers_of_the_same_rows(spark, tmp_path, monkeypatch):
    path, whole, turns = f"file://{tmp_path}/d", snapshots.commit, []
    snapshots.append(rows(spark, 10, 5000), path, SIZE)

    def raced(s, p, base, *args):
        if not turns:
            turns.append(base)
            snapshots.append(rows(s, 40), p, SIZE)
        return whole(s, p, base, *args)

    monkeypatch.setattr(snapshots, "commit", raced)
    assert snapshots.append(rows(spark, 40), path, SIZE, skip_copies=True) == 3
    assert seen(spark, path, 2) == 50 == seen(spark, path, 3)
    snapshots.vacuum(spark, path, grace_seconds=-60)
    assert seen(spark, path) == 50 == dataset.read(spark, path).count()


def test_replaced_chunks_are_no_copies_of_what_they_held(spark, tmp_path):
    path = f"file://{tmp_path}/d"
    snapshots.append(rows(spark, 40), path, SIZE, skip_copies=True)
    snapshots.replace(None, path, SIZE, Region("a", 0, SIZE), base=1)
    left = seen(spark, path)
    assert left < 40 and snapshots.append(rows(spark, 40), path, SIZE, skip_copies=True) == 3 and seen(spark, path) == 40


def test_what_a_broken_writer_has_drafted_is_not_seen(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/d"
    snapshots.append(rows(spark, 40), path, SIZE)
    with monkeypatch.context() as m:
        m.setattr(snapshots, "_on_top", lambda *_: 1 / 0)
        m.setattr(snapshots.shared, "remove", lambda *_: None)  # the process is gone
        with pytest.raises(ZeroDivisionError):
            snapshots.append(rows(spark, 50), path, SIZE, skip_copies=True)
    assert dataset.read(spark, path).count() == 40 == seen(spark, path) and snapshots.vacuum(spark, path) == []
    assert [g.split("/")[0] for g in snapshots.vacuum(spark, path, grace_seconds=-60)] == ["drafts"]
