"""Sessions at their edges."""

from locus.operators import annotations


def test_a_pause_of_the_gap_itself_ends_a_session(spark):
    rows = [(1, 7, 100), (2, 7, 7299), (3, 7, 14499), (4, 7, 14499), (5, 8, 0), (6, 8, 7199), (7, 8, None), (8, 8, None), (9, None, 5)]
    got = annotations.sessions(spark.createDataFrame(rows, "id long, participant long, t long"), 7200).collect()
    want = [(7, 100, 2), (7, 14499, 2), (8, 0, 2), (8, None, 1), (8, None, 1), (None, 5, 1)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
