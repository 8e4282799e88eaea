"""Numbers of links against brute force: classes of one block, of many, copies, rows without ids."""

import random

import numpy as np
import pytest

from locus.llm import queries, simjoin
from tests.llm.test_operators import corpus, shingles

SF = "/root/testdata/sf0.01"


def brute_links(rows):
    sets = [shingles(t) for _, t in rows]
    out = []
    for i, a in enumerate(sets):
        out.append(sum(1 for j, b in enumerate(sets) if i != j and a and b and 100 * len(a & b) >= 75 * len(a | b)))
    return out


@pytest.mark.parametrize("group", [1 << 19, 200])
def test_links_of_every_document(spark, monkeypatch, group):
    monkeypatch.setattr(simjoin, "GROUP", group)
    rng = random.Random(3)
    rows = corpus(11)
    base = [f"w{k}" for k in range(60)]
    for k in range(40):  # a crowd in which not all link
        copy = list(base)
        for _ in range(rng.randrange(9)):
            copy[rng.randrange(60)] = f"v{rng.randrange(99)}"
        rows.append((1000 + k // 2 if k % 4 else None, " ".join(copy)))
    rows += [(2000, " ".join(base)), (2001, " ".join(base)), (2001, " ".join(base)), (2002, None), (2003, "")]
    got = simjoin.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), links=True).collect()
    want = {}
    for (i, _), n in zip(rows, brute_links(rows), strict=True):
        want.setdefault(i, []).append(n)
    have = {}
    for r in got:
        have.setdefault(r.doc_id, []).append(r.n_links)
    assert {k: sorted(v) for k, v in have.items()} == {k: sorted(v) for k, v in want.items()} and max(map(max, want.values())) > 10


def test_overlaps():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 50, rng.integers(0, 40))) for _ in range(30)]
    got = simjoin.overlaps(sets)
    assert all(got[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(30) for j in range(30) if i != j) and simjoin.overlaps([]).shape == (0, 0)


def test_all_links_of_the_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: r.n_links for r in queries.op1_ngram_join(spark, SF).collect()}
    sets = {i: shingles(t) for i, t in rows}
    # Only documents that share a shingle can link.
    by = {}
    for i, s in sets.items():
        for g in s:
            by.setdefault(g, []).append(i)
    near = {(a, b) for own in by.values() for k, a in enumerate(own) for b in own[k + 1 :]}
    want = dict.fromkeys(sets, 0)
    for a, b in near:
        both = len(sets[a] & sets[b])
        if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            want[a] += 1
            want[b] += 1
    assert got == want and sum(want.values()) > 200
