"""Words that were made to collide under sums of powers do not pass for each other."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from locus.llm import simjoin, substrings, textops
from tests.llm.test_operators import brute_classes


def twins(bits=10, a="a", b="b"):
    """Two words of 2**bits characters: by the parity of the place's bits, and the other way round."""
    one = "".join((a, b)[k.bit_count() & 1] for k in range(1 << bits))
    return one, one.translate(str.maketrans(a + b, b + a))


def test_names_of_crafted_words():
    rng = random.Random(4)
    words = [w for k in range(2500) for w in twins(rng.choice((6, 7, 8, 9)), *rng.sample("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 2))]
    words += ["".join(rng.choice(twins(5)) for _ in range(16)) for _ in range(9000)] + [w[:-1] for w in words[:1000]] + [w + w for w in words[:1000]]
    words = sorted(set(words))
    assert len(words) > 10_000
    names = textops.Words(pa.array([" ".join(words)])).names(False, b"key")
    assert len(np.unique(names[:, 0])) == len(np.unique(names[:, 1])) == len(words)
    grams = textops.gram_hashes(names[:, 0], 3)
    assert len(np.unique(grams)) == len(words) - 2


def test_names_follow_case_key_and_text_borders():
    words = textops.Words(pa.array(["Ab É", None, "", "aB é ab"]))
    low, plain = words.names(True, b"k"), words.names(False, b"k")
    assert (low[0] == low[2]).all() and (plain[0] != plain[2]).any() and (low[1] != low[3]).any() and (plain[4] == low[0]).all()
    assert (low != words.names(True, b"other")).any() and len(textops.Words(pa.array([], pa.string())).names(True, b"k")) == 0


@pytest.mark.parametrize("form", ["{} x", "{}", "{0} {0} a b c d e", "a b c {} d e f"])
def test_join_tells_twins_apart(spark, form):
    rows = dict(enumerate([form.format(w) for w in twins()] + [form.format(twins()[0])], 1))
    frame = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in simjoin.jaccard_classes(frame).collect()}
    assert got == brute_classes(rows) and got[1][1] == got[3][1] == 1 and got[2][1] == 2


def test_dedup_tells_twins_apart(spark):
    one, other = twins()
    left, right = " ".join(f"l{k}" for k in range(12)), " ".join(f"r{k}" for k in range(12))
    rows = [(1, f"{left} {one} {right}"), (2, f"{left} {other} {right}"), (3, f"{left} {one} {right}"), (4, " ".join([one] * 25)), (5, " ".join([other] * 25)), (6, " ".join([one] * 20))]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit("k"))
    got = {r.doc_id: r.n_removed for r in substrings.remove_repeats(frame).collect()}
    assert got == {1: 0, 2: 0, 3: 25, 4: 24, 5: 24, 6: 20}
