"""Hard negatives against plain Python: ties, repeated rows, odd vectors, huge components."""

import math
import random

from pyspark.sql import functions as F

from locus.llm import negatives


def brute(rows, scale, positives, wanted, least, most):
    able = [(i, y, [math.floor(float(x) * scale) for x in v]) for i, v, y in rows if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for anchor in sorted({i for i, *_ in able if i % 100 == 0}):
        label, q = min((y, v) for i, y, v in able if i == anchor)
        scored = sorted(((-sum(a * b for a, b in zip(q, v, strict=False)), i, y) for i, y, v in able if i != anchor))
        for s, i, _ in [r for r in scored if r[2] == label][:positives]:
            fits = [r for r in scored if r[2] != label and least * -s <= 100 * -r[0] <= most * -s][:wanted]
            out += [(anchor, i, k, j, -s, -t) for k, (t, j, _) in enumerate(fits, 1)]
    fit = lambda n: n if -(2**63) <= n < 2**63 else None
    return sorted([(*r[:4], fit(r[4]), fit(r[5])) for r in out], key=str)


def mined(spark, rows, monkeypatch=None, scale=256, **sizes):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("rank", F.lit("x")).repartition(3)
    if monkeypatch:
        for name, value in sizes.items():
            monkeypatch.setattr(negatives, name, value)
    out = negatives.hard_negatives(frame, F.col("vec_id") % 100 == 0, scale=scale)
    return sorted([tuple(r) for r in out.collect()], key=str)


def test_against_brute_force(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(k, [round(rng.uniform(-1, 1), 2) for _ in range(6)], rng.randrange(3)) for k in range(450)]
    rows += [(700 + k, [1.0] * 6, k % 3) for k in range(150)]  # a crowd of ties
    rows += [(7, [1.0] * 6, 1), (100, [0.5] * 6, 0), (100, [0.5] * 6, 0), (900, [], 1), (901, None, 1), (902, [float("nan")] * 6, 0), (903, [None] * 6, 0), (904, [1.0, 1.0], 2), (905, [1.0] * 6, None), (None, [1.0] * 6, 1), (1000, [0.0] * 6, 0), (1100, [-1.0] * 6, 9)]
    got = mined(spark, rows, monkeypatch, ROWS=64, ASKED=2, STRIPES=5, DIGIT=3)
    assert got == brute(rows, 256, 5, 10, 30, 90) and len(got) > 100


def test_digits_tell_every_score():
    for low, high in ((0, 0), (-5, 9), (-(10**30), 10**30), (3, 4099), (0, 4095), (0, 4096)):
        for score in {low, high, (low + high) // 2, low + (high - low) // 3}:
            path = []
            for _ in range(negatives.rounds(low, high)):
                span = negatives.Span(low, high, path)
                assert span.low <= score <= span.high
                digit = int(negatives.Span(low, high, path).digits(negatives.np.array([score], object))[0])
                assert 0 <= digit < 1 << negatives.DIGIT
                path.append(digit)
            assert negatives.Span(low, high, path).high == score


def test_huge_components(spark):
    rows = [(k * 50, [3e38 if k % 3 else 2e38, float(k)], k % 2) for k in range(8)] + [(1, [1e30, 1.0], 0), (2, [2.0, 1.0], 1)]
    assert mined(spark, rows) == brute(rows, 256, 5, 10, 30, 90) != []


def test_empty_and_lonely(spark):
    assert mined(spark, []) == [] and mined(spark, [(0, [1.0], 1)]) == []
    assert mined(spark, [(0, [1.0], 1), (1, [1.0], 1), (2, [0.5], 2)]) == [(0, 1, 1, 2, 65536, 32768)]
