"""Patterns and agreement against plain Python."""

import random

import pytest

from locus.operators import agreement, patterns
from locus.operators.patterns import Step


def brute(events, steps, gap, forbidden):
    out, by = [], {}
    for e in sorted(events, key=lambda e: (e[3], e[0])):
        by.setdefault(e[1], []).append(e)
    for who, own in by.items():
        for i, first in enumerate(own):
            if first[2] != steps[0].code:
                continue
            k, last, n, at = 0, first, 1, i
            while True:
                meant = patterns._meant(steps, k)
                later = next(((j, e) for j, e in enumerate(own[at + 1 :], at + 1) if e[2] in meant or e[2] in forbidden), None) if meant else None
                if later is None or later[1][3] - last[3] > gap or later[1][2] in forbidden:
                    if all(s.optional for s in steps[k + 1 :]):
                        out.append((who, first[0], last[0], first[3], last[3], n))
                    break
                at, last = later
                k, n = meant[last[2]], n + 1
    return sorted(out)


@pytest.mark.parametrize("steps, forbidden", [
    ([Step("a"), Step("b"), Step("c")], ()), ([Step("a"), Step("b"), Step("c")], ("x",)), ([Step("a"), Step("b", optional=True), Step("c")], ()), ([Step("a", repeat=True), Step("b")], ("x",)),
    ([Step("a"), Step("b", repeat=True), Step("c", optional=True)], ()), ([Step("a")], ()), ([Step("a"), Step("a"), Step("a")], ()), ([Step("a"), Step("b", optional=True, repeat=True), Step("c", optional=True)], ("x",)),
])
def test_patterns_against_brute_force(spark, steps, forbidden):
    rng = random.Random(len(steps) + len(forbidden))
    events = [(k, rng.randrange(4), rng.choice("abcxy"), rng.randrange(-50, 900)) for k in range(400)]
    frame = spark.createDataFrame(events, "id long, participant long, code string, t long")
    got = sorted(map(tuple, patterns.match(frame, steps, 30, forbidden, width=40).select("participant", "start_id", "end_id", "start", "end", "events").collect()))
    assert got == brute(events, steps, 30, forbidden) and got


def test_patterns_of_nothing(spark):
    none = spark.createDataFrame([], "id long, participant long, code string, t long")
    assert patterns.match(none, [Step("a"), Step("b")], 5).count() == 0
    for steps, forbidden in (([], ()), ([Step("a", optional=True)], ()), ([Step("a")], ("a",))):
        with pytest.raises(ValueError):
            patterns.match(none, steps, 5, forbidden)


def brute_alpha(ratings, distance):
    units = {}
    for u, _, v in ratings:
        if v is not None:
            units.setdefault(u, []).append(v)
    units = [v for v in units.values() if len(v) > 1]
    every = [x for v in units for x in v]
    n = len(every)
    observed = sum(sum(distance(a, b) for i, a in enumerate(v) for j, b in enumerate(v) if i != j) / (len(v) - 1) for v in units) / n
    expected = sum(distance(a, b) for i, a in enumerate(every) for j, b in enumerate(every) if i != j) / (n * (n - 1))
    return 1 - observed / expected


def test_alpha_of_many_raters(spark):
    # A published example: four raters, twelve units, ratings missing; nominal 0.743, interval 0.849.
    a, b, c, d = [1, 2, 3, 3, 2, 1, 4, 1, 2, None, None, None], [1, 2, 3, 3, 2, 2, 4, 1, 2, 5, None, 3], [None, 3, 3, 3, 2, 3, 4, 2, 2, 5, 1, None], [1, 2, 3, 3, 2, 4, 4, 1, 2, 5, 1, None]
    ratings = [(u, r, v) for r, row in enumerate((a, b, c, d)) for u, v in enumerate(row)]
    frame = spark.createDataFrame(ratings, "unit int, rater int, value int")
    for level, distance, known in (("nominal", lambda x, y: float(x != y), 0.743), ("interval", lambda x, y: (x - y) ** 2, 0.849), ("ratio", lambda x, y: ((x - y) / (x + y)) ** 2, None)):
        (row,) = agreement.alpha(frame, level=level).collect()
        assert abs(row.alpha - brute_alpha(ratings, distance)) < 1e-9 and row.pairable == 40
        assert known is None or abs(row.alpha - known) < 1e-3
    (same,) = agreement.alpha(frame.where("value = 1")).collect()
    assert same.alpha is None
    assert agreement.alpha(frame.limit(0)).first().alpha is None
