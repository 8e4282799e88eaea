"""Phrases against plain Python: pieces, languages, ties, nested phrases, small filters and automata."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from locus.llm import phrases


def brute(rows, least, nested, top):
    counts, total = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            w = tuple(x for x in re.split("[ \t]+", piece) if x)
            total[lang] += len(w)
            for n in (1, 2, 3):
                counts.update((lang, w[k : k + n]) for k in range(len(w) - n + 1))
    out = {}
    for (lang, p), a in counts.items():
        if len(p) == 1 or a < least or any(q[:2] == p or q[1:] == p for (m, q), f in counts.items() if m == lang and len(q) == 3 and len(p) == 2 and f >= least and 100 * f >= nested * a):
            continue
        score, _, left, right = min((10**6 * a * a // (counts[lang, p[:k]] * counts[lang, p[k:]]), k, counts[lang, p[:k]], counts[lang, p[k:]]) for k in range(1, len(p)))
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), left, right))
    return {(lang, k, p.decode(), -a, left, right, total[lang], -s) for lang, found in out.items() for k, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1)}


def corpus(seed=3):
    rng = random.Random(seed)
    vocab = ["the", "The", "of", "a", "é", "über", "x y", "-", "日本", "|", "a|b"] + [rng.choice("bcdf") + rng.choice("aei") for _ in range(12)]
    rows = []
    for _ in range(60):
        words = rng.choices(vocab, k=rng.randint(0, 60))
        if rng.random() < 0.5:
            words[3:3] = ["New", "york", "City"]
        rows.append((rng.choice([" ", "  ", "\t"]).join(w + rng.choice(["", "", "", ".", ", ", "\n", "!?"]) for w in words), rng.choice(["en", "en", "de", None, ""])))
    return rows + [(None, "en"), ("", None), ("the the the the the the the", "en"), (" a. b ", "zz"), ("...", "en"), (rows[0][0], rows[0][1])] + [("red red red fox", "fr")] * 15


def mined(spark, rows, **more):
    frame = spark.createDataFrame(rows, "text string, lang string").selectExpr("*", "1 as phrase", "'x' as counter", "2L as doc_id").repartition(4)
    return {tuple(r) for r in phrases.collocations(frame, **more).collect()}


def test_against_brute_force(spark):
    rows = corpus()
    got = mined(spark, rows, least=4)
    assert got == brute(rows, 4, 50, 2000) and len(got) > 20


def test_small_slices_filters_and_automata(spark, monkeypatch):
    rows = corpus(5)
    for name, value in (("SLICE_BYTES", 300), ("SHARD", 7), ("LEAST_BITS", 64), ("MAX_BITS", 256)):
        monkeypatch.setattr(phrases, name, value)
    assert mined(spark, rows, least=3, nested=80, top=20) == brute(rows, 3, 80, 20)


def test_empty_and_long_texts(spark):
    assert mined(spark, []) == set() and mined(spark, [(None, None), ("a b c", "en")]) == set()
    rows = [("w" * 50_000 + " v", "en")] * 12 + [("ab " * 40_000, "en")]
    assert mined(spark, rows) == brute(rows, 10, 50, 2000)


def test_products_beyond_64_bits(spark, tmp_path):
    many = 5_000_000_000
    counts = spark.createDataFrame([("en", "", 0, 4 * many), ("en", "a", 1, many + 1), ("en", "b", 1, many + 7), ("en", "a b", 2, many)], "lang string, phrase string, size int, count long")
    (row,) = phrases.scored(counts, 50, f"file://{tmp_path}/x").collect()
    assert row.score == 10**6 * many * many // ((many + 1) * (many + 7)) and row.n == 4 * many


def test_filter_holds_what_is_put_in(spark):
    found = np.random.default_rng(1).integers(0, 2**64, 5000, dtype=np.uint64)
    kept = phrases.filter_of(spark.createDataFrame(pa.table({"counter": found.view(np.int64)})))
    assert kept.holds(found).all() and kept.holds(found ^ np.uint64(1 << 50)).mean() < 0.1
