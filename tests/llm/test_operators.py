"""Each operator against a brute-force version, with nulls, empty and long texts, ties, repeated rows, empty tables and extra columns."""

import hashlib
import random
import re
import time
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from locus.llm import chat, components, decontaminate, pieces, pii, quality, sharding, simjoin, substrings, textops, tokencount, topk, vocabulary

SPLIT = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def corpus(seed=7):
    """Texts with exact and near copies, shared passages, periodic and very long ones, nulls and blanks."""
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdéñ") for _ in range(rng.randint(1, 5))) for _ in range(60)] + ["The", "the", "a"]

    def text(n):
        return [rng.choice(vocab) for _ in range(n)]

    passage = text(30)
    out = [None, "", " \n\t", "one", "One", "a b c", "A b  c", "x " * 70, "x y " * 40, "x y z w v " * 30, " ".join(text(6000))]
    for _ in range(12):
        base = text(rng.randint(5, 90))
        for k in range(rng.randint(1, 5)):
            copy = list(base)
            for _ in range(k):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            out.append(rng.choice([" ", "\n", "  "]).join(copy))
    out += [" ".join(text(20) + passage + text(rng.randint(0, 20))) for _ in range(6)]
    out += [out[12], out[13], out[20]]
    rng.shuffle(out)
    return [(k, t) for k, t in enumerate(out)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = corpus()
    frame = spark.createDataFrame([(k, t, "spare", k * 2) for k, t in rows], "doc_id long, text string, lang string, n_chars long").repartition(3)
    return dict(rows), frame


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, n_chars long")


def shingles(text):
    w = SPLIT.findall((text or "").translate(LOWER))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_classes(rows):
    sets = {k: shingles(t) for k, t in rows.items()}
    parent = {k: k for k in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in rows:
        for b in rows:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {k: (len(sets[k]), root(k)) for k in rows}


def test_join_classes(docs, empty):
    rows, frame = docs
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in simjoin.jaccard_classes(frame).collect()}
    assert got == brute_classes(rows)
    assert simjoin.jaccard_classes(empty).count() == 0


def test_join_trees_lose_no_pair(spark):
    # Chains in which no pivot links with all: the trees must find the rest.
    rng = random.Random(3)
    base, rows = [f"w{k}" for k in range(80)], {}
    for k in range(70):
        rows[k] = " ".join(base)
        base[rng.randrange(80)] = f"v{k}"
    frame = spark.createDataFrame([(k, t) for k, t in rows.items()], "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in simjoin.jaccard_classes(frame).collect()}
    assert got == brute_classes(rows)


def test_join_crowd_of_copies(spark):
    # Copies that are nearer to their source than to each other, some of them too far from it.
    rng = random.Random(11)
    base, rows = [f"w{k}" for k in range(90)], {}
    for k in range(120):
        copy = list(base)
        for _ in range(rng.randrange(6)):
            copy[rng.randrange(90)] = f"v{rng.randrange(400)}"
        rows[k] = " ".join(copy)
    frame = spark.createDataFrame([(k, t) for k, t in rows.items()], "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in simjoin.jaccard_classes(frame).collect()}
    assert got == brute_classes(rows)


def test_trees_lose_no_link():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 400, 120, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for _ in range(290)]
    sets += [np.unique(np.concatenate((s[: len(s) - 3], rng.integers(0, 2**60, 3, dtype=np.uint64)))) for s in sets[:60]]
    n, tree = np.array([len(s) for s in sets]), rng.integers(0, 3, len(sets))
    tree[5:8] = 7
    v = simjoin.vectors([simjoin.count_vector(s) for s in sets], n)
    for group in (np.arange(len(sets)), np.arange(len(sets)) % 5, np.zeros(len(sets), int)):
        found = {tuple(sorted(p)) for p in zip(*(x.tolist() for x in simjoin.RTrees(v, n, group, tree).pairs()), strict=True)}
        assert all(tree[a] == tree[b] and group[a] != group[b] for a, b in found)
        for a in range(len(sets)):
            for b in range(a):
                both = len(np.intersect1d(sets[a], sets[b]))
                if tree[a] == tree[b] and group[a] != group[b] and 100 * both >= 75 * (n[a] + n[b] - both):
                    assert (b, a) in found


def test_frequency_table_sums_all_tasks(spark):
    rows = [(k, f"always the same five words {k % 7}" if k % 2 else f"x{k} y{k} z{k} u{k} v{k} w{k}") for k in range(400)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(40)
    table = simjoin.frequency_table(simjoin.sketches(frame, b"").where("kind = 1"))
    import pyarrow as pa

    one = textops.shingle_sets(textops.Words(pa.array(["always the same five words"])))[0][0]
    assert table[int(one >> np.uint64(32)) & (simjoin.COUNTERS - 1)] and 1 <= table.sum() <= 20


def test_join_cuts_large_trees(spark, monkeypatch):
    # Trees of a few points count as large: blocks of the largest class, blocks of the rest, salted frequent shingles.
    for name, value in (("BLOCK", 8), ("LEAF", 3), ("FAN", 2), ("FOREST", 20), ("CELLS", 4096), ("BROADCAST_ROWS", 0)):
        monkeypatch.setattr(simjoin, name, value)
    monkeypatch.setattr(simjoin, "frequency_table", lambda strips: np.arange(simjoin.COUNTERS) % 2 == 0)
    rng, rows = random.Random(12), {}
    base = [f"w{k}" for k in range(90)]
    for k in range(150):
        copy = list(base)
        for _ in range(rng.randrange(9)):
            copy[rng.randrange(90)] = f"v{rng.randrange(400)}"
        rows[k] = " ".join(copy[: rng.randint(60, 90)])
    frame = spark.createDataFrame([(k, t) for k, t in rows.items()], "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in simjoin.jaccard_classes(frame).collect()}
    assert got == brute_classes(rows)


def test_exact_shingles():
    import pyarrow as pa

    texts = [t for _, t in corpus()] + ["a b c d", "A b c", "b c d", "a b c d e", "", "e a b c d e"]
    sets = textops.exact_shingle_sets(textops.Words(pa.array(texts)))
    names = {}
    for t, s in zip(texts, sets, strict=True):
        assert len(s) == len(set(s.tolist())) == len(shingles(t))
        assert len(names.setdefault(frozenset(s.tolist()), shingles(t))) == len(s)
    for a, s in zip(texts, sets, strict=True):
        for b, u in zip(texts[-12:], sets[-12:], strict=True):
            assert len(np.intersect1d(s, u)) == len(shingles(a) & shingles(b))


def test_join_null_ids_and_clashing_columns(spark):
    long = " ".join(f"w{k}" for k in range(30))
    rows = [(None, long), (None, long), (None, long + " x"), (4, "y " + long), (5, "other words"), (None, None), (6, "other words")]
    frame = spark.createDataFrame([(k, t, "s", 0) for k, t in rows], "doc_id long, text string, node string, n int")
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in simjoin.jaccard_classes(frame).collect())
    assert got == [(0, 0, 0), (0, 26, 4), (0, 26, 4), (0, 27, 4), (4, 27, 4), (5, 1, 5), (6, 1, 5)]


def test_components(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(1, 40)] + [(50, 60), (60, 70)], "a long, b long")
    got = {r.node: r["class"] for r in components.connected(links).collect()}
    assert got == {k: 1 for k in range(1, 41)} | {50: 50, 60: 50, 70: 50}


def brute_weight(vocab, s):
    t, best = s.replace("▁", "\0").replace(" ", "▁"), [(0, [])] + [None] * len(s)
    for e in range(1, len(s) + 1):
        for a in range(e - 1, max(-1, e - 1 - vocab.longest), -1):
            p = t[a:e]
            step = (vocab.weights[p], [vocab.ids[p]]) if p in vocab.weights else None
            if step is None and e - a == 1:
                raw = s[a:e].encode()
                step = (len(raw) * vocab.byte_weight, [vocab.byte_ids[b] for b in raw])
            if step and (best[e] is None or best[a][0] + step[0] <= best[e][0]):
                best[e] = (best[a][0] + step[0], best[a][1] + step[1])
    return best[-1]


@pytest.fixture(scope="module")
def vocab():
    return vocabulary.load()


ODD_TEXTS = ["a▁b", "  lead", "tail  ", "nul\0here", "\U0001f600 ok", "梦ゼ x", "日" * 40, " " * 45 + "z", "q" * 8000, "the" * 2500, "é▁" * 2000]


def test_token_counts(spark, docs, empty, vocab):
    rows, frame = docs
    rows = rows | {1000 + k: t for k, t in enumerate(ODD_TEXTS)}
    frame = spark.createDataFrame([(k, t, 0) for k, t in rows.items()], "doc_id long, text string, n_tokens long")
    got = {r.doc_id: (r.n_pretokens, r.n_tokens) for r in tokencount.count_tokens(frame, vocab).collect()}
    want = {k: (len(w := SPLIT.findall(t or "")), sum(len(brute_weight(vocab, " " + x)[1]) for x in w)) for k, t in rows.items()}
    assert got == want and tokencount.count_tokens(empty, vocab).count() == 0


def test_encoding(spark, docs, empty, vocab):
    rows = docs[0] | {1000 + k: t for k, t in enumerate(ODD_TEXTS)}
    frame = spark.createDataFrame([(k, t, "old") for k, t in rows.items()], "doc_id long, text string, ids string")
    coded = pieces.encode(frame, vocab)
    back = {r.doc_id: r for r in pieces.decode(coded, vocab).collect()}
    for k, t in rows.items():
        assert back[k].text == t
        if t is None:
            assert back[k].ids is None
            continue
        cuts = re.findall(" *[^ ]+| +", t)
        assert back[k].ids == [i for c in cuts for i in brute_weight(vocab, c)[1]]
    assert pieces.decode(pieces.encode(empty, vocab), vocab).count() == pieces.there_and_back(empty, vocab).count() == 0
    once = pieces.there_and_back(frame, vocab)
    assert once.columns == ["doc_id", "ids", "text"] and {r.doc_id: (r.ids, r.text) for r in once.collect()} == {k: (r.ids, r.text) for k, r in back.items()}


def test_long_words_in_steps(vocab, monkeypatch):
    rng = random.Random(3)
    words = ["".join(rng.choice(["the", "a", "ing", "日", "q", "é", "▁", "\U0001f600"]) for _ in range(rng.randint(1, 400))) for _ in range(30)]
    want = [brute_weight(vocab, " " + w)[1] for w in words]
    for size in (50, 333, 1 << 18):
        monkeypatch.setattr(pieces, "CHARACTERS", size)
        ids, at = pieces.Encoder(vocab).encode([" " + w for w in words])
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == want
    counter, order = tokencount.TrieCounter(vocab), sorted(range(len(words)), key=words.__getitem__)
    for size in (0, 20, 4096):
        monkeypatch.setattr(tokencount, "LONG", size)
        assert counter.counts([words[k] for k in order]) == [len(want[k]) for k in order]


BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def naive_spans(text):
    def fine(kind, s):
        d = re.sub("[^0-9]", "", s)
        if kind == "ip":
            return all(int(x) <= 255 for x in s.split("."))
        if kind == "card":
            return 13 <= len(d) <= 19 and sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(d[::-1])) % 10 == 0
        return kind != "phone" or 9 <= len(d) <= 15

    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, p in BASE.items() for m in p.finditer(text) if fine(k, m[0]))


def test_pii_base(spark, empty):
    rng = random.Random(11)
    pool = list("0123456789.@+-() ") + ["a", "b.c", "@x.y", "10.0.0.1", "4111 1111 1111 1111", "+1 (555) 010-9999", "é", "\n", "256.1.1.1"]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 60))) for _ in range(800)] + [None, "", "a@b@c.d@e.f", "1.2.3.4.5.6.7.8", "7" * 5000]
    frame = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, spans string")
    got = {r.doc_id: r for r in pii.detect(frame).collect()}
    for k, t in enumerate(texts):
        assert got[k].base_spans == naive_spans(t or ""), t
        assert set(filter(None, got[k].base_spans.split(","))) <= set(got[k].spans.split(","))
    assert pii.detect(empty).count() == 0


def test_pii_disguises():
    for text, kind, part in (
        ("write john (at) example [dot] com now", "email", "john (at) example [dot] com"),
        ("or john.doe at example dot com", "email", "john.doe at example dot com"),
        ("j​ohn@ex​ample.cоm", "email", "j​ohn@ex​ample.cоm"),
        ("call plus one four one five five five five two six seven one", "phone", "plus one four one five five five five two six seven one"),
        ("ip one nine two dot one six eight dot 0 dot 1 ok", "ip", "one nine two dot one six eight dot 0 dot 1"),
        ("４１１１ " * 1 + "1111 1111 1111", "card", "４１１１ 1111 1111 1111"),
    ):
        base, spans = pii.find_all(text)
        assert [text[a:b] for a, b in spans[kind]] == [part] and not any(base.values())
        assert part not in pii.mask_text(text) and f"<{kind.upper()}>" in pii.mask_text(text)
    for plain in ("they sat at one two three", "look at the dot", "one two three four", "at dot"):
        assert not any(pii.find_all(plain)[1].values()) and pii.mask_text(plain) == plain


def test_pii_disguises_of_which_the_plain_pass_sees_a_part():
    for text, kind in (("jоhn@example.com", "email"), ("john@example.cоm", "email"), ("+44 20 7946 0９58", "phone"), ("j\u200bohn@example.com", "email"), ("+44 20 7946 0９58 and jоhn@example.com", "phone")):
        base, spans = pii.find_all(text)
        whole = text.split(" and ")[0]
        assert (0, len(whole)) in spans[kind] and (0, len(whole)) not in base[kind]
        assert all(set(base[k]) <= set(spans[k]) for k in pii.KINDS)
        assert pii.mask_text(text) == f"<{kind.upper()}>" + (" and <EMAIL>" if " and " in text else "")
    assert pii.find_all("john@example.com jоe")[1]["email"] == [(0, 16)]


def test_pii_short_spelled_parts_and_at_before_a_domain():
    for part, kind in (
        ("4111 1111 1111 one one one one", "card"),
        ("four one one one 1111 1111 1111", "card"),
        ("4111-1111-1111-111one", None),
        ("+1 415 555 two six seven one", "phone"),
        ("+1 (415) five five five 2671", "phone"),
        ("192.168.one.one", "ip"),
        ("192 dot 168 dot one dot one", "ip"),
        ("john.smith at example.com", "email"),
        ("jsmith42 at mail.example.org", "email"),
        ("john at mail.example dot com", "email"),
        ("john at example [dot] com", "email"),
    ):
        text = f"write: {part}, please"
        assert [text[a:b] for a, b in pii.find_all(text)[1].get(kind, [])] == ([part] if kind else []), part
        assert pii.mask_text(text) == (f"write: <{kind.upper()}>, please" if kind else text)
    # A digit word before a number that the plain reading finds takes nothing away, with a disguised digit too.
    assert (4, 23) in pii.find_all("one 4111 1111 1111 1111")[1]["card"]
    assert (4, 23) in pii.find_all("one ４111 1111 1111 1111")[1]["card"]
    for plain in ("look at example.com", "they met at noon.Then one left", "see e.g. at example.com", "python3 at python.org", "one, 2, three, 4, five", "room 12 one flight up", "chapter one.two", "version 2 one at a time"):
        assert not any(pii.find_all(plain)[1].values()) and pii.mask_text(plain) == plain


def test_pii_is_linear_in_long_runs():
    n = 1_000_000
    for text in ("x dot y" + " " * n, "a dot b(" + " " * n, "a dot b" + "( " * (n // 2), "one two-" + "-" * n, "one " + "1" * n, "a dot b at " + "x." * (n // 2), "a dot b " + "a" * n + "@", "one two " + "+1((((((" * (n // 8), "a@b.c j\u043ehn@b.c " * (n // 20)):
        began = time.process_time()
        pii.find_all(text)
        assert time.process_time() - began < 20, text[:20]


def test_pii_spaced_disguises():
    for text in ("john   [at]   example  (dot)  com", "john(at) example[.]com", "john [at] example [dot] org [dot] uk", "see  john {at}example <dot>com."):
        spans = pii.find_all(text)[1]["email"]
        assert len(spans) == 1 and text[spans[0][0] : spans[0][1]].startswith("john") and text[spans[0][0] : spans[0][1]].endswith(("com", "uk"))


def test_pii_mask_keeps_rows(spark, empty):
    frame = spark.createDataFrame([(1, None, "k"), (2, "a@b.cd", "k"), (2, "a@b.cd", "k")], "doc_id long, text string, more string")
    assert sorted(map(str, pii.mask(frame).collect())) == sorted(map(str, spark.createDataFrame([(1, None, "k"), (2, "<EMAIL>", "k"), (2, "<EMAIL>", "k")], frame.schema).collect()))
    assert pii.mask(empty).count() == 0


def test_decontamination(spark, docs, empty):
    rows, frame = docs
    rng = random.Random(2)
    items = {k: " ".join(SPLIT.findall(rows[d])[a : a + n]).upper() for k, (d, a, n) in enumerate((d, rng.randint(0, 9), rng.randint(1, 40)) for d in rows if len(SPLIT.findall(rows[d] or "")) > 30)}
    items |= {900: None, 901: "", 902: "the", 903: "nowhere to be found at all here", 904: items[0]}
    listed = spark.createDataFrame([(k, t, "x") for k, t in items.items()], "item_id long, text string, doc_id string")

    def contained(doc, item):
        w = SPLIT.findall((item or "").translate(LOWER))
        size = min(5, len(w))
        d = SPLIT.findall((doc or "").translate(LOWER))
        a = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if w else set()
        b = {tuple(d[k : k + size]) for k in range(len(d) - size + 1)} if size else set()
        return (len(a & b), len(a)) if a and 100 * len(a & b) >= 75 * len(a) else None

    want = {(d, k): c for d, t in rows.items() for k, i in items.items() if (c := contained(t, i))}
    got = {(r.doc_id, r.item_id): (r.n_shared, r.n_item) for r in decontaminate.contained(frame, listed).collect()}
    assert got == want and want
    clean = {r.doc_id for r in decontaminate.clean(frame, listed).collect()}
    assert clean == set(rows) - {d for d, _ in want}
    assert decontaminate.contained(empty, listed).count() == 0 and decontaminate.contained(frame, listed.limit(0)).count() == 0


def test_decontamination_cleans_rows_not_ids(spark):
    leak = "what is the capital of the country that has two rivers"
    rows = [(None, leak), (None, "a clean text without an id"), (7, "so: " + leak), (7, "a clean text of a shared id"), (8, None), (None, None), (9, leak.upper())]
    listed = spark.createDataFrame([(1, leak)], "item_id long, text string")
    got = decontaminate.clean(spark.createDataFrame(rows, "doc_id long, text string"), listed).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [rows[1], rows[3], rows[4], rows[5]]))


def test_decontamination_beyond_broadcasts(spark, docs, monkeypatch):
    rows, frame = docs
    listed = spark.createDataFrame([(k, t) for k, t in rows.items() if t and len(t) < 300] + [(None, "one two three four five six")], "item_id long, text string")
    few = {tuple(r) for r in decontaminate.contained(frame, listed).collect()}
    assert few and all(r[1] is not None for r in few)
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    assert {tuple(r) for r in decontaminate.contained(frame, listed).collect()} == few


def brute_removed(rows, size):
    seen, out = set(), {}
    for k in sorted(rows):
        w = SPLIT.findall(rows[k] or "")
        gone = [False] * len(w)
        for p in range(len(w) - size + 1):
            window = tuple(w[p : p + size])
            if window in seen:
                gone[p : p + size] = [True] * size
            seen.add(window)
        out[k] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g))
    return out


def test_substring_dedup(spark, docs, empty):
    rows, frame = docs
    for size in (20, 6):
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substrings.remove_repeats(frame, size).collect()}
        assert got == brute_removed(rows, size)
    assert substrings.remove_repeats(empty).count() == 0


def test_substring_dedup_repeated_rows_and_null_ids(spark):
    long = " ".join(f"w{k}" for k in range(30))
    frame = spark.createDataFrame([(1, long), (1, long), (2, long), (None, "x " + long)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_removed) for r in substrings.remove_repeats(frame).collect())
    assert got == [(0, 0), (1, 30), (1, 30), (2, 30)]


def test_substring_dedup_of_a_hot_line_and_of_rows_without_ids(spark, monkeypatch):
    rng = random.Random(5)
    line, rows = " ".join(f"h{k}" for k in range(25)), {}
    for k in range(300):
        own = " ".join(f"{k}.{j}" for j in range(rng.randint(1, 30)))
        rows[k] = rng.choice([own, f"{own} {line}", f"{line} {own} {line}", line])
    frame = spark.createDataFrame([(k, t, "x", 1) for k, t in rows.items()], "doc_id long, text string, doc string, row int").repartition(6)
    for step, hot in ((1 << 21, 10_000), (700, 10_000), (700, 3), (150, 2)):
        monkeypatch.setattr(substrings, "HOT", hot)
        monkeypatch.setattr(substrings, "SLICE_BYTES", step)
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substrings.remove_repeats(frame).collect()}
        assert got == brute_removed(rows, 20)
    # Rows without an id are one document that comes first; each keeps its own text.
    nulls = spark.createDataFrame([(None, line + " a"), (None, "b c " + line), (None, "other"), (3, line)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in substrings.remove_repeats(nulls).collect())
    assert got == [(0, 1, 0), (0, 26, 0), (0, 27, 25), (3, 25, 25)]


def test_judge_across_batches():
    rng = np.random.default_rng(1)
    n = 400
    name = np.sort(rng.integers(0, 6, n))
    doc, place = np.repeat(np.arange(n // 4), 4), np.tile(np.arange(4), n // 4)
    window = rng.integers(0, 40, n).astype(np.uint64)
    whole = substrings.Judge().repeats(name, doc, place, window)
    parts, judge = [], substrings.Judge()
    for a in range(0, n, 37):
        s = slice(a, a + 37)
        parts.append(judge.repeats(name[s], doc[s], place[s], window[s]))
    assert (np.concatenate(parts) == whole).all()


def test_topk(spark):
    rng = np.random.default_rng(4)
    vectors = [(k, [float(x) for x in rng.normal(0, 0.3, 9)]) for k in range(120)]
    vectors += [(200 + k, vectors[3][1]) for k in range(30)] + [(300, None), (301, [float("nan")] * 9), (302, [None] + [0.1] * 8), (None, [0.1] * 9), (304, [5.0, -7.25]), (305, [])]
    frame = spark.createDataFrame([(k, v, 1) for k, v in vectors], "vec_id long, embedding array<float>, score int").repartition(5)
    frame = frame.withColumns({c: F.lit("old") for c in ("q", "rank", "stripe", "order_key", "ids")})
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(frame, frame.where("vec_id % 20 = 0"), 20).collect())
    q = {k: np.floor(64 * np.pad(np.array(v, np.float32).astype(float), (0, 9 - len(v)))).astype(int) for k, v in vectors if k is not None and v is not None and None not in v and np.isfinite(v).all()}
    want = []
    for a in (k for k in q if k % 20 == 0):
        best = sorted((-int(q[a] @ q[b]), b) for b in q if b != a)[:20]
        want += [(a, r, b, -s) for r, (s, b) in enumerate(best, 1)]
    assert got == sorted(want)
    assert topk.top_k(frame.limit(0), frame.limit(0)).count() == 0


def test_topk_takes_components_of_any_size(spark):
    # One row beyond each power, ragged lengths, scores beyond 64 bits and repeated ids.
    vectors = [(0, [1.0, 2.0**24]), (1, [2.0**24, 0.0]), (2, [2.0**24 + 2, -1.0]), (3, [-(2.0**40), 5.0]), (4, [3.0]), (5, [2.0**70, 1.0, 1.0]), (6, [0.5, 2.0**100]), (20, [-(2.0**24), 1e-3, 7.0]), (7, []), (7, [1.0]), (20, [0.0]), (40, [2.0**70, -(2.0**90)])]
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").repartition(3)
    whole = {}
    for k, v in vectors:
        whole.setdefault(k, []).append([int(np.floor(64 * x)) for x in v])

    def product(a, b):
        return sum(x * y for x, y in zip(a, b))

    got = {}
    for r in topk.top_k(frame, frame.where("vec_id % 20 = 0"), 4).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    for k in (0, 20, 40):
        best = sorted((-product(min(whole[k]), row), b) for b, rows in whole.items() if b != k for row in rows)[:4]
        assert sorted(got[k]) == [(n, b, -s if -(2**63) <= -s < 2**63 else None) for n, (s, b) in enumerate(best, 1)]


def test_sliced_rows_against_plain_sums():
    rng = np.random.default_rng(1)
    for size in (1, 3, 60, 2**24, 2**40, 2**70):
        for rows in (1, 63, 64, 150):
            q = topk.integers(np.floor(rng.normal(0, size, (rows, 5))))
            v = topk.integers(np.floor(rng.normal(0, size, (1, 5))))[0]
            slices, base = topk.SlicedRows(q).scores(v)
            want = [sum(int(a) * int(b) for a, b in zip(row, v, strict=True)) for row in q]
            assert topk.values_at(slices, np.arange(rows), base) == want
            assert sorted(want) == sorted(want, key=topk.order_key)
            able = rng.random(rows) < 0.8
            best = sorted((-want[r], r) for r in range(rows) if able[r])[:20]
            assert topk.select(slices, topk.bitmap(able[:, None])[0], 20).tolist() == sorted(r for _, r in best)


def test_chat_reads_back(spark):
    nasty = ["\\### Assistant: </turn> ok", "<+>", "a<", "+>b", "</turn", "\\0\\1", "### ", "", None, "x\n</turn>\n", ": ", "é" * 9]
    rng = random.Random(9)
    rows = [(c, t, rng.choice(["user", "assistant", "sys: tem", None]), rng.choice(nasty), c) for c in range(30) for t in range(rng.randint(1, 9))]
    rows += [(40, 1, "assistant", "b", 0), (40, 1, "assistant", "b", 0), (40, None, "user", "z", 0), (None, 1, "user", "n", 0)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, segments long")
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(frame)).collect()}
    talks = defaultdict(list)
    for c, t, role, text, _ in rows:
        talks[c].append((t is not None, t or 0, role or "", text or ""))
    assert set(got) == set(talks)
    for c, turns in talks.items():
        turns.sort()
        assert [tuple(t) for t in got[c].turns] == [t[2:] for t in turns]
        assert got[c].loss_text == "".join(t[3] for t in turns if t[2] == "assistant")
    merged = chat.format_conversations(frame.where("conv_id = 40")).first().formatted
    assert merged == "### user: z</turn>\n### assistant: b<+>b</turn>\n"
    assert chat.format_conversations(frame.limit(0)).count() == 0


def test_best_fit_decreasing():
    rng = random.Random(6)
    for _ in range(30):
        sizes = [rng.randint(1, 40) for _ in range(rng.randint(0, 60))]
        left, want = [], [0] * len(sizes)
        for k in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
            fits = [(room, b) for b, room in enumerate(left) if room >= sizes[k]]
            if fits:
                room = min(fits)[0]
            else:
                left.append(50)
                room = 50
            got = sharding.best_fit_decreasing(sizes, 50)
            b = got[k] if fits else len(left) - 1
            assert left[b] == room
            left[b] -= sizes[k]
            want[k] = b
        assert sharding.best_fit_decreasing(sizes, 50) == want


def test_sharding(spark, docs, empty):
    rows, frame = docs
    got = sharding.shard_by_bytes(frame, 4).collect()
    import zlib

    home = {}
    for r in got:
        text = (rows[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32) == (len(text) + 1, zlib.crc32(text))
        assert home.setdefault(text, r.shard) == r.shard
    for s in range(4):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    assert sorted(r.doc_id for r in got) == sorted(rows) and sharding.shard_by_bytes(empty).count() == 0


def test_sharding_crates(spark, monkeypatch):
    monkeypatch.setattr(sharding, "LARGE", 2)
    monkeypatch.setattr(sharding, "CRATES", 20)
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 100)
    frame = spark.createDataFrame([(k, f"text {k % 700}") for k in range(900)] + [(1000 + k, "common " * 20) for k in range(60)], "doc_id long, text string").withColumns({c: F.lit(1) for c in ("size", "shard", "slot", "row", "item", "bucket")})
    got = sharding.shard_by_bytes(frame, 8).groupBy("shard").agg(F.sum("size").alias("bytes"), F.max("slot").alias("last"), F.countDistinct("slot").alias("n")).collect()
    assert all(r.last + 1 == r.n for r in got) and len(got) == 8
    rest = sorted(r.bytes for r in got)[:-1]
    assert rest[-1] - rest[0] < 0.15 * rest[-1]


def test_sharding_of_repeated_rows(spark):
    frame = spark.createDataFrame([(7, "same")] * 200 + [(None, None)] * 50 + [(k, f"text {k}") for k in range(100, 400)], "doc_id long, text string")
    got = sharding.shard_by_bytes(frame, 4).collect()
    assert len(got) == 550 and len({r.shard for r in got if r.doc_id == 7}) == 1 and all(r["size"] == 1 for r in got if r.doc_id is None)
    for s in range(4):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))


def naive_features(text):
    raw, words = (text or "").encode(), SPLIT.findall((text or "").translate(LOWER))
    sets = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:?'\"()-", b"!", b"|", b"#$%&*", b"@=+<>{}[]\\/^~_`", b"\n\r", b" \t\x0b\x0c", bytes(range(128, 256)), bytes([*range(9), *range(14, 32), 127])]
    size, n = max(len(raw), 1), max(len(words), 1)
    bytes_of = [len(w.encode()) for w in words]
    pairs = list(zip(words, words[1:], strict=False))
    return [
        np.log1p(len(raw)), np.log1p(len(words)), sum(bytes_of) / n, *(sum(b in s for b in raw) / size for s in sets),
        sum(b <= 3 for b in bytes_of) / n, sum(b >= 13 for b in bytes_of) / n,
        len(set(words)) / n, len(set(pairs)) / len(pairs) if pairs else len(words), max(map(words.count, words), default=0) / n,
        np.log1p(len(words) / (sum(b in b"\n\r" for b in raw) + 1)), len(set(raw)),
    ]


def test_quality_features_and_scores_against_plain_sums():
    import pyarrow as pa

    texts = [t if t is None else t[:2000] for _, t in corpus()] + ["A!b|c #1\n\tx=y \x01\x7f", "one"]
    x = quality.features(pa.array(texts))
    assert x.shape[1] == len(quality.FEATURES)
    np.testing.assert_allclose(x, np.array([naive_features(t) for t in texts], float), rtol=1e-9)
    y = np.array([len(t or "") % 2 for t in texts], float)
    model = quality.fit(x, y, rounds=5, pair_rounds=3)
    for row, score in zip(x, model.score(x), strict=True):
        b = [int(np.searchsorted(e, v, "right")) for e, v in zip(model.edges, row, strict=True)]
        total = model.intercept + sum(t[k] for t, k in zip(model.tables, b, strict=True)) + sum(t[b[i], b[j]] for (i, j), t in model.pairs.items())
        assert abs(score - 1 / (1 + np.exp(-total))) < 1e-12
    assert len(model.pairs) == 8


def test_quality_takes_the_least_of_several_labels(spark):
    frame = spark.createDataFrame([(k, "good plain words " * (k % 9)) for k in range(100)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, v) for k in range(100) for v in (k % 2, 1)], "doc_id long, quality int")
    clean = spark.createDataFrame([(k, k % 2) for k in range(100)], "doc_id long, quality int")
    scores = [[r.score for r in quality.score(frame, quality.train(frame, x)).orderBy("doc_id").collect()] for x in (labels.repartition(5), labels, clean)]
    assert scores[0] == scores[1] == scores[2]


def test_quality(spark, docs, empty):
    rng = random.Random(8)
    good = [(k, " ".join(rng.choice(["plain", "words", "of", "prose"]) for _ in range(rng.randint(5, 60))) + ".") for k in range(150)]
    bad = [(k, " ".join(rng.choice(["BUY", "NOW!!", "$$$", "###"]) for _ in range(rng.randint(5, 60)))) for k in range(150, 300)]
    frame = spark.createDataFrame(good + bad + [(400, None), (401, ""), (None, "x" * 100_000)], "doc_id long, text string").withColumn("score", F.lit("old"))
    labels = spark.createDataFrame([(k, int(k < 150)) for k in range(300)] + [(400, None), (None, 1)], "doc_id long, quality int")
    got = quality.score(frame, quality.train(frame, labels)).withColumn("held", quality.held_out()).collect()
    assert len(got) == 303 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    held = [r for r in got if r.held and r.doc_id is not None and r.doc_id < 300]
    assert held and sum((r.score >= 0.5) == (r.doc_id < 150) for r in held) >= 0.95 * len(held)
    none = quality.train(frame, labels.limit(0))
    assert {r.score for r in quality.score(frame, none).collect()} == {0.5}
    assert quality.score(empty, none).count() == 0


def test_text_helpers():
    import pyarrow as pa

    from locus.llm.textops import Words, slices

    texts = ["a b", None, "", "  x\ty\x0b z ", "ÄA aé", "b"]
    words = Words(pa.array(texts))
    assert [bytes(words.bytes[a:b]).decode() for a, b in zip(words.start, words.end, strict=True)] == [w for t in texts for w in SPLIT.findall(t or "")]
    h = words.hashes(lower=True)
    assert h[0] == Words(pa.array(["A"])).hashes(lower=True)[0] != Words(pa.array(["A"])).hashes(lower=False)[0]
    batch = pa.RecordBatch.from_pydict({"text": texts})
    assert [t for b in slices(iter([batch]), step=4) for t in b.column(0).to_pylist()] == texts
    assert hashlib.sha256(b"").hexdigest() == pii.sha256_hex("")
