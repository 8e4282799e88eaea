"""Allele forms: random variants written in many ways have one normal form; sites split and merge."""

import random

from locus.operators import alleles


def apply(sequence, position, ref, alt):
    assert sequence[position : position + len(ref)].upper() == ref.upper()
    return sequence[:position] + alt.upper() + sequence[position + len(ref) :]


def test_normal_forms(spark):
    rng = random.Random(7)
    sequence = "".join(rng.choice(["A", "C", "AC", "ACG", "TTTTTT", "G", "GAGAGAGAGA"]) for _ in range(60))
    long = "C" + "A" * 500 + "G" * 20
    rows = []
    for k in range(300):
        reference, own = ("s", sequence) if k % 3 else ("long", long)
        at = rng.randrange(1, len(own) - 12)
        ref = own[at : at + rng.randint(1, 6)]
        alt = rng.choice([ref[:1], ref + rng.choice("ACGT"), ref[0] + own[at : at + 4], ref[:-1] or "T", rng.choice("ACGT"), ref + ref])
        if alt != ref:
            rows.append((k, reference, at, ref, alt))
    frame = spark.createDataFrame(rows, "id int, reference string, position long, ref string, alt string")
    chunks = alleles.sequence_chunks(spark.createDataFrame([("s", sequence.lower()), ("long", long)], "reference string, sequence string"), 16)
    got = {r.id: r for r in alleles.normalised(frame, chunks, 16).collect()}
    assert set(got) == {r[0] for r in rows}
    forms = {}
    for k, reference, at, ref, alt in rows:
        own, r = (sequence if reference == "s" else long), got[k]
        result = apply(own, at, ref, alt)
        assert apply(own, r.position, r.ref, r.alt) == result
        assert r.ref[-1] != r.alt[-1] or r.position == 0 or len(r.ref) == len(r.alt) == 1 or min(len(r.ref), len(r.alt)) > 1 and r.ref[-1] != r.alt[-1]
        assert r.ref[0] != r.alt[0] or min(len(r.ref), len(r.alt)) == 1
        if len(ref) != len(alt):
            # What gives the same sequence by a pure insertion or deletion has the same form.
            forms.setdefault((reference, result), set()).add((r.position, r.ref, r.alt) if min(len(r.ref), len(r.alt)) == 1 else None)
    assert all(len(f - {None}) <= 1 for f in forms.values()) and len(forms) > 50


def test_odd_alleles_stay(spark):
    rows = [(1, "s", 5, "A", "<DEL>"), (2, "gone", 5, "AT", "A"), (3, "s", 2, "A", "A"), (4, "s", None, "A", "T"), (5, "s", 3, "", "A"), (6, "s", 0, "CA", "C"), (7, "s", 1, "AA", "A")]
    frame = spark.createDataFrame(rows, "id int, reference string, position long, ref string, alt string")
    chunks = alleles.sequence_chunks(spark.createDataFrame([("s", "AAAAAA")], "reference string, sequence string"), 4)
    got = {r.id: (r.position, r.ref, r.alt) for r in alleles.normalised(frame, chunks, 4).collect()}
    assert got == {1: (5, "A", "<DEL>"), 2: (5, "AT", "A"), 3: (2, "A", "A"), 4: (None, "A", "T"), 5: (3, "", "A"), 6: (0, "CA", "C"), 7: (0, "AA", "A")}
    assert alleles.normalised(frame.limit(0), chunks, 4).count() == 0


def test_split_and_merge(spark):
    rows = [("c", 10, "AT", ["A", "G"], "s1", "1/2"), ("c", 10, "AT", ["A", "G"], "s2", "0|2"), ("c", 10, "AT", ["A", "G"], "s3", "./1"), ("c", 20, "A", ["C"], "s1", "1")]
    frame = spark.createDataFrame(rows, "reference string, position long, ref string, alts array<string>, sample string, genotype string")
    one = alleles.split(frame)
    assert {(r.position, r.alt, r.sample): r.genotype for r in one.collect()} == {
        (10, "A", "s1"): "1/0", (10, "G", "s1"): "0/1", (10, "A", "s2"): "0|0", (10, "G", "s2"): "0|1", (10, "A", "s3"): "./1", (10, "G", "s3"): "./0", (20, "C", "s1"): "1",
    }
    assert sorted(map(str, alleles.merge(one).select(frame.columns).collect())) == sorted(map(str, frame.collect()))
    # Two files with alleles of different reach at one place.
    two = spark.createDataFrame([("c", 10, "A", "G", "s1", "0/1"), ("c", 10, "ATT", "A", "s2", "1/1"), ("c", 10, "ATT", "A", "s1", "1/0")], "reference string, position long, ref string, alt string, sample string, genotype string")
    got = {r.sample: (r.ref, r.alts, r.genotype) for r in alleles.merge(two).collect()}
    assert got == {"s1": ("ATT", ["A", "GTT"], "1/2"), "s2": ("ATT", ["A", "GTT"], "1/1")}
    (line,) = alleles.vcf_lines(alleles.merge(two), ["s1", "s2", "s9"]).collect()
    assert line.value == "c\t11\t.\tATT\tA,GTT\t.\tPASS\t.\tGT\t1/2\t1/1\t0/0"
