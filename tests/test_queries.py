"""Every query with an oracle against DuckDB over the smallest tables."""

import functools
import hashlib
import operator
import os

import duckdb
import pandas as pd
import pytest

from locus import registry

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{FOLDER}/{f}'")
    return con


def rows(frame):
    columns = sorted(frame.columns)
    kept = frame[columns].astype(object)
    return columns, sorted(map(repr, (tuple(None if pd.isna(v) else float(v) if isinstance(v, (int, float)) or hasattr(v, "item") else v for v in r) for r in kept.values.tolist())))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_oracle(spark, duck, name):
    ours = registry.queries()[name](spark, FOLDER).toPandas()
    assert rows(ours) == rows(duck.sql(registry.oracle_sql()[name]).df()) and len(ours)


def test_roundtrip_diff_sees_what_a_step_loses(spark, monkeypatch):
    whole = registry.text_formats.parse_sam
    monkeypatch.setattr(registry.text_formats, "parse_sam", lambda lines: whole(lines).where("position <> 7"))
    lost = registry.P.reads(spark, FOLDER).where("position = 7").count()
    assert registry.roundtrip_diff(spark, FOLDER).first().different == lost > 0


def test_checksum_values_against_brute_force(spark):
    columns = ["position", "span", "mapq", "flag", "l_orderkey", "l_linenumber"]
    chunks = {}
    for r in registry.P.reads(spark, FOLDER).select("reference", "chunk_start", *columns).collect():
        h = int(hashlib.md5("\t".join(str(r[c]) for c in columns).encode()).hexdigest()[:15], 16)
        chunks.setdefault((r.reference, r.chunk_start), []).append(h)
    want = {k: (len(h), hashlib.sha256(f"{len(h)}:{functools.reduce(operator.xor, h)}:{sum(h)}".encode()).hexdigest()) for k, h in chunks.items()}
    got = {(r.reference, r.chunk_start): (r.reads, r.checksum) for r in registry.chunk_checksum_values(spark, FOLDER).collect()}
    assert got == want and len(want) > 1


def test_sketches_are_near_the_exact_numbers(spark, duck):
    got = registry.site_sketch(spark, FOLDER).first()
    exact = duck.sql("SELECT count(DISTINCT l_partkey), count(DISTINCT l_suppkey), median(l_partkey) FROM lineitem WHERE l_linenumber % 3 <> 0").fetchall()[0]
    assert all(abs(a - b) <= 0.05 * b for a, b in zip(got, exact, strict=True))


def test_entry_needs_no_optional_part(spark):
    import __spark_entry__

    assert set(registry.queries()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0
