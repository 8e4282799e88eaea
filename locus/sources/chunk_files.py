"""Chunk files of older datasets: JSON arrays of records, and packed binary ones (plain or zstd)."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locus.functions.codecs import CIGAR_OPS, reference_span
from locus.functions.codecs import typed_tag as typed_value
from locus.sources.bam import typed_tag

#: Fixed values of the packed layout, little-endian: magic, version, flags, count, reserved; then for
#: each record its size, lengths of name, sequence, CIGAR and tags, and the fields after the name.
MAGIC, VERSION, ZSTD_FLAG = 0x42414D33, 0x0200, 1
_FILE, _RECORD, _PLACE = struct.Struct("<IHHII"), struct.Struct("<IHHHH"), struct.Struct("<iiBH")
_BASE = {1: "A", 2: "C", 4: "G", 8: "T"}
_PAIR = ["".join(_BASE.get(n, "N") for n in (b >> 4, b & 15)) for b in range(256)]
_CODE = {v: k for k, v in _BASE.items()} | {"N": 15}
_ZSTD_FRAME = b"\x28\xb5\x2f\xfd"
SCHEMA = "name string, flag int, reference_id int, position int, mapq int, cigar string, sequence string, quality string, tags map<string,string>"


def _decompressed(data: bytes) -> bytes:
    if data[:4] != _ZSTD_FRAME:
        return data
    import zstandard

    return zstandard.ZstdDecompressor().decompressobj().decompress(data)


def unpack(data: bytes) -> Iterator[tuple]:
    """The records of one packed chunk, in SCHEMA's order."""
    data = _decompressed(data)
    magic, version, _, count, _ = _FILE.unpack_from(data)
    if (magic, version) != (MAGIC, VERSION):
        raise ValueError(f"not a packed chunk of version {VERSION:#x}")
    view, at = memoryview(data), _FILE.size
    for _ in range(count):
        size, n_name, n_seq, n_cigar, n_tags = _RECORD.unpack_from(view, at)
        body = bytes(view[at + _RECORD.size : at + size])
        at += size
        name, rest = body[:n_name].decode(), body[n_name:]
        reference_id, position, mapq, flag = _PLACE.unpack_from(rest)
        rest = rest[_PLACE.size :]
        packed, rest = struct.unpack_from(f"<{n_cigar}I", rest), rest[4 * n_cigar :]
        half = (n_seq + 1) // 2
        sequence, quality, rest = "".join(_PAIR[b] for b in rest[:half])[:n_seq], rest[half : half + n_seq].decode("latin-1"), rest[half + n_seq :]
        tags = {t[:2].decode(): typed_tag(t[3:].decode()) for t in rest.split(b"\0")[:n_tags]}  # these files hold every tag as text
        yield name, flag, reference_id, position, mapq, "".join(f"{p >> 4}{CIGAR_OPS[p & 15]}" for p in packed) or None, sequence, quality, tags


def pack(records: list[tuple]) -> bytes:
    """The inverse of unpack, for tools that still read such files."""
    import re

    out = [_FILE.pack(MAGIC, VERSION, 0, len(records), 0)]
    for name, flag, reference_id, position, mapq, cigar, sequence, quality, tags in records:
        ops = [(int(n) << 4) | CIGAR_OPS.index(o) for n, o in re.findall(r"([0-9]+)([MIDNSHP=X])", cigar or "")]
        codes = [_CODE.get(c, 0) for c in sequence] + [0] * (len(sequence) % 2)
        body = name.encode() + _PLACE.pack(reference_id, position, mapq, flag) + struct.pack(f"<{len(ops)}I", *ops) + bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2])) + quality.encode("latin-1")
        body += b"".join(k.encode() + b"Z" + typed_tag(v)[2:].encode() + b"\0" for k, v in tags.items())
        out.append(_RECORD.pack(_RECORD.size + len(body), len(name.encode()), len(sequence), len(ops), len(tags)) + body)
    return b"".join(out)


_NAMES = [c.split()[0] for c in SCHEMA.replace("map<string,string>", "map").split(", ")]
#: The fields that older JSON chunks call otherwise.
_OLD_NAMES = {"reference_id": "ref", "position": "pos", "mapq": "mapping_quality", "sequence": "seq", "quality": "qual"}


def _from_json(data: bytes) -> Iterator[tuple]:
    import json

    for record in json.loads(_decompressed(data)):
        given = {n: record.get(n, record.get(_OLD_NAMES.get(n))) for n in _NAMES}
        yield tuple({k: typed_tag(str(v)) for k, v in (given["tags"] or {}).items()} if n == "tags" else given[n] for n in _NAMES)


def read_any(spark: SparkSession, path: str, pattern: str = "*.chunk") -> DataFrame:
    """Records of all chunk files under path whose names fit the pattern, packed or JSON, plain or compressed, as each file's first bytes say; a file is one record of the source, so a task holds one chunk."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).select("content")

    def records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                data = _decompressed(content)
                found = unpack(data) if data[:4] == MAGIC.to_bytes(4, "little") else _from_json(data)
                yield pd.DataFrame(list(found), columns=_NAMES)

    return files.mapInPandas(records, SCHEMA).withColumn("span", reference_span(F.col("cigar")).cast("int"))


def read_packed(spark: SparkSession, path: str) -> DataFrame:
    """Records of all packed chunk files under path; a file is one record of the source, so a task holds one chunk."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.chunk").load(path).select("path", "content")

    def records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                yield pd.DataFrame(list(unpack(content)), columns=_NAMES)

    return files.select("content").mapInPandas(records, SCHEMA).withColumn("span", reference_span(F.col("cigar")).cast("int"))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Records of JSON chunk files, under their old or new field names."""
    schema = "name string, flag int, reference_id int, ref int, position int, pos int, mapping_quality int, mapq int, cigar string, sequence string, seq string, quality string, qual string, tags map<string,string>"
    rows = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.chunk").json(path)
    either = [F.coalesce(F.col(new), F.col(old)).alias(out) for new, old, out in (("reference_id", "ref", "reference_id"), ("position", "pos", "position"), ("mapping_quality", "mapq", "mapq"))]
    texts = [F.coalesce(F.col(new), F.col(old)).alias(new) for new, old in (("sequence", "seq"), ("quality", "qual"))]
    return rows.select("name", "flag", *either, "cigar", *texts, F.transform_values("tags", lambda _, v: typed_value(v)).alias("tags")).withColumn("span", reference_span(F.col("cigar")).cast("int"))
