"""Binary alignment files (BAM: records in BGZF blocks), read and written in splits.

A BGZF file is a row of small gzip members that all begin alike, so Spark's text
source, told to end its lines there, cuts such a file at any split into whole
members.  Records may reach over members and splits.  Each split looks for its
first record where several plausible ones follow one another, and gives away what
lies before it and what is left at its end.  Those pieces are put together per
file afterwards and must make whole records, so a wrong guess is an error and
never a wrong row.

Rows are as in text_formats.parse_sam, with reference_id besides.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locus.functions.codecs import CIGAR_OPS, TAG_FLOAT, TAG_INTEGER, TAG_TYPED, reference_span
from locus.sources import shared

#: How a BGZF member begins, the empty one that ends a file, the header's magic, a record's fixed fields, the 4-bit bases, tag types.
MEMBER = bytes.fromhex("1f8b08040000000000ff060042430200")
LAST = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
MAGIC = b"BAM\x01"
_FIXED = struct.Struct("<iiiBBHHHiiii")
BASES = "=ACMGRSVTWYHKDBN"
_BASE_OF_DIGIT = bytes.maketrans(b"0123456789abcdef", BASES.encode())
_DIGIT_OF_BASE = bytes(b"0123456789abcdef"[max(0, BASES.find(chr(c).upper()))] if chr(c).upper() in BASES else ord("0") for c in range(256))
_TO_TEXT, _TO_SCORE = bytes(min(255, q + 33) for q in range(256)), bytes(max(0, c - 33) for c in range(256))
_NUMBERS = {"c": "<b", "C": "<B", "s": "<h", "S": "<H", "i": "<i", "I": "<I", "f": "<f"}

SCHEMA = (
    "kind int, file string, split long, raw binary, name string, flag int, reference_id int, position int, mapq int, cigar string, "
    "mate_reference_id int, mate_position int, template_length int, sequence string, quality string, tags map<string,string>"
)
_NAMES = [f.split()[0] for f in SCHEMA.replace("map<string,string>", "map").split(", ")]
#: Payload of a member, and records in a row that tell the first one of a split.
PAYLOAD, RUN = 0xFF00, 4


def _members(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.option("encoding", "ISO-8859-1").option("lineSep", MEMBER.decode("latin-1")).text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.col("value").cast("binary").alias("member"))


def _inflated(member: bytes) -> bytes:
    """A member's data; member begins with its size field."""
    if not member:
        return b""
    if len(member) + len(MEMBER) != struct.unpack_from("<H", member)[0] + 1:
        raise ValueError("a BGZF member of another length than it says")
    return zlib.decompress(member[2:-8], -15)


def _header(data: bytes) -> tuple[str, list[tuple[str, int]], int] | None:
    """(text, references, length in bytes) of a header, None where data is too short."""
    try:
        text_size = struct.unpack_from("<i", data, 4)[0]
        at = 8 + text_size
        count, at, found = struct.unpack_from("<i", data, at)[0], at + 4, []
        for _ in range(count):
            size = struct.unpack_from("<i", data, at)[0]
            found.append((data[at + 4 : at + 3 + size].decode(), struct.unpack_from("<i", data, at + 4 + size)[0]))
            at += 8 + size
        return data[8 : 8 + text_size].rstrip(b"\0").decode(), found, at
    except struct.error:
        return None


def read_header(spark: SparkSession, path: str) -> tuple[str, list[tuple[str, int]]]:
    """The header text and (name, length) of the references, of the first file under path by name; only its first members are read."""
    first_file = spark.read.format("binaryFile").load(path).agg(F.min("path")).first()[0]
    if first_file is None:
        raise ValueError("no binary alignment file")
    members = _members(spark, first_file).select("member")
    k = 4
    while True:
        first = members.limit(k).collect()
        data = b"".join(_inflated(bytes(r.member)) for r in first)
        if data[: len(MAGIC)] != MAGIC[: len(data)]:
            raise ValueError("not a binary alignment file")
        found = _header(data)
        if found:
            return found[:2]
        if len(first) < k:
            raise ValueError("the file ends inside its header")
        k *= 4


def _plausible(data: bytes | bytearray, at: int) -> int:
    """Where the record at that place would end; -1 if there is none, 0 if too little of it is there to tell."""
    if at + 36 > len(data):
        return 0
    size, ref, pos, n_name, _, _, n_cigar, _, n_seq, mate, mate_pos, _ = _FIXED.unpack_from(data, at)
    least = 32 + n_name + 4 * n_cigar + (n_seq + 1) // 2 + n_seq
    if n_name < 1 or n_seq < 0 or not least <= size < 1 << 28 or not -1 <= ref < 1 << 24 or not -1 <= mate < 1 << 24 or pos < -1 or mate_pos < -1:
        return -1
    name = data[at + 36 : at + 36 + n_name]
    if len(name) == n_name and (name[-1] or any(not 33 <= c <= 126 for c in name[:-1])):
        return -1
    ops = data[at + 36 + n_name : at + 36 + n_name + 4 * n_cigar : 4]
    return at + 4 + size if all(c & 15 < len(CIGAR_OPS) for c in ops) else -1


def _first_record(data: bytes | bytearray, whole: bool) -> int | None:
    """The first place where RUN plausible records follow one another (whole: or fewer, if they reach the data's end); None if more data is needed or there is none."""
    for at in range(len(data)):
        end, n = at, 0
        while n < RUN:
            after = _plausible(data, end)
            if after < 0:
                break
            if after == 0 or after > len(data):
                # Cut off: enough if some whole records came before, else only more data tells.
                if not whole:
                    return None
                n = RUN if n else 0
                break
            end, n = after, n + 1
            if end == len(data) and whole:
                n = RUN
        if n == RUN:
            return at
    return None


def typed_tag(value: str) -> str:
    """As codecs.typed_tag, of one value."""
    if re.match(TAG_TYPED, value):
        return value
    return ("i:" if re.match(TAG_INTEGER, value) else "f:" if re.match(TAG_FLOAT, value) else "Z:") + value


def _number(kind: str, data: bytes, at: int) -> str:
    value = struct.unpack_from(_NUMBERS[kind], data, at)[0]
    return str(np.float32(value)) if kind == "f" else str(value)


def _tags(data: bytes) -> list[tuple[str, str]]:
    """(tag, "T:value") of a record's tags; whole numbers of every width are of type i."""
    out, at, seen = [], 0, set()
    while at < len(data):
        tag, kind, at = data[at : at + 2].decode(), chr(data[at + 2]), at + 3
        if kind in _NUMBERS:
            value = ("f:" if kind == "f" else "i:") + _number(kind, data, at)
            at += struct.calcsize(_NUMBERS[kind])
        elif kind == "A":
            value, at = "A:" + chr(data[at]), at + 1
        elif kind in "ZH":
            end = data.index(0, at)
            value, at = f"{kind}:{data[at:end].decode()}", end + 1
        elif kind == "B":
            of, count = chr(data[at]), struct.unpack_from("<i", data, at + 1)[0]
            width = struct.calcsize(_NUMBERS[of])
            value, at = ",".join(["B:" + of, *(_number(of, data, at + 5 + k * width) for k in range(count))]), at + 5 + count * width
        else:
            raise ValueError(f"unknown tag type {kind!r}")
        if tag not in seen:  # a repeated tag counts where it comes first
            seen.add(tag)
            out.append((tag, value))
    return out


@lru_cache(1 << 14)
def _cigar_of(packed: bytes) -> str | None:
    return "".join(f"{c >> 4}{CIGAR_OPS[c & 15]}" for (c,) in struct.iter_unpack("<I", packed)) or None


@lru_cache(1 << 14)
def _packed_cigar(cigar: str) -> bytes:
    ops = [int(n) << 4 | CIGAR_OPS.index(o) for n, o in re.findall(r"([0-9]+)([MIDNSHP=X])", cigar)]
    return struct.pack(f"<{len(ops)}I", *ops)


def _record(data: bytes) -> tuple:
    """The fields of one record, in SCHEMA's order from the name on."""
    _, ref, pos, n_name, mapq, _, n_cigar, flag, n_seq, mate, mate_pos, length = _FIXED.unpack_from(data)
    at = 36 + n_name
    cigar = _cigar_of(data[at : at + 4 * n_cigar])
    at += 4 * n_cigar
    half = (n_seq + 1) // 2
    sequence = data[at : at + half].hex().encode().translate(_BASE_OF_DIGIT)[:n_seq].decode() or None
    quality = data[at + half : at + half + n_seq]
    quality = None if not n_seq or quality[0] == 255 else quality.translate(_TO_TEXT).decode("latin-1")
    return data[36 : 35 + n_name].decode(), flag, ref, pos, mapq, cigar, mate, mate_pos, length, sequence, quality, _tags(data[at + half + n_seq :])


def _split_rows(file: str, split: int, members: Iterator[bytes], records: bool) -> Iterator[tuple]:
    """Records (kind 0) of one split, or else what lies before its first one (kind 1) and after its last whole one (kind 2)."""
    data, started, at_start = bytearray(), False, split == 0
    for member in _ended(members):
        if member is not None:
            data += _inflated(member)
        if not started:
            if at_start and len(data) >= len(MAGIC) and data[: len(MAGIC)] == MAGIC:
                header = _header(bytes(data))
                if header is None:
                    if member is None:
                        raise ValueError(f"{file} ends inside its header")
                    continue
                first = header[2]
                del data[:first]
                started = True
            else:
                first = 0 if at_start and data else _first_record(data, member is None)
                if first is None:
                    if member is None and not records:
                        yield (1, file, split, bytes(data), *[None] * 12)
                    continue
                if not records:
                    yield (1, file, split, bytes(data[:first]), *[None] * 12)
                del data[:first]
                started = True
        at = 0
        while at + 4 <= len(data) and (end := at + 4 + struct.unpack_from("<i", data, at)[0]) <= len(data):
            if end <= at + 35:
                raise ValueError(f"a broken record in {file}")
            if records:
                yield (0, file, split, None, *_record(bytes(data[at:end])))
            at = end
        del data[:at]
    if started and not records:
        yield (2, file, split, bytes(data), *[None] * 12)


def _ended(members: Iterator[bytes]) -> Iterator[bytes | None]:
    yield from members
    yield None


_TYPES = [
    pa.int32(), pa.string(), pa.int64(), pa.binary(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string()),
]


def _frames(rows: Iterator[tuple], size: int = 5000) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield _frame(held)
            held = []
    if held:
        yield _frame(held)


def _frame(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(_TYPES)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], _NAMES)


def _parsed(records: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The records of all splits of a task, whose members come in order, or the pieces of records at their ends."""

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members = (m for batch in batches for m in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True))
        for (file, split), group in groupby(members, key=lambda m: m[:2]):
            yield from _frames(_split_rows(file, split, (m[2] for m in group), records))

    return parsed


def _joined(pieces: pa.Table) -> pa.Table:
    """The records that lie across splits of one file; a file's pieces are a record or so a split."""
    rows = []
    data = b""
    for kind, file, split, raw in sorted(zip(*(pieces[c].to_pylist() for c in ("kind", "file", "split", "raw")), strict=True), key=lambda r: (r[2], r[0])):
        data += raw
        if kind == 1:
            at = 0
            while at + 4 <= len(data) and (end := at + 4 + struct.unpack_from("<i", data, at)[0]) <= len(data):
                rows.append((0, file, split, None, *_record(data[at:end])))
                at = end
            data = data[at:]
        # A split with a start of its own leaves nothing open before it.
        elif len(data) != len(raw):
            raise ValueError(f"the records of {file} do not meet at {split}")
    if data:
        raise ValueError(f"{file} ends inside a record")
    return pa.Table.from_batches([_frame(rows)])


def read_bam(spark: SparkSession, path: str) -> DataFrame:
    """Rows of all files under path, which share the references of the first one's header."""
    _, references = read_header(spark, path)
    members = _members(spark, path)
    pieces = members.mapInArrow(_parsed(records=False), SCHEMA).groupBy("file").applyInArrow(_joined, SCHEMA)
    names = spark.createDataFrame([(k, name) for k, (name, _) in enumerate(references)], "reference_id int, reference string")
    rows = members.mapInArrow(_parsed(records=True), SCHEMA).unionByName(pieces).drop("kind", "file", "split", "raw")
    mates = names.select(F.col("reference_id").alias("mate_reference_id"), F.col("reference").alias("mate_reference"))
    rows = rows.join(shared.small(names), "reference_id", "left").join(shared.small(mates), "mate_reference_id", "left")
    return rows.withColumn("span", reference_span(F.col("cigar")).cast("int"))


def _bin(begin: int, end: int) -> int:
    """The binning index's number of [begin, end)."""
    end -= 1
    for shift, offset in ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1)):
        if begin >> shift == end >> shift:
            return offset + (begin >> shift)
    return 0


def _packed_tag(tag: str, value: str) -> bytes:
    """A tag by the type that its value names (or, without one, looks like); whole numbers beyond 32 bits are texts."""
    value = typed_tag(value)
    kind, text = value[0], value[2:]
    if kind == "i":
        number = int(text)
        if -(1 << 31) <= number < 1 << 32:
            return tag.encode() + (b"i" + struct.pack("<i", number) if number < 1 << 31 else b"I" + struct.pack("<I", number))
        kind = "Z"
    if kind == "f":
        return tag.encode() + b"f" + struct.pack("<f", float(text))
    if kind == "A":
        return tag.encode() + b"A" + text[:1].encode("latin-1", "replace")
    if kind == "B":
        of, *values = text.split(",")
        return tag.encode() + b"B" + of.encode() + struct.pack("<i", len(values)) + b"".join(struct.pack(_NUMBERS[of], float(v) if of == "f" else int(v)) for v in values)
    return tag.encode() + kind.encode() + text.encode() + b"\0"


def packed_record(name, flag, reference_id, position, mapq, cigar, mate_reference_id, mate_position, template_length, sequence, quality, tags, span) -> bytes:
    ops, sequence, name = _packed_cigar(cigar or ""), sequence or "", (name or "*").encode() + b"\0"
    digits = sequence.encode("latin-1", "replace").translate(_DIGIT_OF_BASE) + b"0" * (len(sequence) % 2)
    scores = quality.encode("latin-1", "replace").translate(_TO_SCORE) if quality and len(quality) == len(sequence) else b"\xff" * len(sequence)
    body = name + ops + bytes.fromhex(digits.decode()) + scores + b"".join([_packed_tag(k, v) for k, v in sorted(tags or ())])
    place = _bin(max(position, 0), max(position, 0) + max(span or 1, 1)) if position >= 0 else 4680
    return _FIXED.pack(32 + len(body), reference_id, position, len(name), mapq, place & 0xFFFF, len(ops) // 4, flag, len(sequence), mate_reference_id, mate_position, template_length) + body


def member(data: bytes) -> bytes:
    """One BGZF member of at most 65,280 bytes of data."""
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    return MEMBER + struct.pack("<H", len(MEMBER) + len(body) + 9) + body + struct.pack("<II", zlib.crc32(data), len(data))


def packed_header(text: str, references: list[tuple[str, int]]) -> bytes:
    out = MAGIC + struct.pack("<i", len(text.encode())) + text.encode() + struct.pack("<i", len(references))
    return out + b"".join(struct.pack("<i", len(n.encode()) + 1) + n.encode() + b"\0" + struct.pack("<i", size) for n, size in references)


def write_bam(rows: DataFrame, header: str, references: list[tuple[str, int]], path: str, payload: int = PAYLOAD) -> None:
    """rows (as read_bam's) in (reference_id, position) order, unmapped ones last, as part files: each is BGZF data, the first begins with the header, and one after the other they are one BAM file.

    Every row of the text sink holds members; what Spark puts between lines is the
    empty member, so each part ends as such files must.
    """
    spark = rows.sparkSession
    names = spark.createDataFrame([(k, n) for k, (n, _) in enumerate(references)], "id int, ref string")

    def known(column: str, out: str) -> DataFrame:
        return shared.small(names.select(F.col("ref").alias(column), F.col("id").alias(out)))

    numbers = {"flag": 0, "reference_id": -1, "position": -1, "mapq": 0, "mate_reference_id": -1, "mate_position": -1, "template_length": 0, "span": 0}
    fields = ["name", "flag", "reference_id", "position", "mapq", "cigar", "mate_reference_id", "mate_position", "template_length", "sequence", "quality", "tags", "span"]
    given = rows.drop("reference_id", "mate_reference_id").join(known("reference", "reference_id"), "reference", "left").join(known("mate_reference", "mate_reference_id"), "mate_reference", "left")
    given = given.select(*(F.coalesce(F.col(c).cast("int"), F.lit(numbers[c])).alias(c) if c in numbers else F.col(c) for c in fields))
    first = spark.range(1).select(*((F.lit(numbers[c]) if c in numbers else F.lit(None)).cast(given.schema[c].dataType).alias(c) for c in fields), F.lit(0).alias("rank"))
    ranked = first.unionByName(given.withColumn("rank", F.when(F.col("reference_id") >= 0, 1).otherwise(2)))
    begin = packed_header(header, references)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, done = bytearray(), []
        for batch in batches:
            for *row, rank in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data += begin if rank == 0 else packed_record(*row)
                while len(data) >= payload:
                    done.append(member(bytes(data[:payload])))
                    del data[:payload]
                    if len(done) == 16:
                        yield pa.RecordBatch.from_pydict({"value": [b"".join(done)]})
                        done = []
        if data:
            done.append(member(bytes(data)))
        if done:
            yield pa.RecordBatch.from_pydict({"value": [b"".join(done)]})

    ordered = ranked.select(*fields, "rank").orderBy("rank", "reference_id", "position", "name", "flag")
    lines = ordered.mapInArrow(packed, "value binary").select(F.col("value").cast("string").alias("value"))
    lines.write.mode("overwrite").option("encoding", "ISO-8859-1").option("lineSep", LAST.decode("latin-1")).text(path)
