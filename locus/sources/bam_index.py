"""An offset index of binary alignment files, and reads of a region through it.

One pass over the members tells for each of them, and each reference, the least
position and the greatest end of the records that begin in it, and where in its data
the first of them begins.  That table, stored beside the file, is bins and linear
index in one: a region's members are a predicate on it, which row-group statistics
prune, and only those members (and what a last record needs of the ones behind) are
read and inflated.  Tasks read byte ranges through pyarrow's file systems (local,
hdfs, s3, gs), so files are opened where those reach them.

As in bam.py a split finds its own first record, and the records between splits are
put together per file; the bytes of earlier splits add up to where a split begins.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
import pyarrow.fs
from pyspark import Accumulator
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from locus.functions.codecs import REFERENCE_OPS, reference_span
from locus.operators.regions import Region
from locus.sources import bam
from locus.sources.bam import CIGAR_OPS, MAGIC, MEMBER
from locus.sources.shared import materialised, scratch

_ROW = "kind int, file string, split long, rel long, size long, first long, reference_id int, least int, `end` int, reads long, raw binary, places array<long>, rels array<long>, sizes array<long>"
_NAMES = [f.split()[0].strip("`") for f in _ROW.split(", ")]
_LONGS = pa.list_(pa.int64())
_TYPES = [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), _LONGS, _LONGS, _LONGS]
_COVERS = frozenset(CIGAR_OPS.index(o) for o in REFERENCE_OPS)


def _extent(data: bytes | bytearray, at: int) -> tuple[int, int, int]:
    """reference_id, position, end of the record at that place; a record that covers nothing has the place of its position."""
    _, ref, pos, n_name, _, _, n_cigar, *_ = bam._FIXED.unpack_from(data, at)
    ops = struct.unpack_from(f"<{n_cigar}I", data, at + 36 + n_name)
    return ref, pos, pos + max(1, sum(c >> 4 for c in ops if c & 15 in _COVERS))


class _Walk:
    """Data of members one after the other, and which member each place of it is in."""

    def __init__(self) -> None:
        self.data = bytearray()
        self.marks: list[tuple[int, int, int, int]] = []  # place, split, rel, size
        self.found: dict[tuple[int, int, int], dict[int, list[int]]] = {}
        self.first: dict[tuple[int, int, int], int] = {}

    def add(self, data: bytes, marks: list[tuple[int, int, int, int]]) -> None:
        self.marks += [(place + len(self.data), *rest) for place, *rest in marks]
        self.data += data

    def drop(self, n: int) -> None:
        del self.data[:n]
        self.marks = [(place - n, *rest) for place, *rest in self.marks]
        while len(self.marks) > 1 and self.marks[1][0] <= 0:
            del self.marks[0]

    def records(self, file: str) -> None:
        """Takes the whole records at the beginning."""
        at, k = 0, 0
        while at + 4 <= len(self.data) and (end := at + 4 + struct.unpack_from("<i", self.data, at)[0]) <= len(self.data):
            if end <= at + 35:
                raise ValueError(f"a broken record in {file}")
            while k + 1 < len(self.marks) and self.marks[k + 1][0] <= at:
                k += 1
            place, *key = self.marks[k]
            ref, pos, stop = _extent(self.data, at)
            self.first.setdefault(tuple(key), at - place)
            known = self.found.setdefault(tuple(key), {}).setdefault(ref, [pos, stop, 0])
            known[:] = min(known[0], pos), max(known[1], stop), known[2] + 1
            at = end
        self.drop(at)

    def rows(self, file: str) -> Iterator[tuple]:
        for key, references in self.found.items():
            split, rel, size = key
            for ref, (least, end, reads) in references.items():
                yield (0, file, split, rel, size, self.first[key], ref, least, end, reads, None, None, None, None)
        self.found, self.first = {}, {}


def _piece(kind: int, file: str, split: int, data: bytes, marks: list[tuple[int, int, int, int]]) -> tuple:
    places, _, rels, sizes = zip(*marks, strict=True) if marks else ((), (), (), ())
    return (kind, file, split, None, None, None, None, None, None, None, data, places, rels, sizes)


def _split_index(file: str, split: int, members: Iterator[bytes]) -> Iterator[tuple]:
    """Rows of one split: what its members hold (kind 0), what lies before its first record and after its last whole one (1, 2), and its bytes (3)."""
    walk, started, rel = _Walk(), False, 0
    for member in bam._ended(members):
        if member:
            size = len(MEMBER) + len(member)
            walk.add(bam._inflated(member), [(0, split, rel, size)])
            rel += size
        if not started:
            if split == 0 and walk.data[: len(MAGIC)] == MAGIC:
                header = bam._header(bytes(walk.data))
                if header is None:
                    if member is None:
                        raise ValueError(f"{file} ends inside its header")
                    continue
                walk.drop(header[2])
            else:
                first = 0 if split == 0 and walk.data else bam._first_record(walk.data, member is None)
                if first is None:
                    if member is None and walk.data:
                        yield _piece(1, file, split, bytes(walk.data), walk.marks)
                    continue
                inside = [m for m in walk.marks if m[0] < first]
                yield _piece(1, file, split, bytes(walk.data[:first]), inside)
                walk.drop(first)
            started = True
        walk.records(file)
        yield from walk.rows(file)
    if started and walk.data:
        yield _piece(2, file, split, bytes(walk.data), walk.marks)
    yield (3, file, split, rel, None, None, None, None, None, None, None, None, None, None)


def _batches(rows: Iterator[tuple], size: int = 2000) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield _batch(held)
            held = []
    yield _batch(held)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(_TYPES)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], _NAMES)


def _between(pieces: pa.Table) -> pa.Table:
    """What the records between the splits of one file add; the pieces are a record or so a split."""
    walk, rows = _Walk(), []
    for r in sorted(pieces.to_pylist(), key=lambda r: (r["split"], r["kind"])):
        if r["kind"] == 2 and walk.data:
            raise ValueError(f"the records of {r['file']} do not meet at {r['split']}")
        if r["kind"] == 2:
            walk.marks = []
        walk.add(r["raw"], [(p, r["split"], rel, size) for p, rel, size in zip(r["places"], r["rels"], r["sizes"], strict=True)])
        if r["kind"] == 1:
            walk.records(r["file"])
            rows += walk.rows(r["file"])
    if walk.data:
        raise ValueError("a file ends inside a record")
    return pa.Table.from_batches([_batch(rows)])


def build(spark: SparkSession, path: str) -> DataFrame:
    """file, offset, size, first, reference_id, least, end, reads: a row for each member of the files under path and each reference that records beginning in it have."""

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members = (m for batch in batches for m in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True))
        for (file, split), group in groupby(members, key=lambda m: m[:2]):
            yield from _batches(_split_index(file, split, (m[2] for m in group)))

    with scratch(spark) as folder:
        found = materialised(bam._members(spark, path).mapInArrow(indexed, _ROW), folder)
        between = found.where("kind in (1, 2)").groupBy("file").applyInArrow(_between, _ROW)
        before = F.sum("rel").over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1))
        begins = found.where("kind = 3").select("file", "split", F.coalesce(before, F.lit(0)).alias("begin"))
        rows = found.where("kind = 0").unionByName(between).join(begins, ["file", "split"])
        grouped = rows.groupBy("file", (F.col("begin") + F.col("rel")).alias("offset"), "size", "reference_id")
        return materialised(grouped.agg(F.min("first").alias("first"), F.min("least").alias("least"), F.max("end").alias("end"), F.sum("reads").alias("reads")))


def write(spark: SparkSession, path: str, target: str) -> None:
    """The index of the files under path, and their references, as Parquet at target; a member's first record is the same for all its references."""
    _, references = bam.read_header(spark, path)
    named = [(k, name, size) for k, (name, size) in enumerate(references)]
    spark.createDataFrame(named, "reference_id int, reference string, length long").coalesce(1).write.mode("overwrite").parquet(f"{target}/references")
    rows = build(spark, path)
    first = rows.groupBy("file", "offset").agg(F.min("first").alias("first"))
    ordered = rows.drop("first").join(first, ["file", "offset"]).repartitionByRange("reference_id", "least").sortWithinPartitions("reference_id", "least")
    ordered.write.mode("overwrite").parquet(f"{target}/members")


def members_of(spark: SparkSession, index: str, region: Region) -> DataFrame:
    """file, offset, size, first of the members in which records that overlap the region begin."""
    known = spark.read.parquet(f"{index}/references").where(F.col("reference") == region.reference).select("reference_id").first()
    near = (F.col("reference_id") == (-2 if known is None else known.reference_id)) & (F.col("end") > region.start)
    near = near if region.end is None else near & (F.col("least") < region.end)
    return spark.read.parquet(f"{index}/members").where(near).select("file", "offset", "size", "first")


def read_region(spark: SparkSession, index: str, region: Region | str, inflated: Accumulator | None = None) -> DataFrame:
    """Rows, as bam.read_bam's, that overlap the region; inflated: counts the members that are read."""
    region = Region.parse(region) if isinstance(region, str) else region

    def fetched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for file, group in groupby(wanted, key=lambda r: r[0]):
            system, name = pyarrow.fs.FileSystem.from_uri(file)
            with system.open_input_file(name) as source:
                yield from bam._frames(_records(source, file, group, inflated))

    members = members_of(spark, index, region)
    rows = members.repartitionByRange("file", "offset").sortWithinPartitions("file", "offset").mapInArrow(fetched, bam.SCHEMA).drop("kind", "file", "split", "raw")
    names = spark.read.parquet(f"{index}/references").select("reference_id", "reference")
    mates = names.select(F.col("reference_id").alias("mate_reference_id"), F.col("reference").alias("mate_reference"))
    rows = rows.join(names, "reference_id", "left").join(mates, "mate_reference_id", "left").withColumn("span", reference_span(F.col("cigar")).cast("int"))
    inside = (F.col("reference") == region.reference) & (F.col("position") + F.col("span") > region.start)
    return rows.where(inside if region.end is None else inside & (F.col("position") < region.end))


def _records(source: pa.NativeFile, file: str, wanted: Iterator[tuple], inflated: Accumulator | None) -> Iterator[tuple]:
    """The records that begin in the wanted members, which come in the file's order."""
    held: tuple[int, bytes, int] | None = None  # of the member read last: offset, data, where the next one begins

    def member_at(offset: int) -> tuple[bytes, int]:
        nonlocal held
        if held is None or held[0] != offset:
            source.seek(offset)
            head = source.read(len(MEMBER) + 2)
            if head[: len(MEMBER)] != MEMBER:
                raise ValueError(f"no member of {file} begins at {offset}")
            size = struct.unpack_from("<H", head, len(MEMBER))[0] + 1
            held = offset, bam._inflated(head[len(MEMBER) :] + source.read(size - len(head))), offset + size
            if inflated is not None:
                inflated.add(1)
        return held[1:]

    for _, offset, _, first in wanted:
        data, after = member_at(offset)
        own, at = len(data), first
        while at < own:
            while at + 4 > len(data) or at + 4 + struct.unpack_from("<i", data, at)[0] > len(data):
                more, after = member_at(after)
                data += more
            end = at + 4 + struct.unpack_from("<i", data, at)[0]
            yield (0, file, 0, None, *bam._record(bytes(data[at:end])))
            at = end
