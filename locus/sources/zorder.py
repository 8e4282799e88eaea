"""Points of several dimensions, stored along a Z-order curve.

Each coordinate is cut into 2**bits cells between bounds, and the cells' bits are
interleaved to one key, in column expressions.  Files are ranges of the key, sorted by
it, so a file and a row group hold a compact block of space, whichever dimensions a
box bounds.  A box is decomposed into ranges of the key: blocks of the curve that lie
inside whole, or are small enough for what a list of ranges may be long; these ranges
and the bounds themselves are plain predicates, which Parquet's statistics prune.

Coordinates outside the bounds lie in the outermost cells, so no point is lost; points
with a null coordinate are in cell 0 and in no box that bounds that coordinate.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Cells a dimension (as bits), and ranges of the key that a box is cut into at most.
BITS, RANGES = 12, 64


def cell_of(value: float, low: float, high: float, bits: int) -> int:
    return min(max(int((value - low) * (1 << bits) // (high - low)), 0), (1 << bits) - 1)


def key(bounds: dict[str, tuple[float, float]], bits: int = BITS) -> Column:
    """The Z-order key of columns with those bounds: bit i of dimension d at place i * dimensions + d."""
    out = F.lit(0).cast("long")
    for d, (name, (low, high)) in enumerate(bounds.items()):
        cell = F.floor((F.col(name).cast("double") - low) * (1 << bits) / (high - low))
        cell = F.coalesce(F.greatest(F.lit(0), F.least(F.lit((1 << bits) - 1), cell)), F.lit(0)).cast("long")
        for i in range(bits):
            out = out.bitwiseOR(F.shiftleft(F.shiftright(cell, i).bitwiseAND(F.lit(1)), i * len(bounds) + d))
    return out


def ranges(low: list[int], high: list[int], bits: int, most: int = RANGES) -> list[tuple[int, int]]:
    """Ranges (first, last) of the key that cover the cells from low to high (both included), at most about so many."""
    dims = len(low)
    blocks, done = [(0, [0] * dims, bits)], []  # the key's prefix, the least cells, and the bits below
    while blocks and len(blocks) + len(done) < most:
        prefix, at, below = blocks.pop(0)
        size = 1 << below
        if any(a > h or a + size - 1 < w for a, w, h in zip(at, low, high, strict=True)):
            continue
        if below == 0 or all(w <= a and a + size - 1 <= h for a, w, h in zip(at, low, high, strict=True)):
            done.append((prefix, below))
            continue
        half = size >> 1
        for part in range(1 << dims):
            blocks.append((prefix << dims | part, [a + half * (part >> d & 1) for d, a in enumerate(at)], below - 1))
    touched = [b for b in blocks if not any(a > h or a + (1 << b[2]) - 1 < w for a, w, h in zip(b[1], low, high, strict=True))]
    spans = sorted((p << below * dims, ((p + 1) << below * dims) - 1) for p, below in done + [(b[0], b[2]) for b in touched])
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if out and out[-1][1] + 1 == a:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def write(points: DataFrame, path: str, bounds: dict[str, tuple[float, float]], bits: int = BITS, files: int | None = None, rows_a_group: int | None = None) -> None:
    """points with their key (z) in files that are ranges of it, sorted; bounds: of each dimension.  The layout lies beside the files."""
    keyed = points.withColumn("z", key(bounds, bits))
    dealt = keyed.repartitionByRange(files, "z") if files else keyed.repartitionByRange("z")
    out = dealt.sortWithinPartitions("z").write.mode("overwrite")
    (out.option("parquet.block.row.count.limit", rows_a_group) if rows_a_group else out).parquet(f"{path}/points")
    layout = json.dumps({"bits": bits, "bounds": {k: list(v) for k, v in bounds.items()}})
    points.sparkSession.createDataFrame([(layout,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/layout")


def in_box(spark: SparkSession, path: str, **box: tuple[float, float]) -> DataFrame:
    """Points in a box of half-open bounds of some or all dimensions."""
    layout = json.loads(spark.read.text(f"{path}/layout").first().value)
    bits, bounds = layout["bits"], layout["bounds"]
    low = [cell_of(box[n][0], *bounds[n], bits) if n in box else 0 for n in bounds]
    high = [cell_of(box[n][1], *bounds[n], bits) if n in box else (1 << bits) - 1 for n in bounds]
    near = F.lit(False)
    for a, b in ranges(low, high, bits):
        near = near | F.col("z").between(a, b)
    rows = spark.read.parquet(f"{path}/points").where(near)
    for name, (a, b) in box.items():
        rows = rows.where((F.col(name) >= a) & (F.col(name) < b))
    return rows.drop("z")
