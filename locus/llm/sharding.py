"""Sharding by best-fit-decreasing bin packing.

Rows of equal text form an indivisible group; a group's size is the sum of its
rows' sizes (UTF-8 bytes plus one).  Groups enter, largest first, the bin with
the least remaining capacity that still holds them.

At most LARGE * shards groups can be larger than total / (LARGE * shards); each
of those is packed by itself.  All smaller groups travel in CRATES * shards
crates, dealt by the hash of their text.  So the packing, which is sequential,
sees a bounded number of items at any input size, and a bin is off the mean by
about a crate, under a thousandth of a shard, unless one group outweighs that.

A null text counts as empty, with size one.  Repeated rows stay rows of their
own.  Extra columns are ignored, an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from locus.sources.shared import materialised

LARGE, CRATES, BUCKET_ROWS = 512, 1024, 50_000


class CapacityTree:
    """Remaining capacities of bins in a binary tree of fixed depth: insert, remove and successor go down it once."""

    def __init__(self, capacity: int):
        self.depth = capacity.bit_length()
        self.below: dict[tuple[int, int], int] = {}
        self.bins: dict[int, list[int]] = {}

    def _count(self, left: int, by: int) -> None:
        for level in range(self.depth + 1):
            key = (level, left >> level)
            self.below[key] = self.below.get(key, 0) + by
            if not self.below[key]:
                del self.below[key]

    def put(self, left: int, bin_id: int) -> None:
        self.bins.setdefault(left, []).append(bin_id)
        self._count(left, 1)

    def take(self, size: int) -> tuple[int, int] | None:
        """Removes the bin with the least remaining capacity of size or more: (remaining, bin)."""
        left = None
        if (0, size) in self.below:
            left = size
        else:
            for level in range(self.depth):
                up = size >> level
                if not up & 1 and (level, up + 1) in self.below:
                    left = up + 1
                    for lower in range(level - 1, -1, -1):
                        left = left * 2 if (lower, left * 2) in self.below else left * 2 + 1
                    break
        if left is None:
            return None
        bin_id = self.bins[left].pop()
        self._count(left, -1)
        return left, bin_id


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """The bin of every size, bins numbered as they open; no size may exceed the capacity."""
    tree, out, opened = CapacityTree(capacity), [0] * len(sizes), 0
    for k in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        found = tree.take(sizes[k])
        if found is None:
            found, opened = (capacity, opened), opened + 1
        left, out[k] = found
        tree.put(left - sizes[k], out[k])
    return out


def pack_into(sizes: list[int], shards: int) -> list[int]:
    """The bin of every size.  A size above the mean of what is left has a bin to itself; the others are packed best fit decreasing into the rest,
    at the least capacity tried, from a perfect split upwards, that needs no more bins."""
    order, left, own = sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)), sum(sizes), 0
    while own < shards - 1 and own < len(order) and sizes[order[own]] * (shards - own) > left:
        left -= sizes[order[own]]
        own += 1
    small = [sizes[k] for k in order[own:]]
    least, slack = max([-(-left // (shards - own)), *small, 1]), 0.0
    while True:
        packed = best_fit_decreasing(small, int(least * (1 + slack)))
        if max(packed, default=0) < shards - own:
            break
        slack = slack * 1.5 if slack else 1e-5
    out = [0] * len(sizes)
    for place, k in enumerate(order):
        out[k] = place if place < own else own + packed[place - own]
    return out


def shard_by_bytes(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, shard (0 to shards - 1), slot (gapless from 0 in a shard)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = materialised(
        docs.select(
            "doc_id",
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.unhex(F.sha2(text, 256)).alias("group_key"),
            F.monotonically_increasing_id().alias("row"),
        )
    )
    groups = materialised(rows.groupBy("group_key").agg(F.sum("size").alias("bytes")))
    total, count = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    # Bounded: at most LARGE * shards groups are that large, and there are CRATES * shards crates.
    large = groups.where(F.col("bytes") >= total / (LARGE * shards)).select("group_key", F.hex("group_key").alias("own"))
    crate = F.concat(F.lit("crate "), F.pmod(F.xxhash64("group_key"), F.lit(CRATES * shards)).cast("string"))

    def with_items(table: DataFrame) -> DataFrame:
        return table.join(F.broadcast(large), "group_key", "left").withColumn("item", F.coalesce("own", crate))

    items = sorted(map(tuple, with_items(groups).groupBy("item").agg(F.sum("bytes").alias("bytes")).collect()))
    bins = pack_into([size for _, size in items], shards)
    placed = docs.sparkSession.createDataFrame([(item, b) for (item, _), b in zip(items, bins, strict=True)], "item string, shard int")
    # Rows find their shard where they lie; a group of a third of all rows is not brought together.
    out = with_items(rows).join(F.broadcast(placed), "item")
    out = out.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_crc32", F.col("row") % 4096), F.lit(max(1, count // BUCKET_ROWS))))
    before = (
        out.groupBy("shard", "bucket")
        .count()
        .select("shard", "bucket", (F.sum("count").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("count")).alias("before"))
    )
    order = Window.partitionBy("shard", "bucket").orderBy("doc_id", "size", "text_crc32", "row")
    return (
        out.withColumn("place", F.row_number().over(order))
        .join(before, ["shard", "bucket"])
        .select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("place") - 1).cast("long").alias("slot"))
    )
