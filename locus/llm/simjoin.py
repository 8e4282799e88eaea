"""N-gram Jaccard join over an R-tree of count vectors.

A document's set is its distinct five-word shingles (A-Z lower-cased; fewer words
make one shingle, none an empty set that is linked with nothing).  Two documents
link when 100 * |intersection| >= 75 * |union|.  The join returns every document
with its class: the smallest doc_id that links lead to, itself included.

Shingles are hashed into groups, and a set is indexed as the point of its group
counts.  Two sets cannot share more than the sum of the smaller of their counts,
group by group, nor can any two points below two boxes share more than the sum of
the smaller of the boxes' upper corners.  Pairs that this bound leaves are
verified on their texts, word by word.

No box is tight in many dimensions once it holds unrelated points, so the points
are dealt over many trees: one for each shingle among a set's first
|set| - ceil(.75 |set|) + 1, in one global order that puts frequent shingles last.
Two sets that link have such a shingle, and so a tree, in common.  How frequent a
shingle is, a table of counts tells that all texts add to; it is of fixed size, so
it mixes shingles up, but any order will do.  Equal sets are
one point: by 128 bits of BLAKE2b over the names of their shingles, which come from
their words' names, all under a key that every job draws anew (textops.word_names), so
no texts can be made up that only seem equal.  Trees with the same least point are one.

Every tree is searched twice.  First each of its points meets the point nearest to
the tree's mean, so that a crowd of near copies costs a pass and not a square.  The
links found are joined into classes.  Then the tree meets itself from its root
down: boxes that hold one and the same class are left alone, as are those that the
bound tells apart, and the pairs of points that remain are verified.  Trees of more
than BLOCK points are cut: in the first search into blocks, whose middle points make
the next tree above them, in the second into the tree's largest class, whose blocks
never meet each other, and blocks of the rest, which meet all others.  A third of all rows in one tree is therefore many tasks.

How many documents each one links to is counted afterwards, on request: links lie
inside classes, so the sets of a class meet all the others of it, by blocks of a bounded
number of shingles, and their overlaps are products of incidence matrices.  That is the
square of a class's distinct sets, in tasks of bounded size; copies count by their
number and are not compared.

Repeated rows belong to one class.  A null text has an empty set.  Rows with a
null doc_id take part; they never name a class that has a document with an id.
An empty table gives an empty result.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from locus.llm.components import connected
from locus.llm.textops import Words, exact_shingle_sets, ranges, shingle_sets, slices
from locus.sources.shared import materialised, scratch

#: Counters of the frequency table, and how many of them travel in a row.
COUNTERS, STRIP = 1 << 20, 1 << 12
#: Parts of the tasks whose tables are summed first; rows that may be broadcast; bytes of texts that are verified together.
PARTS, BROADCAST_ROWS, VERIFIED_BYTES = 32, 100_000, 1 << 20
#: Bits of a frequent shingle's key that are not its salt's.
SHINGLE_BITS = 48
#: Points of a leaf, children of an inner box, points of a block of a large tree.
LEAF, FAN, BLOCK = 16, 8, 1024
#: Rows of small trees that are searched together, and counts that a step holds as a matrix.
FOREST, CELLS = 4096, 1 << 22
#: Shingles of a block of a class whose links are counted.
GROUP = 1 << 19


def digest(shingles: np.ndarray, key: bytes) -> tuple[int, int]:
    """128 bits that name a set, as two signed numbers."""
    a, b = np.frombuffer(hashlib.blake2b(shingles.tobytes(), digest_size=16, key=key).digest(), np.int64)
    return int(a), int(b)


def n_groups(n: int) -> int:
    """Enough groups that sets which share little differ by more than the bound allows: at most one shingle a group, up to 4096 groups."""
    return 1 << min(max(5, n.bit_length()), 12)


def count_vector(shingles: np.ndarray) -> bytes:
    """The counts of a set's groups: the bytes a count takes, then the compressed counts, which are mostly 0, 1 and 2."""
    groups = n_groups(len(shingles))
    counts = np.bincount((shingles & np.uint64(groups - 1)).astype(np.int64), minlength=groups)
    kind = np.uint8 if counts.max() < 1 << 8 else np.uint32
    return bytes([np.dtype(kind).itemsize]) + pa.Codec("zstd").compress(counts.astype(kind).tobytes(), asbytes=True)


def vectors(points: list[bytes], n: np.ndarray) -> np.ndarray:
    """Count vectors as a matrix, folded to the fewest groups among them: halves of a vector sum up to one of half the groups."""
    groups, codec = n_groups(int(n.min())), pa.Codec("zstd")
    out = np.empty((len(points), groups), np.int32)
    for k, (p, size) in enumerate(zip(points, n.tolist(), strict=True)):
        kind = np.uint8 if p[0] == 1 else np.uint32
        out[k] = np.frombuffer(codec.decompress(p[1:], n_groups(size) * p[0]), kind).reshape(-1, groups).sum(0)
    return out


def least_shared(na, nb):
    """The overlap that sets of those sizes need: 100 i >= 75 (na + nb - i)."""
    return -(-(75 * (na + nb)) // 175)


def possible(v: np.ndarray, n: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the points, or boxes (upper corners and smallest sizes), a and b of a table may hold a link."""
    out = np.zeros(len(a), bool)
    for at in range(0, len(a), 512):
        i, j = a[at : at + 512], b[at : at + 512]
        out[at : at + 512] = np.minimum(v[i], v[j]).sum(1) >= least_shared(n[i], n[j])
    return out


class RTrees:
    """Packed R-trees over count vectors, one for each number in tree: points sorted by class and size, boxes over runs of them."""

    def __init__(self, v: np.ndarray, n: np.ndarray, group: np.ndarray, tree: np.ndarray):
        self.order = np.lexsort((n, group, tree))
        v, n, group, tree = (x[self.order] for x in (v, n, group, tree))
        level, width = (v, n, n, group, group), LEAF
        self.levels, self.kids = [level], []
        while len(tree) > 1 and (tree[1:] == tree[:-1]).any():
            first = np.flatnonzero(np.append(True, tree[1:] != tree[:-1]))
            place = np.arange(len(tree)) - np.repeat(first, np.diff(np.append(first, len(tree))))
            at = np.flatnonzero(place % width == 0)
            up, low, high, g0, g1 = level
            level = (np.maximum.reduceat(up, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.minimum.reduceat(g0, at), np.maximum.reduceat(g1, at))
            self.levels.append(level)
            self.kids.append((at, np.diff(np.append(at, len(tree)))))
            tree, width = tree[at], FAN

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of points of one tree and of different classes that the bound leaves."""
        i = j = np.arange(len(self.levels[-1][0]))
        if not self.kids:
            i = j = i[:0]
        for level in range(len(self.kids) - 1, -1, -1):
            up, low, high, g0, g1 = self.levels[level]
            at, kids = self.kids[level]
            found, step = [], max(1, (1 << 20) // (LEAF * LEAF if level == 0 else FAN * FAN))
            for k in range(0, len(i), step):
                x, y = i[k : k + step], j[k : k + step]
                a = ranges(at[x], kids[x])
                each = np.repeat(kids[y], kids[x])
                b = ranges(np.repeat(at[y], kids[x]), each)
                a = np.repeat(a, each)
                fine = (a < b) | ((a == b) & (level > 0))
                a, b = a[fine], b[fine]
                fine = ((g0[a] != g1[b]) | (g1[a] != g0[b]) | (g0[a] != g1[a])) & (4 * high[a] >= 3 * low[b]) & (4 * high[b] >= 3 * low[a])
                a, b = a[fine], b[fine]
                fine = possible(up, low, a, b)
                found.append((a[fine], b[fine]))
            i, j = (np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*found)) if found else (i[:0], j[:0])
        return self.order[i], self.order[j]


def row_name() -> Column:
    """96 bits that name a row in joins, whether it has an id or not."""
    return F.struct(F.xxhash64("doc_id", "text").alias("a"), F.hash("text", "doc_id").alias("b"))


def sketches(docs: DataFrame, key: bytes, keep: tuple[str, ...] = ()) -> DataFrame:
    """A row for every document (kind 0: n, node, check, counts, the row's name, the columns keep), and each task's frequency table in strips (kind 1: node, counts, and in n the part of the tasks that it is summed with first)."""
    docs = docs.select("doc_id", "text", row_name().alias("row_name"), *keep)
    keep = ("row_name", *keep)
    kept = docs.schema[2:]
    kept_types = [to_arrow_type(f.dataType) for f in kept]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(COUNTERS, np.int64)
        for part in slices(batches):
            sets = shingle_sets(Words(part.column(1)), key)
            names = [digest(s, key) for s in sets]
            seen += np.bincount((np.concatenate(sets) >> np.uint64(32) & np.uint64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS)
            yield pa.RecordBatch.from_pydict({
                "kind": pa.array([0] * len(sets), pa.int32()), "doc_id": part.column(0).cast(pa.int64()), "n": pa.array([len(s) for s in sets], pa.int64()),
                "node": pa.array([a for a, _ in names], pa.int64()), "check": pa.array([b for _, b in names], pa.int64()), "counts": pa.array([count_vector(s) for s in sets], pa.binary()),
                **{c: part.column(2 + k) for k, c in enumerate(keep)},
            })
        if seen.any():
            strips = range(0, COUNTERS, STRIP)
            none = pa.array([None] * len(strips), pa.int64())
            blank = {c: pa.nulls(len(strips), t) for c, t in zip(keep, kept_types, strict=True)}
            yield pa.RecordBatch.from_pydict({
                "kind": pa.array([1] * len(strips), pa.int32()), "doc_id": none, "n": pa.array([TaskContext.get().partitionId() % PARTS] * len(strips), pa.int64()), "node": pa.array(strips, pa.int64()), "check": none,
                "counts": pa.array([seen[k : k + STRIP].astype(np.uint32).tobytes() for k in strips], pa.binary()), **blank,
            })

    schema = T.StructType.fromDDL("kind int, doc_id long, n long, node long, `check` long, counts binary")
    return docs.mapInArrow(made, T.StructType([*schema, *(T.StructField(f.name, f.dataType) for f in kept)]))


def frequency_table(strips: DataFrame) -> np.ndarray:
    """Which counters stand out from what shingles at random would add to them.  Strips are summed within PARTS parts of the tasks, then over the parts; the table's fixed size is all that reaches the driver."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Sorted by strip and part: one running sum at a time.
        at, total = None, None

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"node": [at[0]], "n": [at[1]], "counts": [total.tobytes()]})

        for batch in batches:
            for node, n, counts in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if (node, n) != at:
                    if at is not None:
                        yield row()
                    at, total = (node, n), np.zeros(STRIP, np.int64)
                total += np.frombuffer(counts, np.uint32 if len(counts) == 4 * STRIP else np.int64)
        if at is not None:
            yield row()

    table = np.zeros(COUNTERS, np.int64)
    for part in ("n", F.lit(0).cast("long").alias("n")):
        strips = strips.select("node", part, "counts").repartition("node", "n").sortWithinPartitions("node", "n").mapInArrow(summed, "node long, n long, counts binary")
    for row in strips.collect():
        table[row.node : row.node + STRIP] = np.frombuffer(row.counts, np.int64)
    return table > table.mean() + 4 * np.sqrt(table.mean()) + 4


def cells(docs: DataFrame, frequent: np.ndarray, key: bytes, salts: int) -> DataFrame:
    """key, node, pivot: the points of each shingle, and the least of them.

    An even key is a shingle of two points or more.  A frequent shingle's points are
    dealt over salts: there the key's upper SHINGLE_BITS are the shingle's, the others
    the salt's and odd, and the pivot is the least of the salt.
    """

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt_bits = np.uint64(64 - SHINGLE_BITS)
        for part in slices(batches):
            keys, nodes, sizes, seen = [], [], [], set()
            for s in shingle_sets(Words(part.column(0)), key):
                node = digest(s, key)[0]
                if not len(s) or node in seen:
                    continue
                seen.add(node)
                first = len(s) - -(-3 * len(s) // 4) + 1
                common = frequent[(s >> np.uint64(32) & np.uint64(COUNTERS - 1)).astype(np.int64)]
                rare, hot = s[~common][:first] & ~np.uint64(1), s[common]
                hot = hot[: first - len(rare)] >> salt_bits << salt_bits | np.uint64(node % salts << 1 | 1)
                keys += [rare, hot]
                nodes.append(node)
                sizes.append(first)
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.repeat(np.array(nodes, np.int64), sizes))], ["key", "node"])

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Sorted by key and node.  Of a group that goes on in the next batch only the last row, and the pivot, are kept back.
        held = pivot = None
        grown = False
        for batch in batches:
            key, node = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(key):
                continue
            if held is not None:
                key, node = np.concatenate((held[:1], key)), np.concatenate((held[1:], node))
            fresh = np.ones(len(key), bool)
            fresh[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
            key, node = key[fresh], node[fresh]
            opens = np.ones(len(key), bool)
            opens[1:] = key[1:] != key[:-1]
            first = np.maximum.accumulate(np.where(opens, np.arange(len(key)), 0))
            pivots = node[first]
            size_two = np.zeros(len(key), bool)
            size_two[1:] = ~opens[1:]
            size_two[:-1] |= ~opens[1:]
            if held is not None:
                pivots[first == 0] = pivot
                size_two[0] |= grown
            out = size_two | (key & 1 == 1)
            held, pivot, grown = np.array([key[-1], node[-1]]), pivots[-1], bool(size_two[-1])
            out[-1] = False
            if out.any():
                yield pa.RecordBatch.from_arrays([pa.array(x[out]) for x in (key, node, pivots)], ["key", "node", "pivot"])
        if held is not None and (grown or held[0] & 1):
            yield pa.RecordBatch.from_arrays([pa.array([int(x)], pa.int64()) for x in (*held, pivot)], ["key", "node", "pivot"])

    rows = docs.select("text").mapInArrow(dealt, "key long, node long")
    return rows.repartition("key").sortWithinPartitions("key", "node").mapInArrow(shared, "key long, node long, pivot long")


def counted(rows: DataFrame) -> DataFrame:
    """A written table, with a hint to broadcast it if it is counted to be small."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def trees(docs: DataFrame, frequent: np.ndarray, key: bytes, folder: str) -> DataFrame:
    """key, node: the points of every tree; a tree is named by its least point."""
    salts = min(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), (1 << 63 - SHINGLE_BITS) - 1)
    with scratch(docs.sparkSession) as own:
        found = materialised(cells(docs, frequent, key, salts), own)
        salted = found.where("key % 2 <> 0").withColumn("key", F.shiftright("key", 64 - SHINGLE_BITS))
        least = materialised(salted.groupBy("key").agg(F.min("pivot").alias("least"), F.min("node").alias("one"), F.max("node").alias("other")).where("one < other").select("key", "least"), own)
        joined = salted.join(counted(least), "key").select(F.col("least").alias("key"), "node")
        return materialised(found.where("key % 2 = 0").select(F.col("pivot").alias("key"), "node").unionByName(joined).distinct(), folder)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """The rows again, in batches of about FOREST that end where a group of rows with equal first columns ends."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) < FOREST:
            continue
        whole = pa.concat_batches(held)
        names = np.stack([whole.column(c).to_numpy() for c in range(keys)])
        cut = int(np.flatnonzero((names[:, 1:] != names[:, :-1]).any(0)).max(initial=-1)) + 1
        if cut:
            yield whole.slice(0, cut)
        held = [whole.slice(cut)]
    if held:
        yield pa.concat_batches(held)


def numbered(*names: np.ndarray) -> np.ndarray:
    """0, 0, 1, ...: the number of the group that each row of sorted groups is in."""
    opens = np.zeros(len(names[0]), np.int64)
    for x in names:
        opens[1:] |= x[1:] != x[:-1]
    return np.cumsum(opens)


def steps(tree: np.ndarray, width: int) -> Iterator[slice]:
    """Slices of sorted trees that make no more than CELLS counts of that width, or are one tree."""
    first = np.append(np.flatnonzero(np.append(True, tree[1:] != tree[:-1])), len(tree))
    k = 0
    while k < len(first) - 1:
        to = max(k + 1, int(np.searchsorted(first, first[k] + CELLS // width, "right")) - 1)
        yield slice(int(first[k]), int(first[to]))
        k = to


def pair_batch(node: np.ndarray, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(node[i], node[j])), pa.array(np.maximum(node[i], node[j]))], ["a", "b"])


def middles(counts: pa.Array, n: np.ndarray, tree: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows: each with the middle one of its tree, as far as the bound leaves them.

    The middle row is the one nearest to the mean counts of those rows whose sizes
    can link to the tree's middle size; in a tree of one leaf it is the wanted row.
    """
    by_size = np.lexsort((n, tree))
    size = np.bincount(tree)
    first = np.cumsum(size) - size
    middle_size = n[by_size][first + size // 2][tree]
    near = (4 * n >= 3 * middle_size) & (4 * middle_size >= 3 * n)
    resolution = np.array([n_groups(int(x)) for x in range(1, 5000)])[np.minimum(middle_size, 4999) - 1]
    a, b = [], []
    for width in np.unique(resolution[near]):
        rows = np.flatnonzero(near & (resolution == width))
        for step in steps(tree[rows], int(width)):
            row = rows[step]
            t = numbered(tree[row])
            v = vectors([counts[int(r)].as_py() for r in row], n[row])
            opens = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
            mean = np.add.reduceat(v, opens).astype(np.float32) / np.diff(np.append(opens, len(t)))[:, None]
            far = np.concatenate([np.abs(v[k : k + 512] - mean[t[k : k + 512]]).sum(1) for k in range(0, len(v), 512)])
            far[wanted[row] & (size[tree[row]] <= LEAF)] = -1
            middle = np.lexsort((far, t))[opens][t]
            i = np.flatnonzero(middle != np.arange(len(t)))
            i = i[possible(v, n[row], i, middle[i])]
            a.append(row[i])
            b.append(row[middle[i]])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def middle_pairs(members: DataFrame, sizes: DataFrame) -> DataFrame:
    """key, node, middle: each point of a tree with its middle one, or that of its block of a large tree, as far as the bound leaves them; members: key, node, n, counts, sizes: key, size of large trees."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_groups(batches, 2):
            key, own, node, n = (batch.column(k).to_numpy() for k in range(4))
            i, j = middles(batch.column(4), n, numbered(key, own), key == node)
            yield pa.RecordBatch.from_arrays([pa.array(key[i]), pa.array(node[i]), pa.array(node[j])], ["key", "node", "middle"])

    rows = members.join(sizes, "key", "left").select("key", block(BLOCK, F.coalesce("size", F.lit(1))).alias("own"), "node", "n", "counts")
    return rows.repartition("key", "own").sortWithinPartitions("key", "own").mapInArrow(search, "key long, node long, middle long")


def first_pairs(members: DataFrame, vectors_of: DataFrame, folder: str) -> DataFrame:
    """Distinct pairs (a, b) of middle_pairs(); the middle points of a large tree's blocks are the points of a tree in turn, until it has one block."""
    pairs = []
    while True:
        sizes = counted(materialised(members.groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > BLOCK), folder))
        found = materialised(middle_pairs(members.join(vectors_of, "node"), sizes), folder)
        pairs.append(found.select(F.least("node", "middle").alias("a"), F.greatest("node", "middle").alias("b")))
        if not sizes.limit(1).count():
            return reduce(DataFrame.union, pairs).distinct()
        members = materialised(found.join(sizes, "key", "left_semi").select("key", F.col("middle").alias("node")).distinct(), folder)


def block(size: int, of: Column) -> Column:
    return F.pmod(F.xxhash64("node"), F.greatest(F.ceil(of / size), F.lit(1))).cast("int")


def bands(n: np.ndarray) -> np.ndarray:
    """Size bands, each a third wider than the one before: sets that can link are in one or in neighbouring ones."""
    return np.floor(np.log(n) / np.log(4 / 3) + 1e-9).astype(np.int64)


def tree_pairs(members: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) of points of different classes that the trees leave; members: key, node, n, counts, class, and of a tree that is cut (else null): main (whether the point is of its largest class), mains and others (how many are, how many are not).

    In its task every point is put in its size band and the one before, and each
    band of a tree is packed by itself: its points are counted in much the same groups.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_groups(batches, 3):
            key, low, high, own, node, n, group = (batch.column(k).to_numpy() for k in range(7))
            tree, counts, band = numbered(key, low, high), batch.column(7), bands(n)
            for one in np.unique(np.concatenate((band - 1, band))):
                rows = np.flatnonzero((band == one) | (band - 1 == one))
                # Trees of one point, or one class, have no pairs here.
                of = numbered(tree[rows])
                first = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
                rows = rows[(np.minimum.reduceat(group[rows], first) < np.maximum.reduceat(group[rows], first))[of]]
                for step in steps(tree[rows], n_groups(int(n[rows].min()))) if len(rows) else ():
                    row = rows[step]
                    i, j = RTrees(vectors([counts[int(r)].as_py() for r in row], n[row]), n[row], group[row], tree[row]).pairs()
                    i, j = row[i], row[j]
                    across = (low[i] == high[i]) | (own[i] != own[j])
                    yield pair_batch(node, i[across], j[across])

    n_main, n_other = (F.when(F.col(c) > 0, F.ceil(F.col(c) / BLOCK)).otherwise(0).cast("int") for c in ("mains", "others"))
    # Blocks of the largest class come first and meet those of the others only.
    own = F.when(F.col("main"), block(BLOCK, F.col("mains"))).when(~F.col("main"), n_main + block(BLOCK, F.col("others"))).otherwise(0)
    others = F.when(F.col("main"), F.sequence(n_main, n_main + n_other - 1)).when(~F.col("main"), F.sequence(F.lit(0), n_main + n_other - 1)).otherwise(F.array(F.lit(0)))
    rows = members.withColumn("own", own).withColumn("other", F.explode(others)).select("key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "node", "n", "class", "counts")
    return rows.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high").mapInArrow(search, "a long, b long").distinct()


def texts_of(pairs: DataFrame, points: DataFrame, docs: DataFrame, folder: str) -> DataFrame:
    """node, text of the pairs' ends; the point's name tells a row that it stands for."""
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    named = nodes.join(points.select("node", F.col("name.a").alias("name_a"), F.col("name.b").alias("name_b")), "node")
    rows = docs.select("text", row_name().alias("name")).select("text", F.col("name.a").alias("name_a"), F.col("name.b").alias("name_b"))
    return materialised(rows.join(counted(materialised(named, folder)), ["name_a", "name_b"]).dropDuplicates(["name_a", "name_b"]).select("node", "text"), folder)


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts' sets link, compared word by word."""

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = sum(np.asarray(pc.binary_length(batch.column(k)), np.int64) for k in (2, 3))
            total, at = np.concatenate(([0], np.cumsum(sizes))), 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(total, total[at] + VERIFIED_BYTES, "right")) - 1)
                part = batch.slice(at, to - at)
                at = to
                a, b = part.column(0).to_numpy(), part.column(1).to_numpy()
                node, first = np.unique(np.concatenate((a, b)), return_index=True)
                texts = pa.concat_arrays([part.column(2).cast(pa.large_string()), part.column(3).cast(pa.large_string())]).take(pa.array(first))
                sets = exact_shingle_sets(Words(texts))
                fine = []
                for x, y in zip(np.searchsorted(node, a).tolist(), np.searchsorted(node, b).tolist(), strict=True):
                    both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                    fine.append(100 * both >= 75 * (len(sets[x]) + len(sets[y]) - both))
                yield pa.RecordBatch.from_arrays([c.filter(pa.array(fine, pa.bool_())) for c in part.columns[:2]], ["a", "b"])

    joined = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
    return joined.select("a", "b", "ta", "tb").mapInArrow(linked, "a long, b long")


def mixed_trees(members: DataFrame, folder: str) -> DataFrame:
    """members (key, node, class) of those trees that hold several classes, and what tree_pairs() needs to cut large ones."""
    of = members.groupBy("key", "class").agg(F.count("*").alias("points"))
    stats = of.groupBy("key").agg(F.sum("points").alias("size"), F.max(F.struct("points", "class")).alias("largest"), F.count("*").alias("classes"))
    stats = materialised(stats.where("classes > 1").select("key", F.when(F.col("size") > BLOCK, F.struct(F.col("largest.class").alias("class"), F.col("largest.points").alias("mains"), (F.col("size") - F.col("largest.points")).alias("others"))).alias("cut")), folder)
    return members.join(counted(stats), "key").select("key", "node", "class", (F.col("class") == F.col("cut.class")).alias("main"), F.col("cut.mains").alias("mains"), F.col("cut.others").alias("others"))


def link_counts(members: DataFrame, docs: DataFrame, folder: str) -> DataFrame:
    """node, links: how many documents with other sets each point of a class links to; members: node, class, n, copies, name of all points.

    Links lie inside classes.  The points of a class are dealt over blocks of about
    GROUP shingles, and each two blocks meet in one group, whose texts are compared all
    with all: the overlaps of a group are a product of incidence matrices.  A class
    that is one block is one group.
    """
    sized = members.groupBy("class").agg(F.count("*").alias("points"), F.sum("n").alias("shingles")).where("points > 1")
    blocks = F.ceil(F.col("shingles") / GROUP).cast("int")
    placed = materialised(members.join(sized.select("class", blocks.alias("blocks")), "class").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")), folder)
    named = counted(materialised(placed.select("node", F.col("name.a").alias("name_a"), F.col("name.b").alias("name_b")), folder))
    rows = docs.select("text", row_name().alias("name")).select("text", F.col("name.a").alias("name_a"), F.col("name.b").alias("name_b"))
    texts = materialised(rows.join(named, ["name_a", "name_b"]).dropDuplicates(["node"]).select("node", "text"), folder)
    met = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("class", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "node", "copies")
    groups = met.join(texts, "node").select("class", "low", "high", "own", "node", "copies", "text").repartition("class", "low", "high").sortWithinPartitions("class", "low", "high")

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_groups(batches, 3):
            group = numbered(*(batch.column(k).to_numpy() for k in range(3)))
            own, node, copies = (batch.column(k).to_numpy() for k in (3, 4, 5))
            inner = batch.column(1).to_numpy() == batch.column(2).to_numpy()
            edges = np.append(np.flatnonzero(np.append(True, group[1:] != group[:-1])), len(group))
            found = np.zeros(len(node), np.int64)
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                sets = exact_shingle_sets(Words(batch.column(6).slice(a, b - a).cast(pa.large_string())))
                n = np.array([len(x) for x in sets])
                both = overlaps(sets)
                linked = 100 * both >= 75 * (n[:, None] + n[None] - both)
                np.fill_diagonal(linked, False)
                if not inner[a]:
                    linked &= own[a:b, None] != own[None, a:b]
                found[a:b] = linked @ copies[a:b]
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(found)], ["node", "links"])

    return groups.mapInArrow(searched, "node long, links long").groupBy("node").agg(F.sum("links").alias("links"))


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """The sizes of all intersections of some sets of numbers."""
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, number, times = np.unique(np.concatenate([np.zeros(0, np.int64), *sets]), return_inverse=True, return_counts=True)
    # What only one set has is in no intersection.
    common = times > 1
    name = np.cumsum(common) - 1
    keep = common[number]
    owner, number = owner[keep], name[number[keep]]
    order = np.argsort(number, kind="stable")
    owner, number = owner[order], number[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    width = max(64, (1 << 22) // max(1, len(sets)))
    for at in range(0, int(common.sum()), width):
        low, high = np.searchsorted(number, (at, at + width))
        part = np.zeros((len(sets), width), np.float32)
        part[owner[low:high], number[low:high] - at] = 1
        out += part @ part.T
    return out.astype(np.int64)


def jaccard_classes(docs: DataFrame, keep: tuple[str, ...] = (), links: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs; with links, n_links: how many other rows of docs it links to, copies included; with keep, these columns too, and class: a number of its own for each class, with ids or without (null: an empty set, in no class)."""
    with scratch(docs.sparkSession) as folder:
        return materialised(_classes(docs, keep, links, folder))


def _classes(docs: DataFrame, keep: tuple[str, ...], links_too: bool, folder: str) -> DataFrame:
    while True:
        key = secrets.token_bytes(32)
        rows = materialised(sketches(docs, key, keep), folder)
        named = rows.where("kind = 0 and n > 0")
        points = materialised(
            named.groupBy("node").agg(F.min("doc_id").alias("row"), F.first("n").alias("n"), F.first("counts").alias("counts"), F.min("row_name").alias("name"), (F.max("check") != F.min("check")).alias("clash"), F.count("*").alias("copies")), folder
        )
        if not points.where("clash").limit(1).count():
            break
        # Two sets share 64 bits of their names: take other names.
    members = trees(docs, frequency_table(rows.where("kind = 1")), key, folder)
    vectors_of = points.select("node", "n", "counts")
    tried = materialised(first_pairs(members, vectors_of, folder), folder)
    links = materialised(verified(tried, texts_of(tried, points, docs, folder)), folder)
    spread = materialised(members.join(connected(links, folder), "node", "left").withColumn("class", F.coalesce("class", "node")), folder)
    pairs = materialised(tree_pairs(mixed_trees(spread, folder).join(vectors_of, "node")).join(tried, ["a", "b"], "left_anti"), folder)
    links = links.unionByName(materialised(verified(pairs, texts_of(pairs, points, docs, folder)), folder))
    whole = points.select("node", "row").join(connected(links, folder), "node", "left").withColumn("class", F.coalesce("class", "node"))
    least = whole.groupBy("class").agg(F.min("row").alias("component_id"))
    named_by = whole.join(least, "class").select("node", "component_id", "class")
    if links_too:
        members = materialised(whole.join(points.select("node", "n", "copies", "name"), "node").select("node", "class", "n", "copies", "name"), folder)
        every = members.select("node", "copies").join(link_counts(members, docs, folder), "node", "left")
        named_by = named_by.join(every.select("node", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "node")
    return (
        rows.where("kind = 0")
        .withColumn("node", F.when(F.col("n") > 0, F.col("node")))
        .join(named_by, "node", "left")
        .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), *([F.coalesce("n_links", F.lit(0)).alias("n_links")] if links_too else []), *((*keep, "class") if keep else ()))
    )
