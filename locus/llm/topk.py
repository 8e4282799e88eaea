"""Exact top-k inner products over a bit-sliced index.

Each component x becomes floor(64 * x).  A block of rows is indexed by slices: for
every attribute and every bit of it (above the attribute's least value in the
block) a bitmap over the rows.  A query's score is a sum of slices: bit j of its
component times bit b of the attribute weighs 2**(j + b), and for a negative
component the slice is complemented, which a constant makes good.  Carry-save
adders add all those bitmaps weight by weight, so the scores of all rows come out
sliced in turn.  From the most significant slice downward a query keeps the rows
that have the bit set as long as they are more than k, and takes them all once
they are not; rows that still tie at the boundary are resolved by the smaller id.

Every block meets every query block, and a block's best k are merged by a window.
Slices are as many as the numbers need, so no component is too large: ranks are
exact always, and ``score`` is null where the number is beyond 64 bits.  Vectors
that are null, or hold null or non-finite components, take no part (nor do those
of which 64 times a component is beyond a double), nor do rows with a null id.
Missing components of shorter vectors count as zero.  Rows sharing the query's id
are its own and no candidates of it; an id with several query rows is asked once,
with the least vector.  Other repeated rows are candidates of their own.  Extra
columns are ignored, an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ROWS, ASKED = 8192, 256
#: Rows are dealt over stripes of about this many vectors; few rows are dealt over STRIPES, for the sake of parallel work.
STRIPE_ROWS, STRIPES = 4 * ROWS, 24


def quantised(vectors: DataFrame) -> DataFrame:
    """vec_id and q (array of double, whole numbers), for rows that take part."""
    x = F.transform("embedding", lambda v: v.cast("double") * 64)
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    # Doubles of 2**52 and more are whole, and some of them beyond what floor() can return.
    whole = F.transform(x, lambda v: F.when(F.abs(v) < 2.0**52, F.floor(v).cast("double")).otherwise(v))
    return vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & fine).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("q"))


def integers(q: np.ndarray) -> np.ndarray:
    """Whole doubles as int64, or as Python integers where those could overflow."""
    if np.abs(q).max(initial=0) < 2.0**61:
        return q.astype(np.int64)
    return np.array([[int(v) for v in row] for row in q], object).reshape(q.shape)


def bitmap(flags: np.ndarray) -> np.ndarray:
    """Boolean columns as rows of 64-bit words, row r at bit r % 64 of word r // 64."""
    n = flags.shape[0]
    padded = np.zeros((-(-n // 64) * 64, flags.shape[1]), bool)
    padded[:n] = flags
    return np.packbits(np.ascontiguousarray(padded.T), axis=1, bitorder="little").view(np.uint64)


class SlicedRows:
    """The bit-sliced index of a block: q holds whole numbers, a row a vector."""

    def __init__(self, q: np.ndarray):
        self.rows = len(q)
        self.low = [int(v) for v in q.min(axis=0)]
        raised = q - q.min(axis=0)
        self.width = [int(v).bit_length() for v in raised.max(axis=0)]
        self.attribute = np.repeat(np.arange(q.shape[1]), self.width)
        self.bit = np.concatenate([np.zeros(0, np.int64), *(np.arange(w) for w in self.width)])
        bits = (raised[:, d, None] >> np.arange(w).astype(raised.dtype) & 1 for d, w in enumerate(self.width))
        self.slices = np.concatenate([np.zeros((0, -(-self.rows // 64)), np.uint64), *(bitmap(b != 0) for b in bits)])

    def scores(self, v: np.ndarray) -> tuple[list[np.ndarray], int]:
        """The slices of the inner products with v, least significant first, and the constant to be added to them."""
        values = [int(x) for x in v]
        base = sum(x * low for x, low in zip(values, self.low, strict=True)) - sum(-x * ((1 << w) - 1) for x, w in zip(values, self.width, strict=True) if x < 0)
        negative, size = (v < 0)[self.attribute], abs(v)
        signed = np.where(negative[:, None], ~self.slices, self.slices)
        chosen, weight = [], []
        for j in range(max((abs(x).bit_length() for x in values), default=0)):
            at = np.flatnonzero((size >> j & 1).astype(bool)[self.attribute])
            chosen.append(at)
            weight.append(self.bit[at] + j)
        if not chosen:
            return [], base
        chosen, weight = np.concatenate(chosen), np.concatenate(weight)
        by_weight = np.argsort(weight, kind="stable")
        bounds = np.searchsorted(weight[by_weight], np.arange(int(weight.max(initial=-1)) + 2))
        return added([signed[chosen[by_weight[a:b]]] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]), base


def added(levels: list[np.ndarray]) -> list[np.ndarray]:
    """The sum's slices; levels: for each power of two the bitmaps that weigh it."""
    out, carried, w = [], None, 0
    while w < len(levels) or carried is not None:
        rows = levels[w] if w < len(levels) else carried[:0]
        rows = rows if carried is None else np.concatenate((rows, carried))
        carries = []
        while len(rows) > 1:
            m = max(1, len(rows) // 3)
            a, b = rows[:m], rows[m : 2 * m]
            either = a ^ b
            if len(rows) == 2:
                carries.append(a & b)
                rows = either
            else:
                c = rows[2 * m : 3 * m]
                carries.append((a & b) | (either & c))
                rows = np.concatenate((either ^ c, rows[3 * m :]))
        out.append(rows[0] if len(rows) else np.zeros(levels[0].shape[1], np.uint64))
        carried = np.concatenate(carries) if carries else None
        w += 1
    return out


def select(slices: list[np.ndarray], able: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best rows (all, if fewer) among those in the bitmap able, ties to earlier rows."""
    sure, maybe = np.zeros_like(able), able
    left = k
    for s in reversed(slices):
        both = maybe & s
        n = int(np.bitwise_count(both).sum())
        if n > left:
            maybe = both
        else:
            sure, maybe, left = sure | both, maybe & ~s, left - n
            if not left:
                break
    sure, maybe = (np.flatnonzero(np.unpackbits(x.view(np.uint8), bitorder="little")) for x in (sure, maybe))
    return np.sort(np.concatenate((sure, maybe[:left])))


def values_at(slices: list[np.ndarray], rows: np.ndarray, base: int) -> list[int]:
    """The whole numbers that the slices hold for those rows."""
    out = [base] * len(rows)
    for w, s in enumerate(slices):
        for k, bit in enumerate((s[rows >> 6] >> (rows & 63).astype(np.uint64) & np.uint64(1)).tolist()):
            if bit:
                out[k] += 1 << w
    return out


def order_key(value: int) -> bytes:
    """Bytes that compare as the numbers do, of any size."""
    n = (abs(value).bit_length() + 7) // 8
    if value >= 0:
        return (32768 + n).to_bytes(2, "big") + value.to_bytes(n, "big")
    return (32767 - n).to_bytes(2, "big") + ((1 << 8 * n) - 1 + value).to_bytes(n, "big")


def _blocks(rows: DataFrame, size: int, *keys: str) -> DataFrame:
    """Rows (keys, vec_id, q) packed where they lie in blocks of at most size, of one value of the keys each: the keys, dims, ids and numbers as bytes."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, held_key = [], None

        def block() -> Iterator[pa.RecordBatch]:
            part = pa.Table.from_batches(held).combine_chunks()
            lists = part["q"].chunk(0)
            lengths = np.asarray(lists.value_lengths())
            q = np.zeros((len(lists), max(1, int(lengths.max()))))
            q[np.arange(q.shape[1]) < lengths[:, None]] = lists.flatten().to_numpy()
            ids = part["vec_id"].to_numpy()
            order = np.argsort(ids, kind="stable")
            yield pa.RecordBatch.from_pydict({**{k: pa.array([part[k][0].as_py()], pa.int32()) for k in keys}, "dims": pa.array([q.shape[1]], pa.int32()), "ids": [ids[order].tobytes()], "numbers": [q[order].tobytes()]})

        count = 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                key = tuple(batch.column(k)[at].as_py() for k in range(len(keys)))
                if held and (key != held_key or count == size):
                    yield from block()
                    held, count = [], 0
                held_key = key
                to = min(batch.num_rows, at + size - count)
                for k in range(len(keys)):
                    same = np.asarray(batch.column(k).slice(at, to - at)) == key[k]
                    to = at + (int(np.argmin(same)) if not same.all() else len(same))
                held.append(batch.slice(at, to - at))
                count += to - at
                at = to
        if held:
            yield from block()

    return rows.select(*keys, "vec_id", "q").mapInArrow(packed, ", ".join([*(f"{k} int" for k in keys), "dims int", "ids binary", "numbers binary"]))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """query_id, rank (from 1), vec_id, score, order_key (bytes that compare as exact scores do): each query's k best rows of vectors; both tables have vec_id and embedding."""
    stripes = max(STRIPES, vectors.count() // STRIPE_ROWS)
    stripe = F.pmod(F.xxhash64("vec_id", "q", F.monotonically_increasing_id() % stripes), F.lit(stripes)).cast("int")
    dealt = quantised(vectors).withColumn("stripe", stripe).repartition(stripes, "stripe").sortWithinPartitions("stripe")
    index = _blocks(dealt, ROWS, "stripe")
    asked = quantised(queries).groupBy("vec_id").agg(F.min("q").alias("q"))
    every = F.explode(F.sequence(F.lit(0), F.lit(stripes - 1))).alias("stripe")
    questions = _blocks(asked, ASKED).select(F.col("dims").alias("asked_dims"), F.col("ids").alias("asked_ids"), F.col("numbers").alias("asked_numbers"), every)

    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, index = None, None
        for batch in batches:
            for r in range(batch.num_rows):
                dims, asked_dims = batch.column(0)[r].as_py(), batch.column(3)[r].as_py()
                ids, numbers, asked_ids, asked_numbers = (np.frombuffer(batch.column(c)[r].as_buffer(), t) for c, t in ((1, np.int64), (2, np.float64), (4, np.int64), (5, np.float64)))
                both = max(dims, asked_dims)
                if last is None or last[0] != both or not np.array_equal(last[1], ids) or not np.array_equal(last[2], numbers):
                    rows = np.zeros((len(ids), both))
                    rows[:, :dims] = numbers.reshape(len(ids), dims)
                    last, index = (both, ids.copy(), numbers.copy()), SlicedRows(integers(rows))
                    whole = bitmap(np.ones((len(ids), 1), bool))[0]
                vs = np.zeros((len(asked_ids), both))
                vs[:, :asked_dims] = asked_numbers.reshape(len(asked_ids), asked_dims)
                query, found, score = [], [], []
                for one, v in zip(asked_ids.tolist(), integers(vs), strict=True):
                    slices, base = index.scores(v)
                    able = whole
                    own = np.arange(np.searchsorted(ids, one), np.searchsorted(ids, one, "right"))
                    if len(own):
                        flags = np.ones((len(ids), 1), bool)
                        flags[own] = False
                        able = bitmap(flags)[0]
                    at = select(slices, able, k)
                    query += [one] * len(at)
                    found.append(ids[at])
                    score += values_at(slices, at, base)
                fits = [s if -(2**63) <= s < 2**63 else None for s in score]
                yield pa.RecordBatch.from_pydict({"query_id": pa.array(query, pa.int64()), "vec_id": pa.array(np.concatenate(found)), "score": pa.array(fits, pa.int64()), "order_key": pa.array(map(order_key, score), pa.binary())})

    found = index.join(questions, "stripe").select("dims", "ids", "numbers", "asked_dims", "asked_ids", "asked_numbers").mapInArrow(answered, "query_id long, vec_id long, score long, order_key binary")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("order_key"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "order_key")
