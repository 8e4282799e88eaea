"""Hard-negative mining by distributed radix selection.

Rows are vectors of whole numbers with a label; a row's score is its inner product
with an anchor, higher scores come first, ties by the smaller id.  An anchor's
positives are its first ``positives`` other rows of the same label; the negatives of
an anchor and a positive are the first ``negatives`` rows of other labels within a
window of scores that the positive's score sets.

Both are selections of the k-th score in a window, made alike.  Vectors are packed in
blocks, and every block of anchors meets every block of rows (score matrices inside
tasks).  In each round a task counts, for each window, the scores by their next digit,
from the top of the window down, and tells the counts as far as the k-th score can be;
Spark sums them and finds the digit that the k-th score has.  After the last digit the
k-th score is known, and one more pass gathers the rows that score higher, which are
fewer than k, and of those that score the same the ones with the smallest ids, at most
k of each task.  So what travels is bounded by k a window and task, however many rows
tie or fall into a window, and no scores are ever sorted.

Scores are exact: sums that could pass 2**53 are taken with Python integers.  A digit
path, not a number, names the part of the window that a round looks at, so windows
may be of any width; results beyond 64 bits are null.  Every block of anchors is
copied to every stripe of rows, since each anchor may have its positives and negatives
anywhere: with as many anchors as a share of the rows the work is their product.

Rows with a null id, label or vector, or null or non-finite components, take no part.
Missing components of shorter vectors count as zero.  Rows that share the anchor's id
are the anchor's own, neither positives nor negatives; an anchor's id with several rows
is asked once, with the least label and vector.  Other repeated rows count each.
Anchors without positives, and positives without negatives, have no rows.  Extra
columns are ignored, an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locus.llm.topk import integers, order_key
from locus.sources.shared import materialised, scratch

#: Rows of a block, anchors of a block; rows are dealt over stripes of about STRIPE_ROWS, few rows over STRIPES.
ROWS, ASKED, STRIPE_ROWS, STRIPES = 8192, 128, 4 * 8192, 24
#: Bits of a digit.
DIGIT = 12


def quantised(vectors: DataFrame, scale: int, label: Column) -> DataFrame:
    """vec_id, label and q (array of double, whole numbers), for rows that take part."""
    x = F.transform("embedding", lambda v: v.cast("double") * scale)
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    whole = F.transform(x, lambda v: F.when(F.abs(v) < 2.0**52, F.floor(v).cast("double")).otherwise(v))
    able = F.col("vec_id").isNotNull() & label.isNotNull() & F.col("embedding").isNotNull() & fine
    return vectors.where(able).select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), whole.alias("q"))


def blocks(rows: DataFrame, size: int) -> DataFrame:
    """Rows (vec_id, label, q) packed where they lie, at most size in a block, sorted by id: stripe (the partition's number), dims, ids, labels, numbers as bytes, id_list."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def block() -> pa.RecordBatch:
            part = pa.Table.from_batches(held).combine_chunks()
            lists, ids, labels = part["q"].chunk(0), part["vec_id"].to_numpy(), part["label"].to_numpy()
            lengths = np.asarray(lists.value_lengths())
            q = np.zeros((len(lists), max(1, int(lengths.max()))))
            q[np.arange(q.shape[1]) < lengths[:, None]] = lists.flatten().to_numpy()
            order = np.argsort(ids, kind="stable")
            return pa.RecordBatch.from_pydict({
                "stripe": pa.array([TaskContext.get().partitionId()], pa.int32()), "dims": pa.array([q.shape[1]], pa.int32()), "ids": [ids[order].tobytes()], "labels": [labels[order].tobytes()], "numbers": [q[order].tobytes()],
                "id_list": pa.array([ids[order]], pa.list_(pa.int64())),
            })

        count = 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, size - count)
                held.append(part)
                at, count = at + part.num_rows, count + part.num_rows
                if count == size:
                    yield block()
                    held, count = [], 0
        if held:
            yield block()

    return rows.select("vec_id", "label", "q").mapInArrow(packed, "stripe int, dims int, ids binary, labels binary, numbers binary, id_list array<long>")


class Block:
    """Vectors of a packed block."""

    def __init__(self, dims: int, ids: bytes, labels: bytes, numbers: bytes):
        self.ids, self.labels = np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64)
        self.q = np.frombuffer(numbers).reshape(len(self.ids), dims)

    def scores(self, other: Block) -> np.ndarray:
        """Inner products, a row for each of ours and a column for each of the other's: int64, or Python integers where that could overflow."""
        dims = min(self.q.shape[1], other.q.shape[1])
        a, b = self.q[:, :dims], other.q[:, :dims]
        if np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * dims < 2.0**53:
            return (a @ b.T).astype(np.int64)
        return np.array([[sum(x * y for x, y in zip(r, s, strict=True)) for s in integers(b).astype(object).tolist()] for r in integers(a).astype(object).tolist()], object).reshape(len(a), len(b))


class Span:
    """A range of scores, cut into digits from its top down: high is its greatest, low its least score."""

    def __init__(self, low: int, high: int, path: list[int]):
        self.low, self.high = low, high
        self.shift = max(0, (high - low).bit_length() - DIGIT) if high > low else 0
        for digit in path:
            self.high -= digit << self.shift
            self.low = max(self.low, self.high - (1 << self.shift) + 1)
            self.shift = max(0, self.shift - DIGIT)

    def digits(self, scores: np.ndarray) -> np.ndarray:
        if max(abs(self.high), abs(self.low)) >= 1 << 62:
            scores = scores.astype(object)
        return ((self.high - scores) >> self.shift).astype(np.int64)


def rounds(low: int, high: int) -> int:
    """How many digits tell a score of that range."""
    return 1 + max(0, -(-((high - low).bit_length() - DIGIT) // DIGIT))


#: What a packed block is made of.
PACKED = ("dims", "ids", "labels", "numbers")
Emit = Callable[["Block", "Block", list, np.ndarray, bool], Iterator[pa.RecordBatch]]


def meet(index: DataFrame, questions: DataFrame, work: Emit, schema: str, same: bool) -> DataFrame:
    """work(rows, anchors, windows, scores, same) for every pair of a block of rows and a block of anchors.

    A window has the anchor's place in its block, its own number, the bounds of its scores,
    the path of digits known so far, how many rows are looked for (left) among those that
    the path names, and whether the window has fewer rows than that (ends).
    """

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                value = [batch.column(c)[k].as_py() for c in range(batch.num_columns)]
                rows, anchors = Block(*value[:4]), Block(*value[4:8])
                yield from work(rows, anchors, value[8], rows.scores(anchors), same)

    asked = questions.select("stripe", *(F.col(c).alias(f"asked_{c}") for c in PACKED), "windows")
    return index.join(asked, "stripe").select(*PACKED, *(f"asked_{c}" for c in PACKED), "windows").mapInArrow(met, schema)


def candidates(rows: Block, anchors: Block, i: int, same: bool) -> np.ndarray:
    alike = rows.labels == anchors.labels[i]
    return np.flatnonzero((alike if same else ~alike) & (rows.ids != anchors.ids[i]))


def count_digits(rows: Block, anchors: Block, windows: list, scores: np.ndarray, same: bool) -> Iterator[pa.RecordBatch]:
    """anchor_id, number, digit, count: for each window the counts of digits, down to where this block alone has as many as are looked for."""
    out, last, able = [], None, None
    for w in windows:
        if w["ends"]:
            continue
        if w["anchor"] != last:
            last, able = w["anchor"], candidates(rows, anchors, w["anchor"], same)
            column = scores[able, last]
        span = Span(int(w["low"]), int(w["high"]), w["path"])
        digit = span.digits(column[(column >= span.low) & (column <= span.high)])
        if len(digit):
            counts = np.bincount(digit)
            found = np.flatnonzero(counts)
            found = found[: int(np.searchsorted(np.cumsum(counts[found]), w["left"])) + 1]
            out.append((int(anchors.ids[last]), w["number"], found, counts[found]))
    size = [len(o[2]) for o in out]
    yield pa.RecordBatch.from_arrays([
        pa.array(np.repeat(np.array([o[0] for o in out], np.int64), size)), pa.array(np.repeat(np.array([o[1] for o in out], np.int32), size)),
        pa.array(np.concatenate([np.zeros(0, np.int64), *(o[2] for o in out)]).astype(np.int32)), pa.array(np.concatenate([np.zeros(0, np.int64), *(o[3] for o in out)])),
    ], ["anchor_id", "number", "digit", "count"])


def gather(least: int, most: int) -> Emit:
    """anchor_id, number, vec_id, score, order_key, low, high: rows above the score that a window's digits name, and those at it with the smallest ids; low and high: the scores of which 100 times lies from least to most times the row's."""

    def gathered(rows: Block, anchors: Block, windows: list, scores: np.ndarray, same: bool) -> Iterator[pa.RecordBatch]:
        out, last, able = [], None, None
        for w in windows:
            if w["anchor"] != last:
                last, able = w["anchor"], candidates(rows, anchors, w["anchor"], same)
                column = scores[able, last]
            low, top = int(w["low"]), int(w["high"])
            if w["ends"]:
                at = np.flatnonzero((column >= low) & (column <= top))
            else:
                score = Span(low, top, w["path"]).high
                at = np.concatenate((np.flatnonzero((column > score) & (column <= top)), np.flatnonzero(column == score)[: w["left"]]))
            out += [(int(anchors.ids[last]), w["number"], int(rows.ids[able[r]]), int(column[r])) for r in at]
        bounds = [(-(-least * s // 100), most * s // 100) for *_, s in out]
        columns = [[o[0] for o in out], [o[1] for o in out], [o[2] for o in out], [s if -(2**63) <= s < 2**63 else None for *_, s in out], [order_key(s) for *_, s in out], [str(a) if a <= b else None for a, b in bounds], [str(b) for _, b in bounds]]
        types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["anchor_id", "number", "vec_id", "score", "order_key", "low", "high"])

    return gathered


def select(index: DataFrame, anchors: DataFrame, windows: DataFrame, k: int, stripes: int, same: bool, n_rounds: int, bounds: tuple[int, int], folder: str) -> DataFrame:
    """anchor_id, number, rank, vec_id, score, low, high: the first k rows of every window (block, anchor, anchor_id, number, low, high) among rows of the anchor's label, or of others."""
    state = windows.withColumns({"path": F.array().cast("array<int>"), "left": F.lit(k).cast("long"), "ends": F.lit(False)})
    by = Window.partitionBy("anchor_id", "number")
    every = F.explode(F.sequence(F.lit(0), F.lit(stripes - 1))).alias("stripe")

    def questions(state: DataFrame) -> DataFrame:
        # A row holds at most ASKED anchors and their windows.
        window = F.struct("anchor", "number", "low", "high", "path", "left", "ends")
        grouped = state.groupBy("block").agg(F.array_sort(F.collect_list(window)).alias("windows"))
        return anchors.join(grouped, "block").select(*PACKED, "windows", every)

    for _ in range(n_rounds):
        counts = meet(index, questions(state), count_digits, "anchor_id long, number int, digit int, count long", same).groupBy("anchor_id", "number", "digit").agg(F.sum("count").alias("count"))
        running = counts.withColumn("to", F.sum("count").over(by.orderBy("digit"))).join(state.select("anchor_id", "number", "left"), ["anchor_id", "number"])
        # The digit at which as many as are looked for are reached; a window with fewer has none.
        reached = running.where((F.col("to") >= F.col("left")) & (F.col("to") - F.col("count") < F.col("left"))).select("anchor_id", "number", "digit", (F.col("left") - F.col("to") + F.col("count")).alias("below"))
        none = F.col("digit").isNull()
        moved = {"path": F.when(none, F.col("path")).otherwise(F.concat("path", F.array("digit"))), "ends": F.col("ends") | none, "left": F.coalesce("below", "left")}
        state = materialised(state.join(reached, ["anchor_id", "number"], "left").withColumns(moved).drop("digit", "below"), folder)
    found = meet(index, questions(state), gather(*bounds), "anchor_id long, number int, vec_id long, score long, order_key binary, low string, high string", same)
    ranked = found.withColumn("rank", F.row_number().over(by.orderBy(F.desc("order_key"), "vec_id"))).where(F.col("rank") <= k)
    return materialised(ranked.select("anchor_id", "number", "rank", "vec_id", "score", "low", "high"), folder)


def hard_negatives(vectors: DataFrame, anchors: Column, *, scale: int, label: Column | str = "label", positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor (rows of vectors that the condition holds for) and positive the first negatives of which 100 times the score is from least to most times the positive's.

    vectors: vec_id, embedding, label; label: what takes the label's place; scale: what components are multiplied by before they are rounded down.
    """
    with scratch(vectors.sparkSession) as folder:
        return materialised(_mined(vectors, anchors, scale, F.col(label) if isinstance(label, str) else label, positives, negatives, least, most, folder))


def _mined(vectors: DataFrame, anchors: Column, scale: int, label: Column, positives: int, negatives: int, least: int, most: int, folder: str) -> DataFrame:
    rows = materialised(quantised(vectors, scale, label), folder)
    size = rows.agg(F.count("*").alias("n"), F.max(F.size("q")).alias("dims"), F.max(F.expr("array_max(transform(q, x -> abs(x)))")).alias("largest")).first()
    bound = max(1, (size.dims or 0) * int(size.largest or 0) ** 2)
    stripes = max(STRIPES, size.n // STRIPE_ROWS)
    # Dealt in turn: neither equal vectors nor one label crowd a stripe.
    index = materialised(blocks(rows.repartition(stripes), min(ROWS, -(-size.n // stripes) + 1)).drop("id_list"), folder)
    asked = rows.where(anchors).groupBy("vec_id").agg(F.min(F.struct("label", "q")).alias("r")).select("vec_id", "r.*")
    packed = materialised(blocks(asked, ASKED).withColumn("block", F.monotonically_increasing_id()).drop("stripe"), folder)
    ids = packed.select("block", F.posexplode("id_list").alias("anchor", "anchor_id"))
    first = ids.select("*", F.lit(0).alias("number"), F.lit(str(-bound)).alias("low"), F.lit(str(bound)).alias("high"))
    near = select(index, packed, first, positives, stripes, True, rounds(-bound, bound), (least, most), folder)
    windows = near.where("low is not null").join(ids, "anchor_id").select("block", "anchor", "anchor_id", F.col("rank").alias("number"), "low", "high")
    far = select(index, packed, windows, negatives, stripes, False, rounds(0, bound * (most - least) // 100 + 1), (least, most), folder)
    positive = near.select("anchor_id", F.col("rank").alias("number"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return far.join(positive, ["anchor_id", "number"]).select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
