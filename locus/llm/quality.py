"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature of a whole text falls into one of at most BINS bins.  Training runs
round after round over the features; each step fits a shallow tree to the
gradients of the logistic loss and adds its leaves to that feature's lookup
table.  The strongest pairs of features then get two-dimensional tables in the
same way.  A score is the logistic of a sum of table entries, so scoring is one
vectorised lookup a table.

The model is fitted on a bounded sample (``max_rows`` labelled rows, those with
the smallest hash of the id): that many feature rows, a few numbers each, are all
that ever reaches the driver.  Scoring reads every whole text once.

Null and empty texts get a score as any other (their features are zeros).  With
no labelled rows, or labels of one kind only, every score is that label's
smoothed frequency.  Rows whose id is null are scored but never used to fit.  Of
several labels of one id the least holds, and of several rows that share an id the
one with the least features is fitted.
Extra columns are kept, and a column named like an output column is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from locus.llm.textops import Words, gram_hashes, slices

BINS = 32
_CLASSES = np.zeros(256, np.int64)
for _k, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:?'\"()-", b"!", b"|", b"#$%&*", b"@=+<>{}[]\\/^~_`", b"\n\r", b" \t\x0b\x0c"), 1):
    _CLASSES[list(_chars)] = _k
_CLASSES[128:] = 10
_CLASSES[:9] = _CLASSES[14:32] = _CLASSES[127] = 11
FEATURES = (
    "log_bytes", "log_words", "word_bytes", "upper", "digit", "point", "exclaim", "bar", "mark", "other", "line", "blank", "high", "control",
    "short_words", "long_words", "distinct_words", "distinct_pairs", "top_word", "words_a_line", "distinct_chars",
)


def features(texts: pa.Array) -> np.ndarray:
    """A row of FEATURES for every text."""
    n, words = len(texts), Words(texts)
    sizes = np.diff(words.text_at)
    row = np.repeat(np.arange(n), sizes)
    kinds = np.bincount(row * 12 + _CLASSES[words.bytes], minlength=n * 12).reshape(n, 12).astype(float)
    per_byte = kinds / np.maximum(sizes, 1)[:, None]
    length, count = words.end - words.start, np.diff(words.first)
    per_word = np.maximum(count, 1)
    owner = np.repeat(np.arange(n), count)
    short = np.bincount(owner, length <= 3, n) / per_word
    long = np.bincount(owner, length >= 13, n) / per_word
    hashed = words.hashes(lower=True)
    pairs = gram_hashes(hashed, 2)
    repeats = np.zeros((n, 4))
    for k, (a, b) in enumerate(zip(words.first[:-1], words.first[1:], strict=True)):
        if b - a > 1:
            _, times = np.unique(hashed[a:b], return_counts=True)
            repeats[k, :3] = len(times) / (b - a), len(np.unique(pairs[a : b - 1])) / (b - a - 1), times.max() / (b - a)
        else:
            repeats[k, :3] = b - a, b - a, b - a
        repeats[k, 3] = np.count_nonzero(np.bincount(words.bytes[words.text_at[k] : words.text_at[k + 1]], minlength=256))
    return np.column_stack((
        np.log1p(sizes), np.log1p(count), np.bincount(owner, length, n) / per_word, per_byte[:, 1:12],
        short, long, repeats[:, :3], np.log1p(count / (kinds[:, 8] + 1)), repeats[:, 3],
    ))


@dataclass
class AdditiveModel:
    """Bin edges, one lookup table a feature, and two-dimensional tables of feature pairs."""

    intercept: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, k], "right") for k, e in enumerate(self.edges)]) if self.edges else np.zeros((len(x), 0), int)

    def score(self, x: np.ndarray) -> np.ndarray:
        b, total = self.bins(x), np.full(len(x), self.intercept)
        for k, table in enumerate(self.tables):
            total += table[b[:, k]]
        for (i, j), table in self.pairs.items():
            total += table[b[:, i], b[:, j]]
        return 1 / (1 + np.exp(-total))


def _best_cut(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, int]:
    """Gain and place of the best split of a histogram of gradients and curvatures."""
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    all_g, all_h = g.sum(), h.sum()
    if not len(left_g):
        return 0.0, 0
    gain = left_g**2 / (left_h + ridge) + (all_g - left_g) ** 2 / (all_h - left_h + ridge) - all_g**2 / (all_h + ridge)
    at = int(np.argmax(gain))
    return float(gain[at]), at + 1


def _tree(g: np.ndarray, h: np.ndarray, depth: int, ridge: float) -> np.ndarray:
    """Leaf values, spread over the bins, of a tree of that depth."""
    gain, at = _best_cut(g, h, ridge) if depth else (0.0, 0)
    if gain <= 1e-9:
        return np.full(len(g), g.sum() / (h.sum() + ridge))
    return np.concatenate((_tree(g[:at], h[:at], depth - 1, ridge), _tree(g[at:], h[at:], depth - 1, ridge)))


def _grid_tree(g: np.ndarray, h: np.ndarray, ridge: float) -> np.ndarray:
    """As _tree, over two features: a split of one, then one of the other on either side."""
    best, out = -1.0, None
    for turned in (False, True):
        a, b = (g.T, h.T) if turned else (g, h)
        top, at = _best_cut(a.sum(1), b.sum(1), ridge)
        sides = [slice(0, at), slice(at, None)] if top > 0 else [slice(None)]
        leaves = np.zeros_like(a)
        for side in sides:
            gain, _ = _best_cut(a[side].sum(0), b[side].sum(0), ridge)
            top += gain
            leaves[side] = _tree(a[side].sum(0), b[side].sum(0), 1, ridge)
        if top > best:
            best, out = top, leaves.T if turned else leaves
    return out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 200, pair_rounds: int = 60, n_pairs: int = 8, rate: float = 0.1, ridge: float = 5.0) -> AdditiveModel:
    """Cyclic boosting: one shallow tree a feature and round, then the same over the chosen pairs."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    model = AdditiveModel(float(np.log(share / (1 - share))))
    if len(y) == 0 or y.min() == y.max():
        return model
    model.edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1], method="nearest")) for k in range(x.shape[1])]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    b, total = model.bins(x), np.full(len(y), model.intercept)
    for _ in range(rounds):
        for k, table in enumerate(model.tables):
            p = 1 / (1 + np.exp(-total))
            step = rate * _tree(np.bincount(b[:, k], y - p, len(table)), np.bincount(b[:, k], p * (1 - p), len(table)), 2, ridge)
            table += step
            total += step[b[:, k]]
    p, found = 1 / (1 + np.exp(-total)), []
    for i in range(len(model.tables)):
        for j in range(i + 1, len(model.tables)):
            shape = (len(model.tables[i]), len(model.tables[j]))
            cell = b[:, i] * shape[1] + b[:, j]
            g, h = (np.bincount(cell, v, shape[0] * shape[1]).reshape(shape) for v in (y - p, p * (1 - p)))
            leaves = _grid_tree(g, h, ridge)
            found.append((-float((g * leaves - h * leaves**2 / 2).sum()), i, j))
    for _, i, j in sorted(found)[:n_pairs]:
        model.pairs[i, j] = np.zeros((len(model.tables[i]), len(model.tables[j])))
    for _ in range(pair_rounds):
        for (i, j), table in model.pairs.items():
            p, cell = 1 / (1 + np.exp(-total)), b[:, i] * table.shape[1] + b[:, j]
            g, h = (np.bincount(cell, v, table.size).reshape(table.shape) for v in (y - p, p * (1 - p)))
            step = rate * _grid_tree(g, h, ridge)
            table += step
            total += step[b[:, i], b[:, j]]
    return model


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, label: str = "quality") -> AdditiveModel:
    """Fits the model on at most max_rows labelled rows of docs that are not held out (crc32 of the id mod 5 is not 0)."""
    key = F.col("doc_id").cast("string")
    sample = (
        labels.select("doc_id", F.col(label).cast("int").alias("y"))
        .where("doc_id is not null and y in (0, 1)")
        .where(F.crc32(key) % 5 != 0)
        .groupBy("doc_id")
        .agg(F.min("y").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_rows)
    )

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(list(features(part.column(1))), pa.list_(pa.float64()))], ["doc_id", "y", "x"])

    found = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").mapInArrow(measured, "doc_id long, y int, x array<double>")
    # One row an id, however many documents share it.
    rows = found.groupBy("doc_id", "y").agg(F.min("x").alias("x")).collect()
    rows.sort(key=lambda r: (r.doc_id, r.y, r.x))
    return fit(np.array([r.x for r in rows]).reshape(len(rows), len(FEATURES)), np.array([r.y for r in rows], float))


def score(docs: DataFrame, model: AdditiveModel, threshold: float = 0.3, carry: list[str] | None = None) -> DataFrame:
    """The columns carry of docs (None: all), and score (0 to 1, higher: better) and predicted (1 if score >= threshold, else 0)."""
    kept = docs.select(*(c for c in docs.columns if c.lower() not in ("score", "predicted")))
    at = kept.columns.index("text")
    out = [k for k, c in enumerate(kept.columns) if carry is None or c in carry]
    names = [*(kept.columns[k] for k in out), "score", "predicted"]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            s = model.score(features(part.column(at)))
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in out), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names)

    schema = T.StructType([*(kept.schema[k] for k in out), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return kept.mapInArrow(scored, schema)


def held_out(doc_id: str = "doc_id"):
    """True for the fifth of the ids whose labels the model never sees."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))
