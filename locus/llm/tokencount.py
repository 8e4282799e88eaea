"""Token counts by a dynamic program that pre-tokens share along a trie.

A pre-token is a word (a run of bytes other than space and the controls 9 to 13)
with the space sign before it.  In every slice of texts the distinct pre-tokens
are taken in sorted order, which walks their trie depth first: a node's forward
score, the least weight of any split of its prefix into pieces, is computed once
for all pre-tokens below it.  At each terminal the number of pieces of the best
split is stored, and a text's count is the sum over its words.

Null, empty and blank texts count zero.  Repeated rows are counted alike.  Words
of any length are split whole.  Extra columns are kept unless named like an
output column.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from locus.llm.textops import Words, ranges, slices
from locus.llm.vocabulary import SPACE, Vocabulary

#: Text that shares one trie, and terminal counts that a task remembers for its next slices.
SLICE_BYTES, REMEMBERED = 1 << 23, 300_000
#: Longer pre-tokens are counted by themselves, outside of the trie.
LONG = 4096


def backward_trie(weights: dict[str, int]) -> dict:
    """Pieces as nested dicts from their last character to their first; under "" a piece's weight."""
    root: dict = {}
    for piece, weight in weights.items():
        node = root
        for c in reversed(piece):
            node = node.setdefault(c, {})
        node[""] = weight
    return root


class TrieCounter:
    """Piece counts of best splits of sorted pre-tokens."""

    def __init__(self, vocabulary: Vocabulary):
        self.root, self.byte_weight = backward_trie(vocabulary.weights), vocabulary.byte_weight
        self.single, self.longest = {p for p in vocabulary.weights if len(p) == 1}, vocabulary.longest + 1

    def counts(self, words: list[str]) -> list[int]:
        """For words in sorted order; the space sign before each is implied."""
        root, single, byte_weight, get = self.root, self.single, self.byte_weight, dict.get
        path = [SPACE]
        forward = [(0, 0), self._first()]  # (weight, pieces) of each prefix of the path
        out, before = [], ""
        for word in words:
            if len(word) > LONG:
                out.append(self._long(word))
                continue
            shared = 0
            for a, b in zip(before, word):
                if a != b:
                    break
                shared += 1
            del path[shared + 1 :], forward[shared + 2 :]
            for c in word[shared:]:
                literal = c == SPACE
                path.append("\0" + c if literal else c)
                n = len(path)
                best, pieces = None, 0
                if literal or c not in single:
                    size = len(c.encode("utf-8", "surrogatepass"))
                    w, k = forward[n - 1]
                    best, pieces = w + size * byte_weight, k + size
                if not literal:
                    node, at = root, n
                    while at:
                        at -= 1
                        node = get(node, path[at])
                        if node is None:
                            break
                        weight = get(node, "")
                        if weight is not None:
                            w, k = forward[at]
                            w += weight
                            if best is None or w < best:
                                best, pieces = w, k + 1
                forward.append((best, pieces))
            out.append(forward[-1][1])
            before = word
        return out

    def _long(self, word: str) -> int:
        """The count of one word, of any length: only as many forward scores are kept as the longest piece has characters."""
        path, forward = deque([SPACE], self.longest), deque([(0, 0), self._first()], self.longest)
        for c in word:
            literal = c == SPACE
            path.append("\0" + c if literal else c)
            best, pieces = None, 0
            if literal or c not in self.single:
                size = len(c.encode("utf-8", "surrogatepass"))
                w, k = forward[-1]
                best, pieces = w + size * self.byte_weight, k + size
            if not literal:
                node = self.root
                for at in range(1, min(len(path), len(forward)) + 1):
                    node = node.get(path[-at])
                    if node is None:
                        break
                    if "" in node:
                        w, k = forward[-at]
                        if best is None or w + node[""] < best:
                            best, pieces = w + node[""], k + 1
            forward.append((best, pieces))
        return forward[-1][1]

    def _first(self) -> tuple[int, int]:
        node = self.root.get(SPACE, {})
        size = len(SPACE.encode())
        return (node[""], 1) if "" in node else (size * self.byte_weight, size)


def words_array(words: Words) -> pa.Array:
    """The words as an Arrow array of strings."""
    size = words.end - words.start
    offsets = np.concatenate(([0], np.cumsum(size)))
    data = words.bytes[ranges(words.start, size)]
    return pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes()))


def count_tokens(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The columns carry of docs (None: all), n_pretokens and n_tokens."""
    docs = docs.select(*(c for c in docs.columns if c.lower() not in ("n_pretokens", "n_tokens")))
    out = [k for k, c in enumerate(docs.columns) if carry is None or c in carry]
    names, at = [docs.columns[k] for k in out] + ["n_pretokens", "n_tokens"], docs.columns.index(text)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, known = TrieCounter(vocabulary), {}
        for part in slices(batches, text, SLICE_BYTES):
            words = Words(part.column(at))
            coded = words_array(words).dictionary_encode()
            distinct = coded.dictionary.to_pylist()
            new = sorted(w for w in distinct if w not in known)
            if len(known) + len(new) > REMEMBERED:
                known, new = {}, sorted(distinct)
            here = dict(zip(new, counter.counts(new), strict=True))
            each = np.fromiter((here[w] if w in here else known[w] for w in distinct), np.int64, len(distinct))
            known.update((w, k) for w, k in here.items() if len(w) <= LONG)
            total = np.concatenate(([0], np.cumsum(each[coded.indices.to_numpy()]))) if len(distinct) else np.zeros(1, np.int64)
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in out), pa.array(np.diff(words.first)), pa.array(np.diff(total[words.first]))], names)

    return docs.mapInArrow(counted, T.StructType([*(docs.schema[k] for k in out), T.StructField("n_pretokens", T.LongType()), T.StructField("n_tokens", T.LongType())]))
