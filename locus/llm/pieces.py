"""SentencePiece-style encoding and decoding by suffix-array matching.

A text is cut before every run of spaces; no piece reaches over such a cut, so
equal cuts are encoded once.  The distinct ones of a slice are concatenated and
their suffixes sorted by as many characters as the longest piece has.  A binary
search finds every piece's range of suffixes, which are its occurrences.  These
edges, sorted by their place, relax a shortest path from left to right.

Of splits of equal weight the one with the longest last piece wins, from the end
backwards.  Null texts give null ids, empty ones no ids; decoding turns them back
into null and empty.  Texts and words may have any length.  Repeated rows are
encoded alike.  Extra columns are kept, a column named ids or text is replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from locus.llm.textops import ranges, slices
from locus.llm.vocabulary import SPACE, Vocabulary

SLICE_BYTES, CHARACTERS = 1 << 21, 1 << 18
#: Encoded cuts that a task keeps, of at most so many bytes.
REMEMBERED, REMEMBERED_BYTES = 250_000, 64
_BITS, _PACK = 15, 4  # characters are numbered in 15 bits, four to a key
_FAR = np.int64(1) << 62
_IDS = T.StructField("ids", T.ArrayType(T.IntegerType()))
Step = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


class Encoder:
    def __init__(self, vocabulary: Vocabulary):
        pieces = sorted(vocabulary.ids)
        alphabet = sorted({c for p in pieces for c in p})
        if len(alphabet) + 2 >= 1 << _BITS:
            raise ValueError("the vocabulary has too many characters")
        self.code = np.full(0x110000, len(alphabet) + 1, np.int64)  # any other character
        self.code[[ord(c) for c in alphabet]] = np.arange(1, len(alphabet) + 1)
        self.depth = -(-vocabulary.longest // _PACK)
        self.size = np.array([len(p) for p in pieces])
        self.id = np.array([vocabulary.ids[p] for p in pieces])
        self.weight = np.array([vocabulary.weights[p] for p in pieces])
        letters = np.zeros((len(pieces), self.depth * _PACK), np.int64)
        for k, p in enumerate(pieces):
            letters[k, : len(p)] = self.code[[ord(c) for c in p]]
        self.low = self._packed(letters)
        letters[np.arange(letters.shape[1])[None, :] >= self.size[:, None]] = (1 << _BITS) - 1
        self.high = self._packed(letters)
        self.single = {p for p in pieces if len(p) == 1}
        self.has_single = np.zeros(0x110000, bool)
        self.has_single[[ord(c) for c in self.single]] = True
        self.byte_ids, self.byte_weight = np.array(vocabulary.byte_ids), vocabulary.byte_weight

    @staticmethod
    def _packed(letters: np.ndarray) -> np.ndarray:
        n, m = letters.shape
        return (letters.reshape(n, m // _PACK, _PACK) << (_BITS * np.arange(_PACK - 1, -1, -1))).sum(2)

    def _ranges(self, keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """For every piece the range of sorted suffixes that begin with it; keys: the sorted suffixes' packed characters."""
        lo, hi = np.zeros(len(self.size), np.int64), np.full(len(self.size), len(keys[0]))
        for level, key in enumerate(keys):
            more = np.flatnonzero((self.size > level * _PACK) & (lo < hi))
            lo[more], hi[more] = (self._bisect(key, lo[more], hi[more], bound[more, level], right) for bound, right in ((self.low, False), (self.high, True)))
        return lo, hi

    @staticmethod
    def _bisect(key: np.ndarray, lo: np.ndarray, hi: np.ndarray, value: np.ndarray, right: bool) -> np.ndarray:
        lo, hi = lo.copy(), hi.copy()
        while (open_ := lo < hi).any():
            mid = (lo + hi) >> 1
            at = key[np.minimum(mid, len(key) - 1)]
            below = open_ & ((at <= value) if right else (at < value))
            lo = np.where(below, mid + 1, lo)
            hi = np.where(open_ & ~below, mid, hi)
        return lo

    def encode(self, cuts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all cuts one after another, each cut's first place in them and the end); CHARACTERS at a time share a suffix array, a longer cut has several."""
        total = np.concatenate(([0], np.cumsum([len(c) for c in cuts]))).astype(np.int64)
        ids, sizes, at = [], [], 0
        while at < len(cuts):
            to = max(at + 1, int(np.searchsorted(total, total[at] + CHARACTERS, "right")) - 1)
            got, bounds = self._matched(cuts[at:to]) if total[to] - total[at] <= CHARACTERS else self._long(cuts[at])
            ids.append(got.astype(np.int32))
            sizes.append(np.diff(bounds))
            at = to
        none = np.zeros(0, np.int32)
        return np.concatenate([none, *ids]), np.concatenate(([0], np.cumsum(np.concatenate([none, *sizes]))))

    def _edges(self, cuts: list[str]) -> tuple[np.ndarray, ...]:
        """The cuts' code points (each cut followed by a zero), their first places and lengths, and the edges: place, step, weight and piece (-1: a character spelled in bytes)."""
        text = "\0".join(cuts) + "\0"
        point = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        n, lengths = len(point), np.fromiter(map(len, cuts), np.int64, len(cuts))
        begin = np.concatenate(([0], np.cumsum(lengths + 1)))[:-1]
        letter = np.full(n + self.depth * _PACK, 0, np.int64)
        letter[:n] = np.where(point == ord(SPACE), self.code[0x10FFFF], self.code[np.where(point == 32, ord(SPACE), point)])
        letter[begin + lengths] = 0
        packed = letter[: n + (self.depth - 1) * _PACK].copy()
        for k in range(1, _PACK):
            packed <<= _BITS
            packed |= letter[k : k + len(packed)]
        inside = np.flatnonzero(letter[:n])
        order = inside[np.lexsort([packed[inside + k * _PACK] for k in range(self.depth - 1, -1, -1)])]
        lo, hi = self._ranges([packed[order + k * _PACK] for k in range(self.depth)])
        count = np.maximum(hi - lo, 0)
        place = order[ranges(lo, count)]
        piece = np.repeat(np.arange(len(count), dtype=np.int32), count)
        # Characters without a piece: an edge of one step, told by a piece number of -1.
        bare = inside[~(self.has_single[np.where(point == 32, ord(SPACE), point)[inside]] & (point[inside] != ord(SPACE)))]
        place = np.concatenate((place, bare))
        step = np.concatenate((self.size[piece], np.ones(len(bare), np.int64)))
        weight = np.concatenate((self.weight[piece], _utf8(point[bare]) * self.byte_weight))
        return point, begin, lengths, place, step, weight, np.concatenate((piece, np.full(len(bare), -1)))

    def _matched(self, cuts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        point, begin, lengths, place, step, weight, piece = self._edges(cuts)
        n = len(point)
        depth = place - np.repeat(begin, lengths + 1)[place]
        by_place = np.argsort(depth, kind="stable")
        place, step, weight, piece = place[by_place], step[by_place], weight[by_place], piece[by_place]
        best = np.full(n + 1, _FAR)
        best[begin] = 0
        ends = place + step
        edge = np.concatenate(([0], np.cumsum(np.bincount(depth)))) if len(depth) else np.zeros(1, np.int64)
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            # Edges from one depth of one cut differ in length, so no two of them meet in a node.
            to = ends[a:b]
            best[to] = np.minimum(best[to], best[place[a:b]] + weight[a:b])
        back, chosen = np.zeros(n + 1, np.int64), np.full(n + 1, -1)
        self._choose(best, back, chosen, place, ends, step, weight, piece)
        # All cuts go back from their ends in step.
        which, node, found = np.flatnonzero(lengths), (begin + lengths)[lengths > 0], []
        while len(which):
            found.append((which, node, chosen[node]))
            node = node - back[node]
            on = node > begin[which]
            which, node = which[on], node[on]
        if not found:
            return np.zeros(0, np.int64), np.zeros(len(cuts) + 1, np.int64)
        which, node, piece = (np.concatenate(x) for x in zip(*found, strict=True))
        by_node = np.argsort(node)
        which, node, piece = which[by_node], node[by_node], piece[by_node]
        ids, many = self._spelled(piece, point[node - 1])
        return ids, np.concatenate(([0], np.cumsum(np.bincount(which, many, len(cuts)).astype(np.int64))))

    @staticmethod
    def _choose(best, back, chosen, place, ends, step, weight, piece) -> None:
        """Enters for every node the longest of the edges that its best split may end with."""
        good = np.flatnonzero(best[place] + weight == best[ends])
        np.maximum.at(back, ends[good], step[good])
        last = good[step[good] == back[ends[good]]]
        chosen[ends[last]] = piece[last]

    def _long(self, cut: str) -> tuple[np.ndarray, np.ndarray]:
        """As _matched, for one cut of any length: edges of CHARACTERS at a time, relaxed in order, then met again to choose; what stays is a few numbers a character."""
        n = len(cut)
        best, back, chosen = np.full(n + 1, _FAR), np.zeros(n + 1, np.int64), np.full(n + 1, -1)
        best[0] = 0
        for choosing in (False, True):
            for a in range(0, n, CHARACTERS):
                _, _, _, place, step, weight, piece = self._edges([cut[a : a + CHARACTERS + self.depth * _PACK]])
                own = place < CHARACTERS
                place, step, weight, piece = place[own] + a, step[own], weight[own], piece[own]
                if choosing:
                    self._choose(best, back, chosen, place, place + step, step, weight, piece)
                    continue
                by_place = np.argsort(place, kind="stable")
                for p, to, w in zip(place[by_place].tolist(), (place + step)[by_place].tolist(), weight[by_place].tolist(), strict=True):
                    best[to] = min(best[to], best[p] + w)
        node, nodes = n, []
        while node:
            nodes.append(node)
            node -= int(back[node])
        node = np.array(nodes[::-1])
        ids, _ = self._spelled(chosen[node], np.array([ord(cut[k - 1]) for k in node.tolist()]))
        return ids, np.array([0, len(ids)])

    def _spelled(self, piece: np.ndarray, point: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces, those of -1 spelled in bytes of their character, and how many each has."""
        spelled = piece < 0
        many, chars = np.ones(len(piece), np.int64), point[spelled]
        many[spelled] = _utf8(chars)
        ids = np.repeat(np.where(spelled, 0, self.id[piece]), many)
        if len(chars):
            raw = np.frombuffer("".join(map(chr, chars)).encode("utf-8", "surrogatepass"), np.uint8)
            ids[np.repeat(spelled, many)] = self.byte_ids[raw]
        return ids, many


def _utf8(point: np.ndarray) -> np.ndarray:
    """Bytes that code points take."""
    return 1 + (point > 0x7F) + (point > 0x7FF) + (point > 0xFFFF)


def _cuts(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The texts' cuts one after another, and each text's first cut and the end."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    opens = raw == 32
    opens[1:] &= raw[:-1] != 32
    edges = offsets[:-1][np.diff(offsets) > 0]
    opens[edges] = True
    start = np.flatnonzero(opens)
    ends = np.concatenate((start, [len(raw)])).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(ends.tobytes()), pa.py_buffer(raw.tobytes())), np.searchsorted(start, offsets)


def _encoding(vocabulary: Vocabulary, at: int, out: list[int], names: list[str]) -> Step:
    """Batches with the columns out, and the ids of the text in column at."""

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary)
        known, ids, first = pa.array([], pa.large_string()), np.zeros(0, np.int32), np.zeros(1, np.int64)
        for part in slices(batches, at, SLICE_BYTES):
            texts = part.column(at)
            cuts, cut_at = _cuts(texts)
            coded = cuts.dictionary_encode()
            where = pc.index_in(coded.dictionary, known)
            new = coded.dictionary.filter(pc.is_null(where))
            if len(known) + len(new) > REMEMBERED:
                known, ids, first, new = known[:0], ids[:0], first[:1], coded.dictionary
            got, got_at = encoder.encode(new.to_pylist()) if len(new) else (ids[:0], np.zeros(1, np.int64))
            here_ids, here_first = np.concatenate((ids, got)), np.concatenate((first, first[-1] + got_at[1:]))
            where = pc.index_in(coded.dictionary, pa.concat_arrays([known, new])).to_numpy()
            use = where[coded.indices.to_numpy()] if len(where) else np.zeros(0, np.int64)
            size = np.diff(here_first)[use]
            flat = here_ids[ranges(here_first[use], size)]
            # Short cuts come again; long ones are not worth their place.
            short = pc.less_equal(pc.binary_length(new), REMEMBERED_BYTES)
            kept, sizes = np.flatnonzero(short.to_numpy(zero_copy_only=False)), np.diff(got_at)
            known, ids = pa.concat_arrays([known, new.filter(short)]), np.concatenate((ids, got[ranges(got_at[kept], sizes[kept])]))
            first = np.concatenate((first, first[-1] + np.cumsum(sizes[kept])))
            bounds = np.concatenate(([0], np.cumsum(size)))[cut_at].astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat), mask=texts.is_null())
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in out), lists], names)

    return encoded


def _decoding(vocabulary: Vocabulary, at: int, names: list[str]) -> Step:
    """Batches with one more column: the text that the ids in column at stand for."""
    spelled = {k: bytes([b]) for b, k in enumerate(vocabulary.byte_ids)} | {k: p.replace(SPACE, " ").encode() for p, k in vocabulary.ids.items()}

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = [spelled.get(k, b"") for k in range(max(spelled) + 1)]
        size, data = np.array([len(b) for b in table]), np.frombuffer(b"".join(table), np.uint8)
        begin = np.cumsum(size) - size
        for batch in batches:
            for row in range(0, batch.num_rows, 256):
                part = batch.slice(row, 256)
                lists = part.column(at)
                flat, bounds = lists.flatten().to_numpy(), np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy())))
                ends = np.concatenate(([0], np.cumsum(size[flat])))
                raw = data[ranges(begin[flat], size[flat])]
                offsets = ends[bounds].astype(np.int64)
                texts = pa.LargeStringArray.from_buffers(len(lists), pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw.tobytes()))
                texts = pc.if_else(lists.is_null(), None, texts).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, texts], names)

    return decoded


def _carried(docs: DataFrame, text: str, carry: list[str] | None) -> tuple[DataFrame, list[int]]:
    docs = docs.select(*(c for c in docs.columns if c.lower() != "ids"))
    return docs, [k for k, c in enumerate(docs.columns) if c != text and (carry is None or c in carry)]


def encode(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The columns carry of docs (None: all but the text), and ids (array of int)."""
    docs, out = _carried(docs, text, carry)
    names = [docs.columns[k] for k in out] + ["ids"]
    return docs.mapInArrow(_encoding(vocabulary, docs.columns.index(text), out, names), T.StructType([*(docs.schema[k] for k in out), _IDS]))


def decode(docs: DataFrame, vocabulary: Vocabulary, ids: str = "ids", text: str = "text") -> DataFrame:
    """docs with the text that the ids stand for."""
    docs = docs.select(*(c for c in docs.columns if c.lower() != text.lower()))
    return docs.mapInArrow(_decoding(vocabulary, docs.columns.index(ids), [*docs.columns, text]), T.StructType([*docs.schema, T.StructField(text, T.StringType())]))


def there_and_back(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """As decode(encode(docs)), in one process a task instead of two: the columns carry (None: all but the text), ids, and the text that they stand for."""
    docs, out = _carried(docs, text, carry)
    names = [docs.columns[k] for k in out] + ["ids"]
    first, second = _encoding(vocabulary, docs.columns.index(text), out, names), _decoding(vocabulary, len(out), [*names, text])
    return docs.mapInArrow(lambda batches: second(first(batches)), T.StructType([*(docs.schema[k] for k in out), _IDS, T.StructField(text, T.StringType())]))
