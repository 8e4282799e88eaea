"""Vectorised word and hash helpers over Arrow string columns.

All helpers work on the UTF-8 bytes of whole texts.  Words are the maximal runs
of bytes other than space and the controls 9 to 13, so word borders never fall
inside a multi-byte character.  A null text counts as an empty one.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one vectorised step takes at most (a longer single word is taken alone).
STEP_BYTES = 1 << 20
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
#: Bytes with A-Z as a-z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE_CODE = _RNG.integers(1, 2**64, 256, dtype=np.uint64, endpoint=False)
_LOWER_CODE = _BYTE_CODE.copy()
_LOWER_CODE[65:91] = _BYTE_CODE[97:123]
_SLOTS = _RNG.integers(1, 2**64, 64, dtype=np.uint64, endpoint=False) | np.uint64(1)
_ROOT = 0x9E3779B97F4A7C15
_ROOT_INVERSE = pow(_ROOT, -1, 2**64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, root in enumerate((_ROOT, _ROOT_INVERSE)):
            table = np.full(n, root, np.uint64)
            table[0] = 1
            _powers[k] = np.cumprod(table, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_PRIME = (1 << 31) - 1
#: Longer words are named one by one.
LONG_WORD = 3072


def word_names(words: pa.Array, key: bytes) -> np.ndarray:
    """Two 64-bit numbers for every word of a large binary array.

    A word is a polynomial, three bytes a coefficient, and a name two of its values
    modulo a prime of 31 bits, at places that only the key knows; very long words have
    keyed BLAKE2b digests instead.  Whatever two words are, as long as they were chosen
    without the key, they share a name with a chance of about (bytes / 2**32) squared.
    """
    at = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2], np.uint8) if words.buffers()[2] is not None else np.zeros(0, np.uint8)
    data = np.concatenate((data, np.zeros(3, np.uint8)))
    secret = np.frombuffer(hashlib.blake2b(b"places", key=key, digest_size=32).digest(), np.uint64)
    places = [int(x) % (_PRIME - 2) + 2 for x in secret]
    order = np.argsort(at[:-1] - at[1:], kind="stable")
    start, length = at[:-1][order], (at[1:] - at[:-1])[order]
    short = int(np.searchsorted(-length, -LONG_WORD, "left"))
    start, length = start[short:], length[short:]
    values = [(length + 1) % _PRIME for _ in places]
    for k in range(0, int(length.max(initial=0)), 3):
        n = int(np.searchsorted(-length, -k, "left"))
        byte = data[start[:n, None] + (k + np.arange(3))].astype(np.int64)
        byte[length[:n, None] <= k + np.arange(3)] = 0
        chunk = byte[:, 0] | byte[:, 1] << 8 | byte[:, 2] << 16
        for place, value in zip(places, values, strict=True):
            value[:n] = (value[:n] * place + chunk) % _PRIME
    out = np.empty((len(words), 2), np.uint64)
    for c in range(2):
        out[order[short:], c] = mix64(values[2 * c].astype(np.uint64) << np.uint64(31) | values[2 * c + 1].astype(np.uint64))
    for k in order[:short].tolist():
        out[k] = np.frombuffer(hashlib.blake2b(data[at[k] : at[k + 1]].tobytes(), key=key, digest_size=16).digest(), np.uint64)
    return out


def distinct_words(joined: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """The number of each word in a table of the distinct ones, and that table; joined: the bytes of all words, one right after the other."""
    offsets = np.zeros(len(length) + 1, np.int64)
    np.cumsum(length, out=offsets[1:])
    every = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(length), [None, pa.py_buffer(offsets), pa.py_buffer(joined)])
    coded = every.dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary


class Words:
    """Words of a slice of texts: byte ranges, and each text's first word index."""

    def __init__(self, texts: pa.Array):
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = texts.buffers()[2]
        self.bytes = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
        self.text_at = offsets - offsets[0]
        inside = ~_SEPARATOR[self.bytes]
        opens, closes = inside.copy(), inside.copy()
        if len(inside):
            opens[1:] &= ~inside[:-1]
            closes[:-1] &= ~inside[1:]
            edges = self.text_at[1:-1]
            edges = edges[(edges > 0) & (edges < len(inside))]
            opens[edges] |= inside[edges]
            closes[edges - 1] |= inside[edges - 1]
        self.start = np.flatnonzero(opens)
        self.end = np.flatnonzero(closes) + 1
        self.first = np.searchsorted(self.start, self.text_at)

    def names(self, lower: bool, key: bytes) -> np.ndarray:
        """Two names (columns) of every word, as word_names(); lower: with A-Z as a-z."""
        joined = self.bytes[~_SEPARATOR[self.bytes]]
        word, distinct = distinct_words(LOWER[joined] if lower else joined, self.end - self.start)
        return word_names(distinct, key)[word]

    def hashes(self, lower: bool) -> np.ndarray:
        """A 64-bit hash of every word, the same in every job; lower: with A-Z as a-z.  Words can be made up that share one, so it serves for features, not to tell words apart."""
        return polynomials(self.bytes, self.start, self.end, lower)


def polynomials(data: np.ndarray, begin: np.ndarray, stop: np.ndarray, lower: bool) -> np.ndarray:
    """A 64-bit hash of each of the ascending byte ranges."""
    code = _LOWER_CODE if lower else _BYTE_CODE
    out = np.empty(len(begin), np.uint64)
    at = 0
    while at < len(out):
        base = begin[at]
        to = max(at + 1, int(np.searchsorted(stop, base + STEP_BYTES, "right")))
        size = int(stop[to - 1] - base)
        up, down = _power_tables(size)
        total = np.zeros(size + 1, np.uint64)
        np.cumsum(code[data[base : base + size]] * up, dtype=np.uint64, out=total[1:])
        start, end = begin[at:to] - base, stop[at:to] - base
        out[at:to] = (total[end] - total[start]) * down[start]
        at = to
    return mix64(out)


def slices(batches: Iterator[pa.RecordBatch], text: str | int = "text", step: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches again, cut so that a slice has at most step bytes of text (a column's name or number), or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0), dtype=np.int64)
        total, at = np.concatenate(([0], np.cumsum(sizes))), 0
        while at < len(sizes):
            to = max(at + 1, int(np.searchsorted(total, total[at] + step, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def gram_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of every run of size consecutive word hashes; of words' secret names, one that nobody can aim at."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out += words[k : k + n] * _SLOTS[k]
    return mix64(out)


def shingle_sets(words: Words, key: bytes = b"", size: int = 5) -> list[np.ndarray]:
    """Each text's sorted distinct shingle names; a shorter text's whole sequence is one shingle."""
    hashed = words.names(True, key)[:, 0]
    grams = gram_hashes(hashed, size)
    out = []
    for a, b in zip(words.first[:-1], words.first[1:], strict=True):
        if b - a >= size:
            out.append(np.unique(grams[a : b - size + 1]))
        elif b > a:
            seed = mix64(np.array([b - a], np.uint64))
            out.append(mix64((hashed[a:b] * _SLOTS[8 : 8 + b - a]).sum(dtype=np.uint64)[None] + seed))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def exact_shingle_sets(words: Words, size: int = 5) -> list[np.ndarray]:
    """As shingle_sets, but by numbers that are equal for equal words and for no others; they mean nothing beyond these texts."""
    lower = words.bytes.copy()
    capital = (lower >= 65) & (lower <= 90)
    lower[capital] += 32
    length = words.end - words.start
    offsets = np.concatenate(([0], np.cumsum(length)))
    coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(length), [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(lower[ranges(words.start, length)].tobytes())]).dictionary_encode()
    named = {1: coded.indices.to_numpy().astype(np.int64)}

    def runs(k: int) -> np.ndarray:
        """The number of the run of k words at each place: one for each pair of two shorter runs' numbers."""
        if k not in named:
            half, count = 1 << (k - 1).bit_length() - 1, max(0, len(length) - k + 1)
            left, right = runs(half)[:count], runs(k - half)
            named[k] = np.unique(left * (int(right.max(initial=0)) + 1) + right[half : half + count], return_inverse=True)[1]
        return named[k]

    out = []
    for a, b in itertools.pairwise(words.first.tolist()):
        if b - a >= size:
            out.append(np.unique(runs(size)[a : b - size + 1]))
        else:
            out.append(-size * runs(b - a)[a : a + 1] - (b - a) if b > a else named[1][:0])
    return out


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All integers of the ranges [start, start + size), one range after another."""
    total = int(sizes.sum())
    if not total:
        return np.zeros(0, np.int64)
    keep = sizes > 0
    sizes, starts = sizes[keep], starts[keep]
    step = np.ones(total, np.int64)
    step[0] = starts[0]
    at = np.cumsum(sizes)[:-1]
    step[at] = starts[1:] - (starts[:-1] + sizes[:-1]) + 1
    return np.cumsum(step)
