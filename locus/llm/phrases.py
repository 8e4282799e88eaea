"""Phrase collocations: candidates from sketched upper bounds, counted by automata.

Texts are cut into pieces and words; everything is counted within one language.  A
phrase of two or three words is a candidate if it occurs at least ``least`` times.

1. A sketch adds up, for hashed counters, the words and the pairs of words of all
   texts.  A counter is never below any of its phrases' counts, so phrases whose
   counter stays below ``least`` are out.  The counters are sparse rows that Spark sums
   where they belong, so their number grows with the corpus and nothing saturates.
   What reaches the next pass is one bit a counter, in a filter of bits that grows with
   the counters found and ends at MAX_BITS; beyond, it lets more phrases through, which
   are then counted for nothing.
2. The same for three words, of which only those enter whose two pairs have passed.
3. Every slice of texts compiles its own phrases that have passed into an Aho-Corasick
   automaton of at most SHARD phrases (of more phrases, into several, one after the
   other) and scans its texts for all overlapping matches.  Texts are written in symbols
   that show where a word begins, with delimiters between pieces, so a match holds whole
   words of one piece; words are counted as they are.  Spark sums the slices' counts, and what reaches ``least`` is
   exact: it was in the automaton of every slice that holds it.

The parts of a candidate occur as often as it does, so their counts are at hand.  A cut
into the first word or words and the rest scores floor(1000000 a a / (l r)), in decimal
arithmetic of 38 digits; the least score counts, of equal ones the earliest cut.  A
candidate is dropped if a longer one that holds its words in a row is at least half
(100 f >= ``nested`` a) as frequent.

A null text is empty, a null language is ``und``.  Texts of one language need not lie
together; repeated rows count each; ids and extra columns are ignored; an empty table,
or one without candidates, gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locus.llm.textops import LOWER, distinct_words, mix64, polynomials, slices, word_names
from locus.sources.shared import materialised, scratch

#: Bytes of text that are counted together, phrases of one automaton.
SLICE_BYTES, HELD, SHARD = 3 << 20, 4, 100_000
#: Bits of a filter for each counter in it, and bits of the largest filter (64 MB).
BITS_EACH, LEAST_BITS, MAX_BITS = 32, 1 << 16, 1 << 29
BROADCAST_ROWS = 100_000
#: Of each byte: 1 if it parts words, 2 if it parts pieces.
_KIND = np.zeros(256, np.uint8)
_KIND[[9, 32]] = 1
_KIND[[*b".,;:!?", 10, 11, 12, 13]] = 2
_NEXT = np.uint64(0xD6E8FEB86659FD93)


class Pieces:
    """The words of some texts: their bytes with A-Z as a-z, joined by one space, with a space around each piece and a line end after it."""

    def __init__(self, texts: pa.Array):
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = texts.buffers()[2]
        raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
        # A break after every text keeps texts apart.
        kept = np.empty(len(raw) + len(texts), np.uint8)
        ends = offsets[1:] - offsets[0] + np.arange(len(texts))
        own = np.ones(len(kept), bool)
        own[ends] = False
        kept[own], kept[ends] = raw, 10
        kind = _KIND[kept]
        inside = kind == 0
        edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
        start, end = edge[::2], edge[1::2]
        # The words' places among the breaks tell whether the next word, or the next two, are in the same piece.
        piece = np.searchsorted(np.flatnonzero(kind == 2), start)
        self.length = end - start
        self.two = np.zeros(len(start), bool)
        self.two[:-1] = piece[1:] == piece[:-1]
        self.three = np.zeros(len(start), bool)
        self.three[:-2] = piece[2:] == piece[:-2]
        joined = LOWER[kept[inside]]
        # Each word is preceded by a space; the last one of a piece is followed by a space and a line end.
        last = ~self.two
        room = self.length + 1 + 2 * last
        self.end = np.cumsum(room) - 2 * last
        self.start = self.end - self.length
        size = int(room.sum())
        step = np.zeros(size + 1, np.int8)
        step[self.start] = 1
        step[self.end] -= 1
        self.bytes = np.full(size, 32, np.uint8)
        self.bytes[np.cumsum(step[:-1], dtype=np.int8).view(bool)] = joined
        self.bytes[self.end[last] + 1] = 10
        #: Each word's number among the distinct ones, their bytes, and hashes that tell most of them apart, which is enough for a sketch.
        self.word, self.distinct = distinct_words(joined, self.length)
        self.word = self.word.astype(np.int64)
        at = np.frombuffer(self.distinct.buffers()[1], np.int64)[: len(self.distinct) + 1]
        data = self.distinct.buffers()[2]
        self.names = polynomials(np.frombuffer(data, np.uint8) if data is not None else joined, at[:-1], at[1:], False)


def seed_of(lang: str) -> np.uint64:
    return word_names(pa.array([lang.encode()], pa.large_binary()), b"language")[0, 1]


def pairs_of(words: np.ndarray) -> np.ndarray:
    """A number for every word and the next one; that of the last word means nothing."""
    return mix64(words * _NEXT + np.append(words[1:], np.uint64(0)) + np.uint64(2))


def triples_of(pairs: np.ndarray, words: np.ndarray) -> np.ndarray:
    """A number for every word and the next two."""
    return mix64(pairs * _NEXT + np.concatenate((words[2:], np.zeros(2, np.uint64)))[: len(words)] + np.uint64(3))


class Filter:
    """A set of counters as bits; it may hold others too."""

    def __init__(self, size: int):
        self.bits = np.zeros(size // 8, np.uint8)

    def places(self, counters: np.ndarray) -> np.ndarray:
        return (counters >> np.uint64(64 - int(len(self.bits) * 8).bit_length() + 1)).astype(np.int64)

    def holds(self, counters: np.ndarray) -> np.ndarray:
        at = self.places(counters)
        return self.bits[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1


def by_language(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.Array]]:
    """language, texts: the rows (text, lang) again, those of one language together, in slices of about SLICE_BYTES; of many languages HELD times as much waits at most."""
    held: dict[str, list[pa.Array]] = {}
    size: dict[str, int] = {}

    def taken(lang: str) -> tuple[str, pa.Array]:
        del size[lang]
        return lang, pa.concat_arrays(held.pop(lang))

    for part in slices(batches, text=0, step=SLICE_BYTES // 4):
        langs = pc.fill_null(part.column(1).cast(pa.string()), "und").dictionary_encode()
        codes, texts = langs.indices.to_numpy(), part.column(0).cast(pa.large_string())
        for k, lang in enumerate(langs.dictionary.to_pylist()):
            own = texts.filter(pa.array(codes == k))
            held.setdefault(lang, []).append(own)
            size[lang] = size.get(lang, 0) + int(pc.sum(pc.binary_length(own)).as_py() or 0)
            if size[lang] >= SLICE_BYTES:
                yield taken(lang)
        while sum(size.values()) >= HELD * SLICE_BYTES:
            yield taken(max(size, key=size.__getitem__))
    for lang in list(held):
        yield taken(lang)


def counters(texts: DataFrame, known: Broadcast | None, least: int, folder: str) -> DataFrame:
    """counter: those that reach least, of words and pairs; or, where the filter of these is known, of three words whose pairs it holds."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, part in by_language(batches):
            pieces = Pieces(part)
            words = mix64(pieces.names ^ seed_of(lang))[pieces.word]
            pairs = pairs_of(words)
            if known is None:
                found = np.concatenate((words, pairs[pieces.two]))
            else:
                fine = known.value.holds(pairs)
                fine[:-1] &= fine[1:]
                found = triples_of(pairs, words)[fine & pieces.three]
            counter, count = np.unique(found, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(counter.view(np.int64)), pa.array(count.astype(np.int32))], ["counter", "count"])

    sketch = texts.mapInArrow(counted, "counter long, count int")
    return materialised(sketch.groupBy("counter").agg(F.sum("count").alias("count")).where(F.col("count") >= least).select("counter"), folder)


def filter_of(found: DataFrame) -> Filter:
    """The counters as a filter whose size follows their number, up to MAX_BITS; tasks make the strips of it."""
    size = min(max(LEAST_BITS, 1 << (found.count() * BITS_EACH).bit_length()), MAX_BITS)
    out, strip = Filter(size), LEAST_BITS
    shift = np.uint64(64 - size.bit_length() + 1)

    def strips(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Sorted by strip: one of them at a time.
        at, bits = None, None

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"strip": pa.array([at], pa.int64()), "bits": [np.packbits(bits, bitorder="little").tobytes()]})

        for batch in batches:
            number = batch.column(0).to_numpy()
            place = (batch.column(1).to_numpy().view(np.uint64) >> shift).astype(np.int64) % strip
            cuts = np.append(np.flatnonzero(np.append(True, number[1:] != number[:-1])), len(number)) if len(number) else [0]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if number[a] != at:
                    if at is not None:
                        yield row()
                    at, bits = number[a], np.zeros(strip, bool)
                bits[place[a:b]] = True
        if at is not None:
            yield row()

    number = F.shiftrightunsigned("counter", 64 - (size // strip).bit_length() + 1) if size > strip else F.lit(0).cast("long")
    rows = found.select(number.alias("strip"), "counter").repartition("strip").sortWithinPartitions("strip").mapInArrow(strips, "strip long, bits binary")
    for row in rows.toLocalIterator():  # MAX_BITS in all at most
        out.bits[row.strip * strip // 8 : (row.strip + 1) * strip // 8] = np.frombuffer(row.bits, np.uint8)
    return out


def symbols(word: np.ndarray, distinct: int, last: np.ndarray) -> tuple[str, np.ndarray, int]:
    """The texts in symbols, each word's place in them, and how many symbols a word is.

    A word is its number's digits to the base 64, and each digit's place has an alphabet
    of its own, so nothing matches from within a word; a piece ends in a delimiter that
    no phrase has.  Few letters at every node are what makes the automaton fast.
    """
    digits = max(1, -(-max(distinct - 1, 1).bit_length() // 6))
    breaks = np.cumsum(last) - last
    place = np.arange(len(word)) * digits + breaks
    out = np.full(len(word) * digits + int(last.sum()), 10, np.uint32)
    for k in range(digits):
        out[place + k] = 0x4E00 + 64 * k + (word >> 6 * (digits - 1 - k) & 63)
    return out.tobytes().decode("utf-32-le"), place, digits


def matches(phrases: list[str], text: str) -> np.ndarray:
    """How often each phrase occurs in the text, overlaps included."""
    out = np.zeros(len(phrases), np.int64)
    for at in range(0, len(phrases), SHARD):
        automaton = ahocorasick.Automaton()
        for k, phrase in enumerate(phrases[at : at + SHARD]):
            automaton.add_word(phrase, at + k)
        automaton.make_automaton()
        out += np.bincount(np.fromiter((k for _, k in automaton.iter(text)), np.int64), minlength=len(phrases))
    return out


def phrase_counts(texts: DataFrame, pairs: Broadcast, triples: Broadcast, least: int) -> DataFrame:
    """lang, phrase, size, count of the phrases of one to three words that occur at least so often, and, as the phrase of no words, all words of a language."""

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, part in by_language(batches):
            pieces = Pieces(part)
            words = mix64(pieces.names ^ seed_of(lang))[pieces.word]
            two = pairs_of(words)
            fine_two = pieces.two & pairs.value.holds(two)
            fine_three = fine_two & pieces.three & triples.value.holds(triples_of(two, words))
            fine_three[:-1] &= fine_two[1:]
            found, size, coded = [], [], []
            one = pieces.word
            text, place, digits = symbols(one, len(pieces.names), ~pieces.two)
            pair_at = np.flatnonzero(fine_two)
            pair = np.zeros(len(one), np.int64)
            pair[pair_at] = np.unique(one[pair_at] * len(pieces.names) + one[pair_at + 1], return_inverse=True)[1]
            triple_at = np.flatnonzero(fine_three)
            for n, at, number in ((2, pair_at, pair[pair_at]), (3, triple_at, pair[triple_at] * len(pieces.names) + one[triple_at + 2] if len(triple_at) else triple_at)):
                first = at[np.unique(number, return_index=True)[1]]
                found += [pieces.bytes[a:b].tobytes().decode() for a, b in zip(pieces.start[first].tolist(), pieces.end[first + n - 1].tolist(), strict=True)]
                coded += [text[a : a + n * digits] for a in place[first].tolist()]
                size += [n] * len(first)
            # Single words need no automaton: each is itself.
            words_of = mix64(pieces.names ^ seed_of(lang))
            held = np.flatnonzero(pairs.value.holds(words_of))
            singles = pieces.distinct.take(pa.array(held)).cast(pa.large_string()).to_pylist()
            count = matches(coded, text)
            single = np.bincount(one, minlength=len(pieces.names))[held]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * (1 + len(singles) + len(found))), pa.array(["", *singles, *found], pa.string()), pa.array([0, *[1] * len(singles), *size], pa.int32()), pa.array(np.concatenate(([len(words)], single, count)))], ["lang", "phrase", "size", "count"])

    found = texts.mapInArrow(scanned, "lang string, phrase string, size int, count long")
    return found.groupBy("lang", "phrase", "size").agg(F.sum("count").alias("count")).where((F.col("count") >= least) | (F.col("size") == 0))


def scored(counts: DataFrame, nested: int, folder: str) -> DataFrame:
    """lang, phrase, a, l, r, n, score of the candidates that no longer one replaces; counts: phrase_counts()."""
    many = materialised(counts, folder)
    word = F.split("phrase", " ")

    def run(first: int, size: int) -> Column:
        return F.array_join(F.slice(word, first, size), " ")

    longer = many.where("size >= 2").select("lang", "phrase", "size", F.col("count").alias("a"))
    cut_two = F.struct(F.lit(1).alias("cut"), run(1, 1).alias("left"), run(2, 1).alias("right"))
    cuts_three = (F.struct(F.lit(1).alias("cut"), run(1, 1).alias("left"), run(2, 2).alias("right")), F.struct(F.lit(2).alias("cut"), run(1, 2).alias("left"), run(3, 1).alias("right")))
    cuts = longer.select("lang", "phrase", "a", F.explode(F.when(F.col("size") == 2, F.array(cut_two)).otherwise(F.array(*cuts_three))).alias("c")).select("lang", "phrase", "a", "c.*")
    parts = many.where("size between 1 and 2").select("lang", F.col("phrase").alias("part"), F.col("count").alias("f"))
    # A common word is part of very many phrases: its count is dealt over salts, as they are.
    salts = 16
    salted = parts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    ends = cuts.select("*", F.explode(F.array(F.struct(F.lit(True).alias("first"), F.col("left").alias("part")), F.struct(F.lit(False).alias("first"), F.col("right").alias("part")))).alias("e")).select("lang", "phrase", "a", "cut", "e.*")
    met = ends.withColumn("salt", F.pmod(F.xxhash64("phrase", "cut"), F.lit(salts)).cast("int")).join(salted, ["lang", "part", "salt"])
    both = met.groupBy("lang", "phrase", "a", "cut").agg(F.max(F.when(F.col("first"), F.col("f"))).alias("l"), F.max(F.when(~F.col("first"), F.col("f"))).alias("r"))
    wide = {c: F.col(c).cast("decimal(19,0)") for c in ("a", "l", "r")}
    product = (wide["a"] * wide["a"]).cast("decimal(31,0)") * F.lit(1_000_000).cast("decimal(7,0)")
    both = both.withColumn("up", product.cast("decimal(38,0)")).withColumn("down", (wide["l"] * wide["r"]).cast("decimal(38,0)")).withColumn("score", F.expr("up div down"))
    best = both.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("best")).select("lang", "phrase", "a", "best.l", "best.r", "best.score")
    inner = longer.where("size = 3").select("lang", F.explode(F.array_distinct(F.array(run(1, 2), run(2, 2)))).alias("phrase"), F.col("a").alias("outer"))
    most = inner.groupBy("lang", "phrase").agg(F.max("outer").alias("outer"))
    total = F.broadcast(many.where("size = 0").select("lang", F.col("count").alias("n"))) if many.where("size = 0").count() <= BROADCAST_ROWS else many.where("size = 0").select("lang", F.col("count").alias("n"))
    kept = best.join(most, ["lang", "phrase"], "left").where(F.col("outer").isNull() | (100 * F.col("outer") < nested * F.col("a")))
    return kept.join(total, "lang").select("lang", "phrase", "a", "l", "r", "n", "score")


def collocations(docs: DataFrame, least: int = 10, nested: int = 50, top: int = 2000) -> DataFrame:
    """lang, rank (from 1), phrase, a, l, r, n, score: each language's first phrases by score, then count, then phrase; docs: text, lang."""
    with scratch(docs.sparkSession) as folder:
        return materialised(_collocations(docs.select("text", "lang"), least, nested, top, folder))


def _collocations(texts: DataFrame, least: int, nested: int, top: int, folder: str) -> DataFrame:
    context = texts.sparkSession.sparkContext
    pairs = context.broadcast(filter_of(counters(texts, None, least, folder)))
    triples = context.broadcast(filter_of(counters(texts, pairs, least, folder)))
    found = scored(phrase_counts(texts, pairs, triples, least), nested, folder)
    # A language's first ones are among the first ones of its parts, so no task ranks more than a few parts' first ones.
    order = (F.desc("score"), F.desc("a"), "phrase")
    for parts in (64, 4):
        part = F.pmod(F.xxhash64("phrase"), F.lit(parts))
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang", part).orderBy(*order))).where(F.col("rank") <= top).drop("rank")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    return found.withColumn("rank", rank).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
