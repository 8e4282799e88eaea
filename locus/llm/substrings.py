"""Substring dedup by recompression.

A word is removed when a window of ``size`` consecutive words covers it whose word
sequence also starts earlier: in a smaller doc_id, or earlier in the same one.

Rounds of naming shorten every text at once.  First runs of one word, then, round
after round, pairs of neighbours get a name that depends on nothing but their
content, the same on every machine; which neighbours pair up is decided by a bit
of each name.  A symbol is certain within a range of words around it; in equal
windows the symbols whose range lies inside are equal and lie alike.  A window's
anchor is the longest of them (ties: by name, then the leftmost), so windows that
repeat have equal anchors, and neighbouring windows mostly share theirs.

Spark counts the anchors of all texts.  Only where an anchor is shared do its
windows travel, together in one row, to where the others of that anchor are;
there they are compared by the names of all their words.  Of equal windows of one
slice of texts only the earliest travels, and of a slice's equal anchors one, so a
line that a third of all texts hold is a row a slice there; and windows of the most
frequent anchors are dealt by their own names.  Windows count as equal
when the anchor's name and the window's are, 59 and 62 bits that are made of the two
names of their words.  Every job draws the key of these names anew (textops.word_names),
so no windows can be made up that only seem equal, and chance needs some 2**60 pairs of
one anchor; the words themselves do not travel.

A null text has no words, texts of fewer than size words lose none.  Rows of one
doc_id are one document's: equal places of them are not earlier than each other,
so a repeated row is judged like the first.  A null doc_id precedes all others.
Extra columns are ignored, an empty table gives an empty result.
"""

from __future__ import annotations

import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locus.llm.textops import Words, gram_hashes, mix64, ranges, slices
from locus.sources.shared import materialised, scratch

#: Rounds of naming, and bytes of text among which equal anchors and windows are found before any travels.
ROUNDS, SLICE_BYTES = 6, 1 << 21
#: Rows (one a slice at most, besides single ones) that make an anchor frequent, and how many frequent ones are told apart.
HOT, HOT_NAMES = 10_000, 100_000
_LEFT, _RIGHT, _RUN = (np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xCA5A826395121157, 0x9FB21C651E98DF25))


def symbols(words: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, ...]:
    """All runs and pairs ever named: name, first word, number of words, and the range [low, high) that makes them certain."""
    n = len(words)
    opens = np.ones(n, bool)
    opens[1:] = (words[1:] != words[:-1]) | (text[1:] != text[:-1])
    start = np.flatnonzero(opens)
    end = np.append(start[1:], n)
    name = mix64(words[start] + (end - start).astype(np.uint64) * _RUN)
    low, high, owner = start - 1, end + 1, text[start]
    found = [(name, start, end - start, low, high)]
    for k in range(ROUNDS):
        left = mix64(name + np.uint64(k)) & np.uint64(1) == 0
        pair = np.zeros(len(name), bool)
        pair[:-1] = left[:-1] & ~left[1:] & (owner[:-1] == owner[1:])
        second = np.zeros(len(name), bool)
        second[1:] = pair[:-1]
        # What decides: a left symbol looks at the next one, a right symbol at the one before.
        nxt, prv = np.minimum(np.arange(len(name)) + 1, len(name) - 1), np.maximum(np.arange(len(name)) - 1, 0)
        other = np.where(left, nxt, prv)
        other = np.where(owner[other] == owner, other, np.arange(len(name)))
        new_low, new_high = np.minimum(low, low[other]), np.maximum(high, high[other])
        at = np.flatnonzero(pair)
        new_name, new_end = name.copy(), end.copy()
        new_name[at] = mix64(name[at] * _LEFT + name[at + 1] * _RIGHT + np.uint64(k))
        new_end[at] = end[at + 1]
        keep = ~second
        name, start, end, low, high, owner = new_name[keep], start[keep], new_end[keep], new_low[keep], new_high[keep], owner[keep]
        born = pair[keep]
        found.append((name[born], start[born], (end - start)[born], low[born], high[born]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def stretches(words: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """Runs of neighbouring windows with one anchor: the first window's place, their number, the text's number, the anchor's name, and how many symbols of that name they have."""
    n = len(words)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    window = np.arange(n) <= first[1:][text] - size
    if not window.any():
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    name, _, length, low, high = symbols(words, text)
    from_ = np.maximum(high - size, 0)
    fits = low >= from_
    # The length leads, so that the greatest name is that of the longest symbol.
    name = np.minimum(length[fits], 31).astype(np.uint64) << np.uint64(59) | name[fits] >> np.uint64(5)
    from_, count = from_[fits], (low - from_ + 1)[fits]
    by_count = np.argsort(-count, kind="stable")
    name, from_, count = name[by_count], from_[by_count], count[by_count]
    anchor = np.zeros(n, np.uint64)
    certain_at = [int(np.searchsorted(-count, -d)) for d in range(int(count.max(initial=0)))]  # the first symbols are in more than d windows
    for d, k in enumerate(certain_at):
        np.maximum.at(anchor, from_[:k] + d, name[:k])
    chosen = np.full(len(name), n)
    for d, k in reversed(list(enumerate(certain_at))):
        at = from_[:k] + d
        wins = np.flatnonzero((anchor[at] == name[:k]) & window[at])
        chosen[wins] = at[wins]
    # Windows without a certain symbol, such as those inside a long run of one word, are their own anchors.
    bare = np.flatnonzero((anchor == 0) & window)
    if len(bare):
        anchor[bare] = gram_hashes(words, size)[bare]
        chosen = np.concatenate((chosen, bare))
    place = np.flatnonzero(window)
    found, text = anchor[place], text[place]
    opens = np.ones(len(place), bool)
    opens[1:] = (found[1:] != found[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(opens)
    number = np.full(n + 1, len(at))
    number[place] = np.cumsum(opens) - 1
    times = np.bincount(number[chosen], minlength=len(at) + 1)[:-1]
    return place[at], np.diff(np.append(at, len(place))), text[at], found[at], times


def _ordinals(text: np.ndarray) -> np.ndarray:
    """0, 1, ... within each run of equal numbers."""
    opens = np.ones(len(text), bool)
    opens[1:] = text[1:] != text[:-1]
    at = np.arange(len(text))
    return at - np.maximum.accumulate(np.where(opens, at, 0))


def shared_anchors(docs: DataFrame, size: int, key: bytes, folder: str) -> tuple[DataFrame, np.ndarray]:
    """row, ordinals: those stretches of every row's text whose anchor occurs elsewhere too; and the most frequent anchors, at most HOT_NAMES of them."""

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, step=SLICE_BYTES):
            words, rows = Words(part.column(1)), part.column(0).to_numpy()
            _, _, text, name, times = stretches(words.names(False, key)[:, 0], words.first, size)
            # Two symbols are enough to tell that the windows of one stretch can equal each other.
            again = np.repeat(np.arange(len(text)), np.clip(times, 1, 2))
            name, row, ordinal = name[again], rows[text[again]], _ordinals(text)[again].astype(np.int32)
            # Anchors met twice in a slice are settled (ordinal below 0).  One of each goes where the others of its name are, the rest anywhere: a frequent anchor is a row a slice.
            order = np.argsort(name, kind="stable")
            same = name[order[1:]] == name[order[:-1]]
            rest, settled = np.zeros(len(name), bool), np.zeros(len(name), bool)
            rest[order[1:]] = same
            settled[order[1:]] = same
            settled[order[:-1]] |= same
            route = np.where(rest, mix64(row.view(np.uint64) + ordinal.astype(np.uint64)), name)
            yield pa.RecordBatch.from_arrays([pa.array(route.view(np.int64)), pa.array(row), pa.array(np.where(settled, -1 - ordinal, ordinal))], ["name", "row", "ordinal"])

    def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Sorted by name; the last row waits for the next batch.  A name of HOT rows or more is told by a row of its own: the name, and its rows below 0.
        held, held_twice, before = None, False, 0

        def busy(name: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(name[rows >= HOT]), pa.array(-np.minimum(rows[rows >= HOT], 2**31 - 1).astype(np.int32))], ["row", "ordinal"])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([held, batch] if held is not None else [batch]).combine_chunks().to_batches()[0]
            name, ordinal = rows.column(0).to_numpy(), rows.column(2).to_numpy()
            same = name[1:] == name[:-1]
            twice = ordinal < 0
            twice[1:] |= same
            twice[:-1] |= same
            twice[0] |= held_twice
            first = np.flatnonzero(np.append(True, ~same))
            size = np.diff(np.append(first, len(name)))
            size[0] += before
            yield busy(name[first[:-1]], size[:-1])
            held, held_twice, before = rows.slice(len(name) - 1), bool(twice[-1]), int(size[-1]) - 1
            twice[-1] = False
            yield pa.RecordBatch.from_arrays([rows.column(1).filter(pa.array(twice)), pa.array(np.maximum(ordinal, -1 - ordinal)[twice])], ["row", "ordinal"])
        if held is not None:
            yield busy(held.column(0).to_numpy(), np.array([before + 1]))
            if held_twice:
                ordinal = held.column(2).to_numpy()
                yield pa.RecordBatch.from_arrays([held.column(1), pa.array(np.maximum(ordinal, -1 - ordinal))], ["row", "ordinal"])

    rows = docs.select("row", "text").mapInArrow(named, "name long, row long, ordinal int")
    found = materialised(rows.repartition("name").sortWithinPartitions("name").mapInArrow(repeated, "row long, ordinal int"), folder)
    most = HOT
    while (hot := found.where(F.col("ordinal") <= -most).select("row")).count() > HOT_NAMES:
        most *= 4
    names = np.sort(np.array([r.row for r in hot.collect()], np.int64).view(np.uint64))
    return found.where("ordinal >= 0").groupBy("row").agg(F.collect_set("ordinal").alias("ordinals")), names


class Judge:
    """Tells for windows in the order of anchor, document and place which of them repeat an earlier one."""

    def __init__(self):
        self.name = None
        self.known = (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))

    def repeats(self, name: np.ndarray, doc: np.ndarray, place: np.ndarray, window: np.ndarray) -> np.ndarray:
        count = len(name)
        if not count:
            return np.zeros(0, bool)
        if name[0] == self.name:
            known, known_doc, known_place = self.known
            name = np.concatenate((np.full(len(known), name[0]), name))
            doc, place, window = np.concatenate((known_doc, doc)), np.concatenate((known_place, place)), np.concatenate((known, window))
        group = np.concatenate(([0], np.cumsum(name[1:] != name[:-1])))
        order = np.lexsort((window, group))  # stable: the earliest of equal windows stays first
        fresh = np.ones(len(order), bool)
        fresh[1:] = (window[order[1:]] != window[order[:-1]]) | (group[order[1:]] != group[order[:-1]])
        earliest = np.empty(len(order), np.int64)
        earliest[order] = order[np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))]
        out = (doc != doc[earliest]) | (place != place[earliest])
        # Only the last anchor can go on in what comes next.
        last = np.sort(order[fresh])
        last = last[group[last] == group[-1]]
        self.name, self.known = name[-1], (window[last], doc[last], place[last])
        return out[len(out) - count :]


def repeated_spans(docs: DataFrame, size: int, folder: str) -> DataFrame:
    """row, text_hash, spans: the word ranges that repeated windows cover."""

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, step=SLICE_BYTES):
            words = Words(part.column(1))
            names = words.names(False, key)
            place, count, text, name, _ = stretches(names[:, 0], words.first, size)
            ordinals = part.column(4)
            wanted = np.repeat(np.arange(len(ordinals)), np.asarray(ordinals.value_lengths())) << 32 | ordinals.flatten().to_numpy()
            use = np.isin(text << 32 | _ordinals(text), wanted)
            place, count, text, name = place[use], count[use], text[use], name[use]
            stretch = np.repeat(np.arange(len(count)), count)
            window = gram_hashes(names[:, 1], size)[ranges(place, count)]
            at = (ranges(place, count) - words.first[text[stretch]]).astype(np.int64)
            doc = part.column(0).to_numpy()[text]
            # Of equal windows of a slice only the earliest has to meet the others.
            order = np.lexsort((at, doc[stretch], name[stretch]))
            hit = np.zeros(len(window), bool)
            hit[order] = Judge().repeats(name[stretch[order]], doc[stretch[order]], at[order], window[order])
            # A frequent anchor's windows are dealt one by one, so that they are many tasks' work.
            single = np.isin(name, hot)[stretch]
            opens = single.copy()
            opens[:1] = True
            opens[1:] |= (stretch[1:] != stretch[:-1]) | (hit[1:] != hit[:-1])
            run = np.flatnonzero(opens)
            length, known = np.diff(np.append(run, len(window))), hit[run]
            offsets = np.concatenate(([0], np.cumsum(np.where(known, 0, length * 8)))).astype(np.int32)
            windows = pa.BinaryArray.from_buffers(pa.binary(), len(run), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(window[~hit].tobytes())])
            owner, begin = text[stretch[run]], at[run]
            # What is known needs no one to meet: it goes anywhere.
            route = np.where(known, mix64(begin.view(np.uint64) + name[stretch[run]]), np.where(single[run], mix64(name[stretch[run]] ^ window[run]), name[stretch[run]]))
            end = np.where(known, begin + length - 1 + size, 0)
            owners = pa.array(owner)
            yield pa.RecordBatch.from_arrays([pa.array(route.view(np.int64)), *(part.column(k).take(owners) for k in (0, 2, 3)), pa.array(begin), pa.array(end), windows], ["name", "doc", "row", "text_hash", "place", "known_end", "windows"])

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge, columns = Judge(), ["row", "text_hash", "a", "b"]
        for batch in batches:
            known = pc.greater(batch.column(5), 0)
            done = batch.filter(known)
            yield pa.RecordBatch.from_arrays([done.column(k) for k in (2, 3, 4, 5)], columns)
            batch = batch.filter(pc.invert(known))
            name, doc, owner, text_hash, place = (batch.column(k).to_numpy() for k in range(5))
            count = np.asarray(pc.binary_length(batch.column(6)), np.int64) // 8
            row = np.repeat(np.arange(len(count)), count)
            window = np.frombuffer(b"".join(batch.column(6).to_pylist()), np.uint64)
            at = place[row] + _ordinals(row)
            hit = np.flatnonzero(judge.repeats(name[row], doc[row], at, window))
            opens = np.ones(len(hit), bool)
            opens[1:] = (np.diff(hit) > 1) | (row[hit[1:]] != row[hit[:-1]])
            first, last = hit[opens], hit[np.append(opens[1:], True)] if len(hit) else hit
            yield pa.RecordBatch.from_arrays([pa.array(owner[row[first]]), pa.array(text_hash[row[first]]), pa.array(at[first]), pa.array(at[last] + size)], columns)

    key = secrets.token_bytes(32)
    ordinals, hot = shared_anchors(docs, size, key, folder)
    flagged = docs.join(ordinals, "row").select("doc", "text", "row", "text_hash", "ordinals")
    rows = flagged.mapInArrow(gathered, "name long, doc long, row long, text_hash int, place long, known_end long, windows binary")
    spans = rows.repartition("name").sortWithinPartitions("name", "doc", "place").mapInArrow(judged, "row long, text_hash int, a long, b long")
    return spans.groupBy("row", "text_hash").agg(F.collect_set(F.struct("a", "b")).alias("spans"))


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, doc (a null id as the least number), and what names a row in joins: 64 bits of id and text, and 32 more."""
    doc: Column = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    return docs.select("doc_id", "text", doc.alias("doc"), F.xxhash64("doc_id", "text").alias("row"), F.hash("text", "doc_id").alias("text_hash"))


def remove_repeats(docs: DataFrame, size: int = 20) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words left, joined by one space)."""
    docs = keyed(docs)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, step=SLICE_BYTES):
            words, spans = Words(part.column(1)), part.column(2)
            ends = spans.flatten()
            row = np.repeat(np.arange(len(spans)), np.asarray(pc.fill_null(spans.value_lengths(), 0)))
            cover = np.zeros(len(words.start) + 1, np.int64)
            np.add.at(cover, words.first[row] + ends.field(0).to_numpy(), 1)
            np.add.at(cover, words.first[row] + ends.field(1).to_numpy(), -1)
            kept = np.cumsum(cover[:-1]) == 0
            before = np.concatenate(([0], np.cumsum(kept)))[words.first]
            start, length = words.start[kept], (words.end - words.start)[kept] + 1
            text_end = np.zeros(len(start) + 1, bool)
            text_end[before[1:]] = True
            length -= text_end[1:]  # no space after a text's last word
            data = np.append(words.bytes, np.uint8(32))[ranges(start, length)]
            total = np.concatenate(([0], np.cumsum(length)))
            data[(total[1:] - 1)[~text_end[1:]]] = 32
            texts = pa.LargeStringArray.from_buffers(len(spans), pa.py_buffer(total[before].astype(np.int64).tobytes()), pa.py_buffer(data.tobytes()))
            n = np.diff(words.first)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), pa.array(n - np.diff(before)), texts.cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    with scratch(docs.sparkSession) as folder:
        spans = materialised(repeated_spans(docs, size, folder))
    return docs.join(spans, ["row", "text_hash"], "left").select("doc_id", "text", "spans").mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept string")
