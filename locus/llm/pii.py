"""Offset-preserving detection of personal data, disguised or not.

Two passes over every whole text.  The base pass finds plain e-mail addresses,
IP addresses, payment cards and phone numbers.  The second pass runs a chain of
transducers over the text: look-alike letters become ASCII, invisible characters
vanish, spelled digits become digits and at/dot disguises become signs.  Digit
words are read in two ways, runs of five or more as one number and any that
touch other digits in place, and the detectors look at every reading.  A digit
word of prose right after an identifier may be taken for its end.  Every
normalised character remembers the source range that it came from, so what the
detectors find in the normalised text maps back to source offsets.  A span found
there is added unless one base span covers it: the plain pass often sees but a
fragment of a disguised identifier.  Overlapping spans are masked as one.

Offsets are code points, ends are exclusive.  A null text counts as empty and
yields no span.  Every pattern reads a run of characters a bounded number of times, so
time and memory grow with the text and no faster.  Repeated rows are judged alike.
Extra columns are kept where the result allows it; a column named like an output
column is replaced.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from locus.llm.textops import slices

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int]

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can only begin where a digit run begins, and takes that run whole.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL_TAIL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def _emails(text: str) -> Iterator[Span]:
    done, at = 0, text.find("@")
    while at >= 0:
        domain = _DOMAIN.match(text, at + 1)
        if domain:
            start = at
            while start > done and text[start - 1] in _LOCAL_TAIL:
                start -= 1
            if start < at:
                done = domain.end()
                yield start, done
        at = text.find("@", max(at + 1, done))


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def _luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def find(text: str) -> dict[str, list[Span]]:
    """Plain identifiers: leftmost non-overlapping matches of each kind, those that fail their check dropped."""
    return {
        "email": list(_emails(text)),
        "ip": [m.span() for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))],
        "card": [m.span() for m in _CARD.finditer(text) if 13 <= len(d := _digits(m[0])) <= 19 and _luhn(d)],
        "phone": [m.span() for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15],
    }


# Letters of other scripts that look like ASCII ones.
_LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "е": "e", "н": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p", "ѕ": "s", "т": "t", "х": "x", "у": "y",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "Х": "X", "У": "Y",
    "α": "a", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ı": "i", "ɡ": "g", "\u2024": ".", "。": ".", "\u2010": "-", "\u2011": "-", "\u2012": "-", "\u2013": "-", "\u2212": "-",
    "\u00a0": " ", "\u2009": " ", "\u202f": " ",
}
_INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
_SPELLED = {"zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
_ODD = re.compile(f"[{''.join(map(re.escape, _LOOKALIKES))}{_INVISIBLE}\uff01-\uff5e\U0001d400-\U0001d7ff\u0660-\u0669]")
_DIGIT_WORD = "|".join(_SPELLED)
# One number: at least five digits in words or signs, the first of them in a word or after "plus".
_DIGIT_RUN = re.compile(rf"\b(?:plus[ -]++)?(?:{_DIGIT_WORD})\b(?:[ ,.-]{{1,2}}(?:{_DIGIT_WORD}|[0-9]++|dot|point)\b){{4,}}", re.I)
# Digits and digit words in place, of any length: the detectors' checks tell them from prose.
_MIXED_RUN = re.compile(rf"\b(?:plus[ -]{{1,2}})?(?:{_DIGIT_WORD}|[0-9]++)\b(?:[ ,.-]{{1,2}}(?:{_DIGIT_WORD}|[0-9]++|dot|point)\b)+", re.I)
_DIGIT_TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|[ ,.-]+")
# Spaces before a bracket are taken from the first of them or not at all, so that a long run of them is read once.
_OPEN = r"(?:(?<![ ])[ ]++)?[\[({<][ ]*+"
_AT = rf"(?:{_OPEN}(?:at|@)[ ]*+[\])}}>][ ]*+)"
_DOT = rf"(?:{_OPEN}(?:dot|\.)[ ]*+[\])}}>][ ]*+)"
_LABEL = "[A-Za-z0-9-]{1,63}"
_DISGUISE = re.compile(rf"{_AT}|{_DOT}|(?<=[A-Za-z0-9]) at (?={_LABEL}(?:\.{_LABEL}){{0,8}}(?: dot |{_DOT}){_LABEL})|(?<=[A-Za-z0-9]) dot (?=[A-Za-z0-9])", re.I)
# " at " before a dotted domain, where what stands before looks like a mailbox and no word: parts joined by signs, one of them longer than a letter, or two digits at the end.
_MAILBOX_AT = re.compile(
    rf"(?<![A-Za-z0-9._%+-])(?=[A-Za-z0-9._+]{{0,62}}[A-Za-z0-9]{{2}})[A-Za-z](?:[A-Za-z0-9]{{0,40}}(?:[._+][A-Za-z0-9]{{1,40}}){{1,5}}|[A-Za-z]{{1,40}}[0-9]{{2,9}})(?P<at> at )(?={_LABEL}(?:\.{_LABEL}){{0,8}}\.(?:[a-z]{{2,63}}|[A-Z]{{2,63}})\b)"
)
_HINT = re.compile(r"[\[({<] *+(?:at|dot|[@.]) *+[\])}>]| dot ", re.I)
_NUMBER_HINT = re.compile(rf"\b(?:{_DIGIT_WORD})[ ,.-]{{1,2}}(?:{_DIGIT_WORD}|[0-9])|[0-9][ ,.-]{{1,2}}(?:{_DIGIT_WORD})\b|\b(?:{_DIGIT_WORD}) (?:dot|point) [0-9]|[0-9] (?:dot|point) (?:{_DIGIT_WORD})\b", re.I)

#: A text with the source range [start, end) of each character; None: unchanged so far.
Traced = tuple[str, array | None, array | None]


def _rewrite(traced: Traced, pattern: re.Pattern, to) -> Traced:
    """One transducer: matches of pattern become to(match), a list of (character, start, end) relative to the text."""
    text, starts, ends = traced
    if not pattern.search(text):
        return traced
    if starts is None:
        starts, ends = array("q", range(len(text))), array("q", range(1, len(text) + 1))
    chars, a, b, done = [], array("q"), array("q"), 0
    for m in pattern.finditer(text):
        chars.append(text[done : m.start()])
        a += starts[done : m.start()]
        b += ends[done : m.start()]
        for c, s, e in to(m):
            chars.append(c)
            a.append(starts[s])
            b.append(ends[e - 1])
        done = m.end()
    chars.append(text[done:])
    return "".join(chars), a + starts[done:], b + ends[done:]


def _plain_letter(m: re.Match) -> list[tuple[str, int, int]]:
    c = m[0]
    folded = "" if c in _INVISIBLE else _LOOKALIKES.get(c) or unicodedata.normalize("NFKC", c)
    if folded and not folded.isascii():
        folded = str(unicodedata.digit(c, c))
    return [(folded, *m.span())] if len(folded) == 1 else []


def _digit_run(m: re.Match) -> list[tuple[str, int, int]]:
    out = []
    for t in _DIGIT_TOKEN.finditer(m[0]):
        a, b = m.start() + t.start(), m.start() + t.end()
        word = t[0].lower()
        if word in _SPELLED:
            out.append((_SPELLED[word], a, b))
        elif word in ("dot", "point"):
            out.append((".", a, b))
        elif word == "plus":
            out.append(("+", a, b))
        elif word.isdigit():
            out += [(c, a + k, a + k + 1) for k, c in enumerate(word)]
    return out


def _mixed_run(m: re.Match) -> list[tuple[str, int, int]]:
    """Digit words in place: digits stay as written, a separator beside a word becomes one that the detectors know, between two words it goes unless it is a dot."""
    tokens = [(t[0].lower(), m.start() + t.start(), m.start() + t.end()) for t in _DIGIT_TOKEN.finditer(m[0])]
    if not any(t in _SPELLED for t, _, _ in tokens):
        return [(c, m.start() + k, m.start() + k + 1) for k, c in enumerate(m[0])]
    out = []
    for k, (t, a, b) in enumerate(tokens):
        if t in _SPELLED:
            out.append((_SPELLED[t], a, b))
        elif t in ("dot", "point"):
            out.append((".", a, b))
        elif t == "plus":
            out.append(("+", a, b))
        elif t.isdigit():
            out += [(c, a + i, a + i + 1) for i, c in enumerate(t)]
        else:
            sides = tokens[k - 1][0], tokens[k + 1][0]
            if sides[0].isdigit() and sides[1].isdigit():
                out += [(c, a + i, a + i + 1) for i, c in enumerate(t)]
            elif t == ".":
                out.append((".", a, b))
            elif not ({"plus", "dot", "point"} & set(sides)) and any(x.isdigit() for x in sides):
                out.append(("-" if "-" in t else " ", a, b))
    return out


def _mailbox(m: re.Match) -> list[tuple[str, int, int]]:
    a, b = m.span("at")
    return [*((c, m.start() + k, m.start() + k + 1) for k, c in enumerate(m[0][: a - m.start()])), ("@", a, b)]


def _sign(m: re.Match) -> list[tuple[str, int, int]]:
    return [("@" if "at" in m[0].lower() or "@" in m[0] else ".", *m.span())]


def _signs(traced: Traced) -> Traced:
    if _HINT.search(traced[0]):
        traced = _rewrite(traced, _DISGUISE, _sign)
    return _rewrite(traced, _MAILBOX_AT, _mailbox) if " at " in traced[0] else traced


def readings(text: str) -> list[Traced]:
    """What the chain of transducers makes of a text, other than the text itself: letters alone, then with signs and each reading of digit words."""
    letters: Traced = (text, None, None)
    if not text.isascii():
        letters = _rewrite(letters, _ODD, _plain_letter)
    out = [letters, _signs(letters)]
    if _NUMBER_HINT.search(letters[0]):
        out += [_signs(_rewrite(letters, _DIGIT_RUN, _digit_run)), _signs(_rewrite(letters, _MIXED_RUN, _mixed_run))]
    return list({t[0]: t for t in out if t[1] is not None}.values())


def find_all(text: str) -> tuple[dict[str, list[Span]], dict[str, list[Span]]]:
    """(base spans, all spans) of each kind, sorted by start."""
    base = find(text)
    more: dict[str, set[Span]] = {k: set() for k in KINDS}
    taken = sorted(s for spans in base.values() for s in spans)
    # The furthest end of the base spans up to each one: one that begins no later covers a span if that end does.
    reach = list(accumulate((e for _, e in taken), max))
    for plain, starts, ends in readings(text):
        for kind, spans in find(plain).items():
            for a, b in spans:
                start, end = starts[a], ends[b - 1]
                before = bisect_right(taken, (start, len(text)))
                if not before or reach[before - 1] < end:
                    more[kind].add((start, end))
    if not any(more.values()):
        return base, base
    # Of the readings' spans of a kind, those inside another one say nothing new.
    return base, {k: sorted(v + _outermost(more[k])) for k, v in base.items()}


def _outermost(spans: set[Span]) -> list[Span]:
    out: list[Span] = []
    for a, b in sorted(spans, key=lambda s: (s[0], -s[1])):
        if not out or b > out[-1][1]:
            out.append((a, b))
    return out


def joined(spans: dict[str, list[Span]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind in KINDS for a, b in spans[kind])


def detect(docs: DataFrame, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The columns carry of docs (None: all), the number of base spans of each kind, base_spans and spans ("kind:start:end", comma-joined)."""
    new = [f"n_{k}" for k in KINDS] + ["base_spans", "spans"]
    docs = docs.select(*(c for c in docs.columns if c.lower() not in new))
    out = [k for k, c in enumerate(docs.columns) if carry is None or c in carry]
    names, at = [docs.columns[k] for k in out] + new, docs.columns.index(text)

    def detected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text):
            found = [find_all(t or "") for t in part.column(at).to_pylist()]
            counts = [pa.array([len(base[kind]) for base, _ in found], pa.int64()) for kind in KINDS]
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in out), *counts, pa.array([joined(b) for b, _ in found], pa.string()), pa.array([joined(s) for _, s in found], pa.string())], names)

    fields = [T.StructField(n, T.LongType()) for n in new[:4]] + [T.StructField(n, T.StringType()) for n in new[4:]]
    return docs.mapInArrow(detected, T.StructType([*(docs.schema[k] for k in out), *fields]))


def mask_text(text: str) -> str:
    """The text with every span replaced by its kind's placeholder; overlapping spans become one placeholder of the first kind."""
    spans = sorted((a, b, kind) for kind, found in find_all(text)[1].items() for a, b in found)
    if not spans:
        return text
    out, done = [], 0
    for a, b, kind in spans:
        if a >= done:
            out += [text[done:a], f"<{kind.upper()}>"]
        done = max(done, b)
    return "".join(out) + text[done:]


def mask(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with all personal data in the text column replaced; null stays null."""
    at = docs.columns.index(text)

    def masked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text):
            new = pa.array([None if t is None else mask_text(t) for t in part.column(at).to_pylist()], part.column(at).type)
            yield part.set_column(at, part.schema.field(at), new)

    return docs.mapInArrow(masked, docs.schema)


def sha256_hex(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()
