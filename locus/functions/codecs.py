"""CIGAR, sequence, quality, tag and header codecs as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Operation letters by their number, and the 4-bit base codes.
CIGAR_OPS = "MIDNSHP=X"
BASES, NIBBLES = "ACGTN", "1248F"
REFERENCE_OPS = ("M", "D", "N", "=", "X")


def cigar_ops(cigar: Column) -> Column:
    """array<struct<op, len>>; an absent CIGAR ("*" or null) has no operations."""
    items = F.regexp_extract_all(F.coalesce(cigar, F.lit("")), F.lit("([0-9]+[MIDNSHP=X])"), F.lit(1))
    return F.transform(items, lambda x: F.struct(F.right(x, F.lit(1)).alias("op"), F.left(x, F.length(x) - 1).cast("int").alias("len")))


def reference_span(cigar: Column) -> Column:
    """Reference bases that an alignment covers."""
    counted = F.filter(cigar_ops(cigar), lambda x: x["op"].isin(*REFERENCE_OPS))
    return F.aggregate(counted, F.lit(0).cast("long"), lambda a, x: a + x["len"])


def cigar_text(ops: Column) -> Column:
    return F.array_join(F.transform(ops, lambda x: F.concat(x["len"].cast("string"), x["op"])), "")


def _number(op: Column) -> Column:
    return F.call_function("instr", F.lit(CIGAR_OPS), op) - 1


def pack_cigar(ops: Column) -> Column:
    """array<long> of length << 4 | operation number."""
    return F.transform(ops, lambda x: F.shiftleft(x["len"].cast("long"), 4).bitwiseOR(_number(x["op"]).cast("long")))


def unpack_cigar(packed: Column) -> Column:
    return F.transform(packed, lambda v: F.struct(F.substring(F.lit(CIGAR_OPS), v.bitwiseAND(15).cast("int") + 1, F.lit(1)).alias("op"), F.shiftright(v, 4).cast("int").alias("len")))


def encode_sequence(sequence: Column) -> Column:
    """Two bases a byte; anything but A, C, G, T becomes N; an odd end is padded with 0."""
    plain = F.regexp_replace(F.upper(sequence), "[^ACGT]", "N")
    digits = F.translate(plain, BASES, NIBBLES)
    return F.unhex(F.concat(digits, F.when(F.length(plain) % 2 == 1, "0").otherwise("")))


def decode_sequence(packed: Column, length: Column) -> Column:
    return F.substring(F.translate(F.hex(packed), NIBBLES + "0", BASES + "N"), F.lit(1), length)


def quality_values(quality: Column) -> Column:
    """Phred numbers of a quality text; none for "*"."""
    q = F.when(quality == "*", "").otherwise(F.coalesce(quality, F.lit("")))
    return F.transform(F.filter(F.split(q, ""), lambda c: c != ""), lambda c: F.ascii(c) - 33)


def quality_text(values: Column) -> Column:
    return F.array_join(F.transform(values, lambda v: F.char(v + 33)), "")


def average_quality(quality: Column) -> Column:
    values = quality_values(quality)
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, v: a + v) / F.nullif(F.size(values), F.lit(0))


#: The types of tags, and texts that are read as whole numbers or numbers where no type is given.
TAG_TYPED, TAG_INTEGER, TAG_FLOAT = "(?s)^[AifZHB]:.*", "^(0|-?[1-9][0-9]{0,8})$", "^[-+]?[0-9]+[.][0-9]+([eE][-+]?[0-9]+)?$"


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once a row: inside of another function over an array it would be computed for each element."""
    return F.transform(F.array(value), use)[0]


def _first_of_each(entries: Column) -> Column:
    """Entries (key, value) without those whose key came before: one odd line must not end a job."""
    return _once(entries, lambda all: _once(F.transform(all, lambda e: e["key"]), lambda keys: F.filter(all, lambda e, k: F.array_position(keys, e["key"]) == k + 1)))


def tags_map(fields: Column) -> Column:
    """map<tag, "T:value"> of an array of TAG:T:VALUE texts: the type stays with its value; a repeated tag counts where it comes first."""
    fine = F.filter(fields, lambda f: F.regexp_like(f, F.lit("(?s)^[A-Za-z][A-Za-z0-9]:[A-Za-z]:.*")))
    return F.map_from_entries(_first_of_each(F.transform(fine, lambda f: F.struct(F.substring(f, 1, 2).alias("key"), F.substr(f, F.lit(4)).alias("value")))))


def typed_tag(value: Column) -> Column:
    """A tag's "T:value"; a value without a type gets one: i for whole numbers, f for numbers with a fraction, else Z."""
    kind = F.when(F.regexp_like(value, F.lit(TAG_INTEGER)), "i").when(F.regexp_like(value, F.lit(TAG_FLOAT)), "f").otherwise("Z")
    return F.when(F.regexp_like(value, F.lit(TAG_TYPED)), value).otherwise(F.concat_ws(":", kind, value))


def tag_value(value: Column) -> Column:
    """A tag's value without its type."""
    return F.when(F.regexp_like(value, F.lit(TAG_TYPED)), F.substr(value, F.lit(3))).otherwise(value)


def tag_text(tag: Column, value: Column) -> Column:
    """TAG:T:VALUE."""
    return F.concat_ws(":", tag, typed_tag(value))


def header_fields(line: Column) -> Column:
    """map<key, value> of a header line's tab-separated KEY:VALUE fields; a repeated key counts where it comes first."""
    parts = F.filter(F.split(line, "\t"), lambda p: ~p.startswith("@") & p.contains(":"))
    return F.map_from_entries(_first_of_each(F.transform(parts, lambda p: F.struct(F.substring_index(p, ":", 1).alias("key"), F.substr(p, F.length(F.substring_index(p, ":", 1)) + 2).alias("value")))))
