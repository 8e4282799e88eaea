"""Scalar functions over columns: region and size texts, flags, names, paths and prices.  All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

REGION = r"^([^:]+)(?::([0-9,]+)([KkMm]?)-([0-9,]+)([KkMm]?))?$"
SIZE = r"^([0-9]+)([KkMmGg]?)$"


def parse_region(text: Column) -> Column:
    """struct(reference, start, end) of "ref", "ref:1,000-2,000" or "ref:1M-2M"; start 0 and end null for a whole reference; null if malformed or empty."""

    def number(digits: int, unit: int) -> Column:
        scale = F.when(F.upper(F.regexp_extract(text, REGION, unit)) == "K", 1_000).when(F.upper(F.regexp_extract(text, REGION, unit)) == "M", 1_000_000).otherwise(1)
        return F.regexp_replace(F.regexp_extract(text, REGION, digits), ",", "").try_cast("long") * scale

    whole = F.regexp_extract(text, REGION, 2) == ""
    start, end = F.coalesce(number(2, 3), F.lit(0)), number(4, 5)
    valid = F.regexp_like(text, F.lit(REGION)) & (whole | (start < end))
    return F.when(valid, F.struct(F.regexp_extract(text, REGION, 1).alias("reference"), start.cast("long").alias("start"), F.when(~whole, end).cast("long").alias("end")))


def parse_size(text: Column) -> Column:
    """Bytes of "512", "512K", "1m", "8G" (powers of 1024); null if malformed."""
    unit = F.upper(F.regexp_extract(text, SIZE, 2))
    scale = F.when(unit == "K", 1 << 10).when(unit == "M", 1 << 20).when(unit == "G", 1 << 30).otherwise(1).cast("long")
    return F.when(F.regexp_like(text, F.lit(SIZE)), F.regexp_extract(text, SIZE, 1).try_cast("long") * scale)


def is_power_of_two(n: Column) -> Column:
    return (n > 0) & (n.bitwiseAND(n - 1) == 0)


def parse_chunk_size(text: Column) -> Column:
    """As parse_size, but null unless a power of two from 256K to 8M."""
    n = parse_size(text)
    return F.when(is_power_of_two(n) & n.between(256 << 10, 8 << 20), n)


def format_chunk_size(n: Column) -> Column:
    return (
        F.when((n >= 1 << 20) & (n % (1 << 20) == 0), F.concat((n / (1 << 20)).cast("long").cast("string"), F.lit("M")))
        .when((n >= 1 << 10) & (n % (1 << 10) == 0), F.concat((n / (1 << 10)).cast("long").cast("string"), F.lit("K")))
        .otherwise(n.cast("string"))
    )


def format_duration(seconds: Column) -> Column:
    s = seconds.cast("long")
    h, m, r = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    return F.when(h > 0, F.concat_ws("", h, F.lit("h"), m, F.lit("m"), r, F.lit("s"))).when(m > 0, F.concat_ws("", m, F.lit("m"), r, F.lit("s"))).otherwise(F.concat_ws("", r, F.lit("s")))


def has_flag(flag: Column, mask: int) -> Column:
    return flag.bitwiseAND(mask) != 0


def is_mapped(reference_id: Column, flag: Column, mapped_by: str = "reference") -> Column:
    """mapped_by "reference": the id is not negative; "flag": bit 4 is clear."""
    return reference_id >= 0 if mapped_by == "reference" else ~has_flag(flag, 4)


def chunk_start(position: Column, size: int) -> Column:
    """Truncating division, as for coordinates that are never negative."""
    return (position / size).cast("long") * size


def chunk_path(reference: Column, start: Column, size: int) -> Column:
    """reference/000000000-001048576.chunk, or unmapped.chunk where the reference is null."""
    return F.coalesce(F.concat(reference, F.lit("/"), F.format_string("%09d-%09d.chunk", start, start + size)), F.lit("unmapped.chunk"))


def shard_prefix(path: Column, bits: int) -> Column:
    """The first bits (4 to 8) of the path's SHA-256 in hex: one digit up to four bits, else two."""
    first = F.conv(F.substring(F.sha2(path.cast("binary"), 256), 1, 2), 16, 10).cast("int")
    number = F.shiftright(first, 8 - bits)
    return F.lower(F.lpad(F.hex(number.cast("long")), 1 if bits <= 4 else 2, "0"))


def mate_reference(rnext: Column, own: Column, names: Column) -> Column:
    """-1 for "*", the own id for "=", else the id of the name in the map."""
    return F.when(rnext == "*", -1).when(rnext == "=", own).otherwise(F.coalesce(F.try_element_at(names, rnext), F.lit(-1)))


def genotype_code(gt: Column) -> Column:
    """0/0, 0/1, 1/1, ./. (phased or not) as 0 to 3; null otherwise."""
    plain = F.replace(gt, F.lit("|"), F.lit("/"))
    return F.when(plain == "0/0", 0).when(plain.isin("0/1", "1/0"), 1).when(plain == "1/1", 2).when(plain == "./.", 3)


def segment_index(seconds: Column, width: float = 30) -> Column:
    return F.floor(seconds / width).cast("long")


def split_uri(uri: Column) -> Column:
    """struct(scheme, bucket, key) of scheme://bucket/key; null without a bucket."""
    pattern = r"^([a-z0-9]+)://([^/]+)/?(.*)$"
    return F.when(F.regexp_like(uri, F.lit(pattern)), F.struct(*(F.regexp_extract(uri, pattern, k).alias(n) for k, n in enumerate(("scheme", "bucket", "key"), 1))))


def request_cost(requests: Column, n_bytes: Column, a_thousand_requests: float = 0.0004, a_gigabyte: float = 0.09) -> Column:
    """Price of reading objects: requests plus transfer."""
    return requests / 1000 * a_thousand_requests + n_bytes / float(1 << 30) * a_gigabyte
