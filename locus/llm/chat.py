r"""Chat formatting with Spark expressions only.

A conversation becomes one text: every run of adjacent turns of one role is a
block ``### role: text<+>text</turn>`` and a line end, with ``<+>`` between the
merged turns.  Control strings inside roles and texts are written as a backslash
and a digit (a backslash itself as ``\0``), so parsing gives back each turn.

Turns are ordered by turn (nulls first), then role, then text; repeated rows are
turns of their own.  A null role or text counts as empty.  Rows with a null
conv_id form one conversation.  Extra columns are ignored.  An empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAD, COLON, JOIN, CLOSE = "### ", ": ", "<+>", "</turn>"
#: In this order for escaping, in the reverse one for unescaping.
_CODES = (("\\", "\\0"), (HEAD, "\\1"), (CLOSE, "\\2"), (JOIN, "\\3"), (COLON, "\\4"))


def escape(text: Column) -> Column:
    for raw, code in _CODES:
        text = F.replace(text, F.lit(raw), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for raw, code in reversed(_CODES):
        text = F.replace(text, F.lit(code), F.lit(raw))
    return text


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often the body names it: Spark may copy the expression of a column to wherever it is named, but not that of a lambda's argument."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0).cast("long"), lambda s, x: s + x)


def _sums_before(numbers: Column) -> Column:
    """The sums of all numbers before each of an array: sums of runs, and within a run, so that long arrays cost no square."""

    def by_runs(n: Column, run: Column) -> Column:
        at = lambda k: F.floor(k / run).cast("int")
        runs = F.transform(F.sequence(F.lit(0), at(F.greatest(F.size(n), F.lit(1)) - 1)), lambda k: _total(F.slice(n, k * run + 1, run)))
        before = lambda r: F.transform(r, lambda _, k: _total(F.slice(r, F.lit(1), k)))
        return _let(runs, lambda r: _let(before(r), lambda b: F.transform(n, lambda _, k: F.get(b, at(k)) + _total(F.slice(n, at(k) * run + 1, k % run)))))

    return _let(numbers, lambda n: _let(F.greatest(F.ceil(F.sqrt(F.size(n))), F.lit(1)).cast("int"), lambda run: by_runs(n, run)))


def format_conversations(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """conv_id, formatted, mask: the formatted text, and the code points of it that count for the loss: (block, start, end), ends exclusive, of each text of the loss role, as it stands there, in order."""
    rows = turns.select(
        "conv_id",
        F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"),
    )
    talks = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    none = F.array().cast("array<struct<block:int,start:bigint,end:bigint>>")

    def merged(t: Column, begins: Column) -> Column:
        # Adjacent turns of one role become one block: an array of their texts.
        texts = lambda first, k: F.transform(F.slice(t, first + 1, F.coalesce(F.get(begins, k + 1), F.size(t)) - first), lambda x: escape(x["text"]))
        role = lambda first: F.get(t, first)["role"]
        return F.transform(begins, lambda first, k: F.struct(escape(role(first)).alias("role"), (role(first) == loss_role).alias("loss"), texts(first, k).alias("texts")))

    def spans(block: Column, k: Column, at: Column) -> Column:
        # Where the texts of a block stand in it, one after the other.
        start = F.get(at, k) + len(HEAD) + F.length(block["role"]) + len(COLON)
        sizes = F.transform(block["texts"], lambda x: F.length(x).cast("long"))
        each = _let(sizes, lambda n: F.zip_with(n, _sums_before(F.transform(n, lambda x: x + len(JOIN))), lambda x, b: F.struct(k.cast("int").alias("block"), (start + b).alias("start"), (start + b + x).alias("end"))))
        return F.when(block["loss"], each).otherwise(none)

    def written(blocks: Column) -> Column:
        parts = F.transform(blocks, lambda b: F.concat(F.lit(HEAD), b["role"], F.lit(COLON), F.array_join(b["texts"], JOIN), F.lit(CLOSE + "\n")))
        whole = lambda p, at: F.struct(F.array_join(p, "").alias("formatted"), F.flatten(F.transform(blocks, lambda b, k: spans(b, k, at))).alias("mask"))
        return _let(parts, lambda p: _let(_sums_before(F.transform(p, lambda x: F.length(x).cast("long"))), lambda at: whole(p, at)))

    def told(t: Column) -> Column:
        begins = F.filter(F.sequence(F.lit(0), F.size(t) - 1), lambda i: (i == 0) | (F.get(t, i - 1)["role"] != F.get(t, i)["role"]))
        return _let(begins, lambda b: _let(merged(t, b), written))

    return talks.select("conv_id", F.explode(F.array(_let(F.col("turns"), told))).alias("r")).select("conv_id", "r.formatted", "r.mask")


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (array of role and text, as they were), loss_text (what stands under the mask in formatted, unescaped), formatted_chars; all of it cut out of the formatted text."""

    def parsed(block: Column) -> Column:
        head = F.substring_index(block, COLON, 1)
        role = unescape(F.substr(head, F.lit(len(HEAD) + 1)))
        body = F.substr(block, F.length(head) + len(COLON) + 1)
        return _let(role, lambda r: F.transform(F.split(body, "<[+]>"), lambda text: F.struct(r.alias("role"), unescape(text).alias("text"))))

    def cut(blocks: Column, at: Column) -> Column:
        # A span is cut from its own block, which is short; its place there is its place in the text less the block's.
        loss = F.transform("mask", lambda m: unescape(F.substr(F.get(blocks, m["block"]), (m["start"] - F.get(at, m["block"]) + 1).cast("int"), (m["end"] - m["start"]).cast("int"))))
        return F.struct(F.flatten(F.transform(blocks, parsed)).alias("turns"), F.array_join(loss, "").alias("loss_text"))

    pieces = _let(F.split("formatted", CLOSE + "\n"), lambda b: F.slice(b, 1, F.size(b) - 1))
    back = _let(pieces, lambda b: _let(_sums_before(F.transform(b, lambda x: F.length(x).cast("long") + len(CLOSE) + 1)), lambda at: cut(b, at)))
    rows = formatted.select("conv_id", F.length("formatted").cast("long").alias("formatted_chars"), F.explode(F.array(back)).alias("r"))
    return rows.select("conv_id", "r.turns", "r.loss_text", "formatted_chars")
