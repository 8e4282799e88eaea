"""Joins of intervals with intervals, and with points, over hierarchical bins.

Bins come in levels, each FACTOR times as wide as the one before.  An interval's own
level is the narrowest whose bins are at least as long as it is; there and above it
touches two bins at most, be it a base or a whole chromosome.  The wider of two
intervals (by level; of equal ones the left one) stays in the bins of its own level,
and the narrower one looks for it there: in its own level and those above that the
other side has intervals in.  Two intervals that overlap touch a bin in common at
every level, so the join is an equi join on reference, level and bin, in which no
interval makes more than two rows a level; of two bins in common the one with the
overlap's start tells the pair, so pairs are told once.

A bin of a hot place holds the rows that lie there, and a long interval is met by all
rows of its reference.  Spark splits such skewed keys (adaptive execution), or, with
salts, the left side's rows are dealt over as many copies of the right side's.

Ranges are half-open; two overlap if each starts before the other ends.  An empty
range overlaps nothing; a point p is the range [p, p + 1).  Rows whose reference,
start or end is null meet nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The narrowest bins' width, how many times wider each next level's are (both powers of two), and the number of levels.
WIDTH, FACTOR, LEVELS = 1 << 8, 8, 18


def level_of(start: Column, end: Column) -> Column:
    """The narrowest level whose bins are at least as long as the interval."""
    size = F.try_subtract(end, start)  # null beyond 63 bits: of the widest level
    out = F.when(size <= WIDTH, 0)
    for k in range(1, LEVELS - 1):
        out = out.when(size <= WIDTH * FACTOR**k, k)
    return out.otherwise(LEVELS - 1)


def _bin(place: Column, level: Column) -> Column:
    """The whole number of widths below the place: shifts, since widths are powers of two."""
    return F.element_at(F.array(*(F.shiftright(place, (WIDTH * FACTOR**k).bit_length() - 1) for k in range(LEVELS))), level + 1)


def _side(rows: DataFrame, by: str, start: str, end: str | None, name: str) -> DataFrame:
    """All columns as a struct of that name, reference, start, end and own level of the rows that can meet anything."""
    s, e = F.col(start).cast("long"), (F.col(start).cast("long") + 1 if end is None else F.col(end).cast("long"))
    given = rows.select(F.struct("*").alias(name), F.col(by).alias("reference"), s.alias(f"{name}_s"), e.alias(f"{name}_e"))
    return given.where(F.col("reference").isNotNull() & (F.col(f"{name}_s") < F.col(f"{name}_e"))).withColumn(f"{name}_own", level_of(F.col(f"{name}_s"), F.col(f"{name}_e")))


def _levels(side: DataFrame, name: str) -> list[int]:
    return sorted(r[0] for r in side.select(f"{name}_own").distinct().collect())  # LEVELS at most


def _placed(side: DataFrame, name: str, others: list[int], home: int, ties: bool) -> DataFrame:
    """A row for each bin: at home (who = home) in the own level, looking (who = 1 - home) in the levels above (ties: and the own one) that others has."""
    own, s, e = (F.col(f"{name}_{c}") for c in ("own", "s", "e"))
    above = F.filter(F.array(*(F.lit(k) for k in others)).cast("array<int>"), lambda k: (k >= own) if ties else (k > own))
    homes = F.array(F.struct(F.lit(home).alias("who"), own.alias("level")))
    looks = F.transform(above, lambda k: F.struct(F.lit(1 - home).alias("who"), k.alias("level")))
    rows = side.withColumn("at", F.explode(F.concat(homes, looks))).select("*", "at.who", "at.level").drop("at")
    first, last = _bin(s, F.col("level")), _bin(e - 1, F.col("level"))
    return rows.withColumn("bin", F.explode(F.sequence(first, last)))


def overlap_join(left: DataFrame, right: DataFrame, by: str, left_range: tuple[str, str | None], right_range: tuple[str, str | None], salts: int = 1) -> DataFrame:
    """left and right: structs of both sides' columns, for every pair of rows of one ``by`` whose ranges overlap; a range names the columns of start and end, or of a point's place and None."""
    a, b = _side(left, by, *left_range, "left"), _side(right, by, *right_range, "right")
    # The left one is the wider of two of one level: there it is at home, and the right one looks.
    x, y = _placed(a, "left", _levels(b, "right"), 0, False), _placed(b, "right", _levels(a, "left"), 1, True)
    if salts > 1:
        x = x.withColumn("salt", F.pmod(F.xxhash64("left"), F.lit(salts)).cast("int"))
        y = y.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    met = x.join(y, ["reference", "who", "level", "bin", *(["salt"] if salts > 1 else [])])
    start = F.greatest("left_s", "right_s")
    return met.where((start < F.least("left_e", "right_e")) & (F.col("bin") == _bin(start, F.col("level")))).select("left", "right")


def overlap_totals(left: DataFrame, right: DataFrame, by: str, left_range: tuple[str, str | None], right_range: tuple[str, str | None]) -> DataFrame:
    """right: a struct of that side's columns, rows: how many of left overlap it, shared: the places they have in common; for every row of right that something overlaps.

    No pair is made.  What overlaps [s, e) has started before e and not ended at s, so
    it is the starts before e less the ends up to s; the places of left that lie before
    x are a running total as well, and the shared ones its difference between e and s.
    Totals are taken over the distinct places of both sides, inside chunks of WIDTH *
    FACTOR places, which begin with the total of the chunks before: work grows with
    the rows, however many of them an interval meets.

    An empty range of left overlaps what it lies strictly inside of; the rest is as in
    overlap_join.
    """
    place, chunk, long = F.col("place"), WIDTH * FACTOR, lambda c: F.col(c).cast("long")
    s, e = long(left_range[0]), (long(left_range[0]) + 1 if left_range[1] is None else long(left_range[1]))
    ends = F.explode(F.array(F.struct(s.alias("place"), F.lit(1).alias("starts"), F.lit(0).alias("stops")), F.struct(e.alias("place"), F.lit(0).alias("starts"), F.lit(1).alias("stops"))))
    steps = left.where(F.col(by).isNotNull() & (s <= e)).select(F.col(by).alias("reference"), ends.alias("at")).select("reference", "at.*")
    steps = steps.groupBy("reference", "place").agg(F.sum("starts").alias("starts"), F.sum("stops").alias("stops"))
    asked = _side(right, by, *right_range, "right").withColumns({"first": F.col("right_s"), "last": F.col("right_e") - 1}).drop("right_own")
    # Totals up to a place, itself included: up to the last place for starts, up to the start for ends.
    edges = asked.select("reference", F.explode(F.array("first", "last")).alias("place")).distinct().withColumns({"starts": F.lit(0).cast("long"), "stops": F.lit(0).cast("long"), "edge": F.lit(1)})
    both = steps.withColumn("edge", F.lit(0)).unionByName(edges).groupBy("reference", "place").agg(F.sum("starts").alias("starts"), F.sum("stops").alias("stops"), F.max("edge").alias("edge"))
    both = both.withColumns({"chunk": F.shiftright(place, chunk.bit_length() - 1), "weight": (F.col("starts") - F.col("stops")) * place})
    summed = ("starts", "stops", "weight")
    totals = both.groupBy("reference", "chunk").agg(*(F.sum(c).alias(c) for c in summed))
    earlier = Window.partitionBy("reference").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("reference", "chunk", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before") for c in summed))
    inside = Window.partitionBy("reference", "chunk").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    running = both.withColumns({c: F.sum(c).over(inside) for c in summed}).where("edge = 1").join(before, ["reference", "chunk"])
    running = running.select("reference", "place", *((F.col(c) + F.col(f"{c}_before")).alias(c) for c in summed))
    one, two = (running.toDF("reference", edge, *(f"{edge}_{c}" for c in summed)) for edge in ("first", "last"))
    met = asked.join(one, ["reference", "first"]).join(two, ["reference", "last"])

    def covered(edge: str, x: Column) -> Column:  # places of left before x; no row of left starts or ends after the edge and before x
        return x * (F.col(f"{edge}_starts") - F.col(f"{edge}_stops")) - F.col(f"{edge}_weight")

    shared = covered("last", F.col("right_e")) - covered("first", F.col("right_s"))
    return met.select("right", (F.col("last_starts") - F.col("first_stops")).alias("rows"), shared.alias("shared")).where("rows > 0")
