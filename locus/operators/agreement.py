"""Agreement of any number of raters, with ratings missing: Krippendorff's alpha.

A unit with n ratings, two at least, adds to the coincidences of each two categories
the pairs of its ratings that are these, weighted 1 / (n - 1).  Alpha is one less the
disagreement observed over that expected from the categories' totals.  All is grouped
sums: by unit and category, then by pair of categories; a unit's categories meet each
other by an equi join on the unit, never its raters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _distance(level: str, a: str, b: str) -> Column:
    if level == "nominal":
        return (F.col(a) != F.col(b)).cast("double")
    if level == "interval":
        return F.pow(F.col(a).cast("double") - F.col(b).cast("double"), 2)
    if level == "ratio":
        return F.coalesce(F.pow(F.try_divide(F.col(a).cast("double") - F.col(b).cast("double"), F.col(a).cast("double") + F.col(b).cast("double")), 2), F.lit(0.0))
    raise ValueError(f"no such level: {level}")


def coincidences(ratings: DataFrame, unit: str = "unit", value: str = "value") -> DataFrame:
    """a, b, weight: the coincidences of categories; null values are missing ratings."""
    counts = ratings.where(F.col(value).isNotNull() & F.col(unit).isNotNull()).groupBy(F.col(unit).alias("u"), F.col(value).alias("c")).agg(F.count("*").alias("n"))
    units = counts.groupBy("u").agg(F.sum("n").alias("m")).where("m > 1")
    own = counts.join(units, "u")
    pairs = own.select("u", "m", F.col("c").alias("a"), F.col("n").alias("na")).join(own.select("u", F.col("c").alias("b"), F.col("n").alias("nb")), "u")
    each = F.when(F.col("a") == F.col("b"), F.col("na") * (F.col("na") - 1)).otherwise(F.col("na") * F.col("nb")) / (F.col("m") - 1)
    return pairs.groupBy("a", "b").agg(F.sum(each).alias("weight"))


def alpha(ratings: DataFrame, unit: str = "unit", value: str = "value", level: str = "nominal") -> DataFrame:
    """pairable (ratings that count), observed, expected (disagreements), alpha (null where nothing can disagree); level: nominal, interval or ratio."""
    found = coincidences(ratings, unit, value)
    totals = found.groupBy("a").agg(F.sum("weight").alias("n"))
    total = totals.agg(F.coalesce(F.sum("n"), F.lit(0.0)).alias("pairable"))
    observed = found.agg(F.coalesce(F.sum(F.col("weight") * _distance(level, "a", "b")), F.lit(0.0)).alias("o"))
    # Categories meet each other: there are as many as a rating scale has.
    other = totals.select(F.col("a").alias("b"), F.col("n").alias("nb"), F.lit(1).alias("all"))
    chance = totals.withColumn("all", F.lit(1)).join(other, "all").agg(F.coalesce(F.sum(F.col("n") * F.col("nb") * _distance(level, "a", "b")), F.lit(0.0)).alias("e"))
    one = total.withColumn("all", F.lit(1)).join(observed.withColumn("all", F.lit(1)), "all").join(chance.withColumn("all", F.lit(1)), "all")
    out = one.select("pairable", F.try_divide("o", "pairable").alias("observed"), F.try_divide(F.col("e"), F.col("pairable") * (F.col("pairable") - 1)).alias("expected"))
    return out.withColumn("alpha", 1 - F.try_divide("observed", "expected"))
