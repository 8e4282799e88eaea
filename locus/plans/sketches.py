"""Mergeable sketches beside a manifest: statistics that need no data and add up over batches.

A batch leaves one row for each group: counts, and for every column asked for a
distinct-count sketch (HyperLogLog) or a quantile sketch (KLL), a few kilobytes each.
Batches merge by Spark's own union aggregates, so a number for the whole dataset, or
for any grouping of the groups, reads these rows only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Sizes of the sketches: 2**LOG_K registers (about 0.4 % off), KLL's k (ranks about 0.3 % off).
LOG_K, KLL = 16, 1000


def build(rows: DataFrame, by: list[str], distinct: list[str], quantiles: list[str]) -> DataFrame:
    """by, rows, distinct_<column> and quantiles_<column>: one row a group, sketches built in the tasks and merged."""
    texts = [F.hll_sketch_agg(F.col(c).cast("string"), LOG_K).alias(f"distinct_{c}") for c in distinct]
    numbers = [F.kll_sketch_agg_bigint(F.col(c).cast("long"), KLL).alias(f"quantiles_{c}") for c in quantiles]
    return rows.groupBy(*by).agg(F.count("*").alias("rows"), *texts, *numbers)


def merge(sketches: DataFrame, by: list[str]) -> DataFrame:
    """The sketches of several batches, or of finer groups, as one row for each group of by (none: one row)."""
    columns = [F.sum("rows").cast("long").alias("rows")]
    columns += [F.hll_union_agg(c, True).alias(c) for c in sketches.columns if c.startswith("distinct_")]
    columns += [F.kll_merge_agg_bigint(c).alias(c) for c in sketches.columns if c.startswith("quantiles_")]
    return sketches.groupBy(*by).agg(*columns)


def read_off(sketches: DataFrame, ranks: dict[str, list[float]]) -> DataFrame:
    """The groups with rows, the estimate of each distinct count, and for each quantile sketch the values at its ranks (<column>_p<percent>)."""
    kept = [c for c in sketches.columns if not c.startswith(("distinct_", "quantiles_"))]
    counts = [F.hll_sketch_estimate(c).alias(c.removeprefix("distinct_") + "_distinct") for c in sketches.columns if c.startswith("distinct_")]
    values = [F.kll_sketch_get_quantile_bigint(f"quantiles_{c}", F.lit(r)).alias(f"{c}_p{round(r * 100)}") for c, rs in ranks.items() for r in rs]
    return sketches.select(*kept, *counts, *values)


def rolled_up(rows: DataFrame, sets: list[list[str]], distinct: list[str]) -> DataFrame:
    """Grouping sets: the given columns (null where a set leaves one out), grouped (a bit for each column left out), rows and exact distinct counts."""
    every = list(dict.fromkeys(c for s in sets for c in s))
    out = rows.groupingSets([[F.col(c) for c in s] for s in sets], *every)
    return out.agg(F.grouping_id().alias("grouped"), F.count("*").alias("rows"), *(F.count_distinct(c).alias(f"{c}_distinct") for c in distinct))
