"""Patterns of several steps over ordered events, each participant's for itself.

A pattern is a list of steps, each a code that must follow the one before within a gap
of time; a step may be optional, and may repeat; some codes are forbidden between.  A
match begins at every event of the first step's code and then takes, of the events
that mean something at its step (the step's own code if it repeats, the next steps'
codes up to the first that is not optional, a forbidden code), the first one: so each
beginning has one match at most.  A forbidden code, or none within the gap, ends it
there: as a match if no step that must come is missing, else without one.

What is the next event that means something is found for all events at once, for each
step: inside buckets of time, by windows, and for the last ones of a bucket from a
table of one row a bucket; no window holds a participant's whole history.  Matches
then go from event to event by equi joins, one round a step, or a repetition.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from locus.sources.shared import materialised, scratch


@dataclass(frozen=True)
class Step:
    code: str
    optional: bool = False
    repeat: bool = False


def _meant(steps: list[Step], k: int) -> dict[str, int]:
    """What codes mean after step k: the step that they make it, the earliest of several."""
    out = {steps[k].code: k} if steps[k].repeat else {}
    for j in range(k + 1, len(steps)):
        out.setdefault(steps[j].code, j)
        if not steps[j].optional:
            break
    return out


def _nexts(events: DataFrame, codes: dict[int, list[str]], width: int) -> DataFrame:
    """participant, id and, for each k of codes, next_<k>: the first later event (t, id, code) of one of those codes, null if there is none."""
    own = F.struct("t", "id", "code")
    rows = events.select("participant", "id", "t", "code", F.expr(f"floor(t / {width})").alias("bucket"))
    inside = Window.partitionBy("participant", "bucket").orderBy("t", "id").rowsBetween(1, Window.unboundedFollowing)
    later = Window.partitionBy("participant").orderBy("bucket").rowsBetween(1, Window.unboundedFollowing)
    of = {k: F.when(F.col("code").isin(c), own) for k, c in codes.items()}
    firsts = rows.groupBy("participant", "bucket").agg(*(F.min(c).alias(f"first_{k}") for k, c in of.items()))
    carried = firsts.select("participant", "bucket", *(F.first(f"first_{k}", ignorenulls=True).over(later).alias(f"later_{k}") for k in codes))
    near = rows.withColumns({f"near_{k}": F.first(c, ignorenulls=True).over(inside) for k, c in of.items()})
    return near.join(carried, ["participant", "bucket"]).select("participant", "id", *(F.coalesce(f"near_{k}", f"later_{k}").alias(f"next_{k}") for k in codes))


def match(events: DataFrame, steps: list[Step], gap: int, forbidden: tuple[str, ...] = (), width: int = 86400) -> DataFrame:
    """participant, start_id, end_id, start, end (seconds), events (how many it takes) of every match; events: id, participant, code, t, ids told apart."""
    if not steps or steps[0].optional or {s.code for s in steps} & set(forbidden):
        raise ValueError("a pattern begins with a step that must come, and no step is forbidden")
    with scratch(events.sparkSession) as folder:
        return materialised(_matches(events, steps, gap, forbidden, width, folder))


def _matches(events: DataFrame, steps: list[Step], gap: int, forbidden: tuple[str, ...], width: int, folder: str) -> DataFrame:
    given = events.select("participant", "id", "code", "t")
    meant = {k: _meant(steps, k) for k in range(len(steps))}
    wanted = {k: sorted({*m, *forbidden}) for k, m in meant.items() if m}
    nexts = materialised(_nexts(given, wanted, width), folder) if wanted else None
    enough = [k for k in range(len(steps)) if all(s.optional for s in steps[k + 1 :])]
    at = given.where(F.col("code") == steps[0].code).select("participant", F.col("id").alias("start_id"), F.col("t").alias("start"), F.col("id").alias("end_id"), F.col("t").alias("end"), F.lit(0).alias("step"), F.lit(1).cast("long").alias("events"))
    done = []
    while True:
        going = at.where(F.col("step").isin(list(wanted)))
        done.append(at.where(~F.col("step").isin(list(wanted))))
        if nexts is None or not going.limit(1).count():
            return reduce(DataFrame.unionByName, [d.drop("step") for d in done])
        # The next event that means something at the step, if it is near enough and not forbidden.
        taken = reduce(lambda acc, k: acc.when(F.col("step") == k, F.col(f"next_{k}")), list(wanted)[1:], F.when(F.col("step") == list(wanted)[0], F.col(f"next_{list(wanted)[0]}")))
        stepped = going.join(nexts.withColumnRenamed("id", "end_id"), ["participant", "end_id"]).withColumn("next", taken)
        fine = (F.col("next.t") - F.col("end") <= gap) & ~F.col("next.code").isin(list(forbidden))
        pairs = [(k, code, j) for k, m in meant.items() for code, j in m.items()]
        to = reduce(lambda acc, p: acc.when((F.col("step") == p[0]) & (F.col("next.code") == p[1]), p[2]), pairs[1:], F.when((F.col("step") == pairs[0][0]) & (F.col("next.code") == pairs[0][1]), pairs[0][2]))
        columns = ["participant", "start_id", "start", "end_id", "end", "step", "events"]
        stepped = materialised(stepped.withColumn("to", F.when(F.coalesce(fine, F.lit(False)), to)).select(*columns, "next", "to"), folder)
        done.append(stepped.where(F.col("to").isNull() & F.col("step").isin(enough)).select(columns))
        moved = {"end_id": F.col("next.id"), "end": F.col("next.t"), "step": F.col("to"), "events": F.col("events") + 1}
        at = stepped.where(F.col("to").isNotNull()).withColumns(moved).select(columns)
