"""Time-aligned annotations: rows (id, participant, code, t), t in whole seconds; utterances with start and end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def segments(events: DataFrame, width: int) -> DataFrame:
    """segment, code, events."""
    return events.groupBy(F.expr(f"t div {width}").alias("segment"), "code").agg(F.count("*").alias("events"))


def code_index(events: DataFrame, width: int) -> DataFrame:
    """code, segment, events, first_t, last_t: a row for each segment that a code occurs in."""
    return events.groupBy("code", F.expr(f"t div {width}").alias("segment")).agg(F.count("*").alias("events"), F.min("t").alias("first_t"), F.max("t").alias("last_t"))


def speaker_index(turns: DataFrame) -> DataFrame:
    """speaker, utterances, total_chars, conversations."""
    return turns.groupBy(F.col("role").alias("speaker")).agg(F.count("*").alias("utterances"), F.sum(F.length("text")).alias("total_chars"), F.countDistinct("conv_id").alias("conversations"))


def speaker_times(utterances: DataFrame, width: int) -> DataFrame:
    """speaker, segment, utterances, seconds: a row for each segment that a speaker speaks in, and the seconds of it that are theirs; utterances: speaker, start, end, in seconds, ends exclusive."""
    touched = F.sequence(F.expr(f"start div {width}"), F.greatest(F.expr(f"(end - 1) div {width}"), F.expr(f"start div {width}")))
    parts = utterances.select("speaker", "start", "end", F.explode(touched).alias("segment"))
    inside = F.least("end", F.col("segment") * width + width) - F.greatest("start", F.col("segment") * width)
    return parts.groupBy("speaker", "segment").agg(F.count("*").alias("utterances"), F.sum(inside).alias("seconds"))


def clip(events: DataFrame, at: str, start: int, seconds: int) -> DataFrame:
    """Events whose timestamp column lies within seconds of start (seconds since the epoch): literal bounds in the column's own type, which reach the scan."""
    kind = events.schema[at].dataType
    bound = [F.timestamp_seconds(F.lit(s)).cast(kind) for s in (start, start + seconds)]
    return events.where((F.col(at) >= bound[0]) & (F.col(at) < bound[1]))


def of_tier(events: DataFrame, tier: str, code: str) -> DataFrame:
    """Annotations of one tier and code; events have tier and code."""
    return events.where((F.col("tier") == tier) & (F.col("code") == code))


def followed_by(events: DataFrame, first: str, second: str, gap: int) -> DataFrame:
    """Pairs (first_id, second_id): the second code within gap seconds after the first, same participant.

    Time is cut into gap-wide bins and each first event looks into its own and
    the next one, so the join is an equi join on (participant, bin).
    """
    a = events.where(F.col("code") == first).select("participant", F.col("id").alias("first_id"), F.col("t").alias("t1"), F.explode(F.array(F.expr(f"t div {gap}"), F.expr(f"t div {gap} + 1"))).alias("bin"))
    b = events.where(F.col("code") == second).select("participant", F.col("id").alias("second_id"), F.col("t").alias("t2"), F.expr(f"t div {gap}").alias("bin"))
    return a.join(b, ["participant", "bin"]).where(f"t2 > t1 and t2 - t1 <= {gap}").select("first_id", "second_id", "participant")


def clips(events: DataFrame, code: str, context: int) -> DataFrame:
    """id, clip_start, clip_end, events: each event of the code with what the participant did within context seconds of it."""
    centre = events.where(F.col("code") == code).select("participant", "id", F.col("t").alias("centre"), F.explode(F.sequence(F.expr(f"(t - {context}) div {context}"), F.expr(f"(t + {context}) div {context}"))).alias("bin"))
    near = events.select("participant", "t", F.expr(f"t div {context}").alias("bin"))
    inside = centre.join(near, ["participant", "bin"]).where(f"t between centre - {context} and centre + {context}")
    return inside.groupBy("id", "centre").agg(F.count("*").alias("events")).select("id", (F.col("centre") - context).alias("clip_start"), (F.col("centre") + context).alias("clip_end"), "events")


def _edges(rows: DataFrame, by: str, edge: Column, towards: int) -> DataFrame:
    """by, bucket, edge of the bucket before (towards -1) or after (1): one row a bucket, so that no window holds all rows of a busy ``by``."""
    buckets = rows.groupBy(by, "bucket").agg(edge.alias("edge"))
    return buckets.select(by, "bucket", F.lag("edge", -towards).over(Window.partitionBy(by).orderBy("bucket")).alias("edge"))


def gaps(events: DataFrame, width: int = 86400) -> DataFrame:
    """id, gap: seconds since the participant's event before (null for the first); looked for inside buckets of width seconds, the first of a bucket looks at the bucket before."""
    rows = events.select("id", "participant", "t", F.expr(f"t div {width}").alias("bucket"))
    inside = rows.withColumn("before", F.lag("t").over(Window.partitionBy("participant", "bucket").orderBy("t", "id")))
    edges = _edges(rows, "participant", F.max("t"), -1)
    return inside.join(edges, ["participant", "bucket"]).select("id", (F.col("t") - F.coalesce("before", "edge")).alias("gap"))


def turn_taking(utterances: DataFrame) -> DataFrame:
    """conversation, start, speaker, pause: seconds from the end of the turn before (by start) to this turn's start, negative where they overlap, null for the first; utterances: conversation, speaker, start, end."""
    order = Window.partitionBy("conversation").orderBy("start", "end", "speaker")
    return utterances.select("conversation", "start", "speaker", (F.col("start") - F.lag("end").over(order)).alias("pause"))


def adjacent(events: DataFrame, first: str, second: str, width: int = 86400) -> DataFrame:
    """pairs of directly successive events of one participant with those codes, counted, and the seconds between them; buckets as in gaps()."""
    rows = events.select("id", "participant", "t", "code", F.expr(f"t div {width}").alias("bucket"))
    own = F.struct("t", "id", "code")
    inside = rows.withColumn("next", F.lead(own).over(Window.partitionBy("participant", "bucket").orderBy("t", "id")))
    pairs = inside.join(_edges(rows, "participant", F.min(own), 1), ["participant", "bucket"]).withColumn("next", F.coalesce("next", "edge"))
    pairs = pairs.where((F.col("code") == first) & (F.col("next.code") == second))
    return pairs.agg(F.count("*").alias("pairs"), F.coalesce(F.sum(F.col("next.t") - F.col("t")), F.lit(0)).alias("seconds"))


def sessions(events: DataFrame, gap: int) -> DataFrame:
    """participant, session_start, events: sessions end where a participant pauses for gap seconds or more; an event without a time is a session by itself."""
    stamped = events.withColumn("at", F.timestamp_seconds("t"))
    # Spark's window still takes in an event at its very end: half a second less, as times are whole seconds.
    grouped = stamped.groupBy("participant", F.session_window("at", f"{gap * 1000 - 500} milliseconds").alias("w")).agg(F.count("*").alias("events"))
    timed = grouped.select("participant", F.unix_timestamp("w.start").alias("session_start"), "events")
    return timed.unionByName(events.where("t is null").select("participant", F.lit(None).cast("long").alias("session_start"), F.lit(1).cast("long").alias("events")))


def agreement(ratings: DataFrame, one: str, other: str) -> DataFrame:
    """n, agree, kappa of two columns of categories."""
    table = ratings.groupBy(one, other).agg(F.count("*").alias("n"))
    n = table.agg(F.sum("n").alias("n"), F.sum(F.when(F.col(one) == F.col(other), F.col("n")).otherwise(0)).alias("agree"))
    rows = table.groupBy(F.col(one).alias("c")).agg(F.sum("n").alias("r"))
    columns = table.groupBy(F.col(other).alias("c")).agg(F.sum("n").alias("s"))
    by_chance = rows.join(columns, "c").agg(F.coalesce(F.sum(F.col("r") * F.col("s")), F.lit(0)).alias("m"))
    pe = F.col("m") / (F.col("n") * F.col("n"))
    return n.join(by_chance).select("n", "agree", F.try_divide(F.col("agree") / F.col("n") - pe, 1 - pe).alias("kappa"))


def as_of(left: DataFrame, right: DataFrame, by: str, at: str, value: str, width: int = 86400) -> DataFrame:
    """left with the value of the latest row of right (same ``by``) at or before it.

    Both are merged in time order and the value is carried forward inside buckets of
    width units of time; what a bucket begins with comes from a table of one row a bucket.
    """
    both = left.withColumn("_v", F.lit(None).cast(right.schema[value].dataType)).withColumn("_side", F.lit(1)).unionByName(
        right.select(by, at, F.col(value).alias("_v")).withColumn("_side", F.lit(0)), allowMissingColumns=True
    )
    both = both.withColumn("bucket", F.floor(F.col(at) / width))
    order = Window.partitionBy(by, "bucket").orderBy(at, "_side", F.col("_v").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    last = both.groupBy(by, "bucket").agg(F.max(F.when(F.col("_v").isNotNull(), F.struct(at, F.col("_v").alias("v")))).alias("last"))
    before = Window.partitionBy(by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select(by, "bucket", F.last("last", ignorenulls=True).over(before)["v"].alias("_carried"))
    out = both.withColumn(value, F.last("_v", ignorenulls=True).over(order)).where("_side = 1").join(carried, [by, "bucket"])
    return out.withColumn(value, F.coalesce(value, "_carried")).select(*left.columns, value)


