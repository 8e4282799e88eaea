"""Connected components of a table of links, by Spark rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locus.sources.shared import materialised, scratch


def connected(links: DataFrame, folder: str | None = None) -> DataFrame:
    """node, class for every end of a link (columns a and b): the class is the least node of its component; written to the folder, or to the shared one.

    Each round takes the least class among a node's neighbours and then that
    class's own class, so a chain's length is about halved; rounds end when no
    class changes.  All of it is joins and grouped minima of two-column rows.
    Rounds are written tables, which go at the end: what is read again has its own
    size, whereas a checkpoint keeps the estimate of the plan behind it, and those
    multiply from round to round.
    """
    with scratch(links.sparkSession) as own:
        ends = materialised(links.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("next")), F.struct(F.col("b").alias("node"), F.col("a").alias("next")))).alias("e")).select("e.*").distinct(), own)
        classes = materialised(ends.groupBy("node").agg(F.min("next").alias("class")).select("node", F.least("node", "class").alias("class")), own)
        while True:
            heard = ends.join(classes.select(F.col("node").alias("next"), "class"), "next").groupBy("node").agg(F.min("class").alias("heard"))
            lower = classes.join(heard, "node").select("node", F.col("class").alias("before"), F.least("class", "heard").alias("to"))
            jump = classes.select(F.col("node").alias("to"), F.col("class").alias("over"))
            after = materialised(lower.join(jump, "to", "left").select("node", "before", F.least("to", F.coalesce("over", "to")).alias("class")), own)
            if not after.where("before <> class").limit(1).count():
                return materialised(after.select("node", "class"), folder)
            classes = after.select("node", "class")
