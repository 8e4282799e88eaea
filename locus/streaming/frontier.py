"""The position frontier as a stream: chunks are told as settled once, late rows apart.

Rows arrive roughly in the order of their position.  A reference's frontier is the
greatest position seen so far; a chunk is settled when the frontier has passed its end
by a margin of chunks.  Spark's watermarks are times, and one for all rows; a frontier
is a position, and each reference has its own.  So this is a processor with state: for
a reference the frontier, and the counts of the chunks that are still open.

Rows are counted by chunk where they are read, so a crowded reference sends one row a
chunk and batch to its state, and the state holds open chunks only: when a chunk
settles it is told and forgotten.  What arrives for a settled chunk afterwards is told
as late, each batch's share for itself; rows are judged by what was settled before
their batch.  Chunks that never settle stay in the state, where open_chunks() reads
them from the checkpoint.

Rows with a null reference or position are told as kind "unplaced" in every batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PARTS = "reference string, chunk_start long, reads long, bases long, top long"
_TOLD = "kind string, reference string, chunk_start long, reads long, bases long"


def counted_where_read(rows: DataFrame, size: int) -> DataFrame:
    """reference, chunk_start, reads, bases, top (greatest position): a row for each chunk of each batch of rows that a task reads."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sums = pa.Table.from_batches([batch]).group_by(["reference", "chunk_start"]).aggregate([("one", "sum"), ("span", "sum"), ("position", "max")])
                yield from sums.select(["reference", "chunk_start", "one_sum", "span_sum", "position_max"]).rename_columns(["reference", "chunk_start", "reads", "bases", "top"]).to_batches()

    chunk = F.expr(f"floor(position / {size}) * {size}").cast("long")
    given = rows.select("reference", chunk.alias("chunk_start"), F.col("position").cast("long").alias("position"), F.col("span").cast("long").alias("span"), F.lit(1).cast("long").alias("one"))
    return given.mapInArrow(counted, _PARTS)


class Frontier(StatefulProcessor):
    """The state of one reference: its frontier, the bound below which chunks are settled, and the open chunks' counts."""

    def __init__(self, size: int, margin: int):
        self.size, self.margin = size, margin

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.place = handle.getValueState("place", "frontier long, settled long")
        self.open = handle.getMapState("open", "chunk_start long", "reads long, bases long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        parts = pd.concat(list(rows))
        told: list[tuple] = []
        placed = parts[parts["chunk_start"].notna()]
        if key[0] is None or len(placed) < len(parts):
            odd = parts if key[0] is None else parts[parts["chunk_start"].isna()]
            told.append(("unplaced", key[0], None, int(odd["reads"].sum()), int(odd["bases"].sum())))
        if key[0] is not None and len(placed):
            told += self._placed(key[0], placed.groupby("chunk_start").agg(reads=("reads", "sum"), bases=("bases", "sum"), top=("top", "max")))
        yield pd.DataFrame(told, columns=["kind", "reference", "chunk_start", "reads", "bases"])

    def _placed(self, reference: str, chunks: pd.DataFrame) -> list[tuple]:
        known = self.place.get() if self.place.exists() else None
        frontier, settled = known if known else (None, None)
        told = []
        for start, reads, bases in zip(map(int, chunks.index), map(int, chunks["reads"]), map(int, chunks["bases"]), strict=True):
            if settled is not None and start + self.size <= settled:
                told.append(("late", reference, start, reads, bases))
            else:
                before = self.open.getValue((start,)) if self.open.containsKey((start,)) else (0, 0)
                self.open.updateValue((start,), (before[0] + reads, before[1] + bases))
        top = int(chunks["top"].max())
        frontier = top if frontier is None else max(frontier, top)
        bound = frontier - self.margin if settled is None else max(settled, frontier - self.margin)
        if settled is None or bound > settled:
            for (start,), (reads, bases) in sorted((tuple(k), tuple(v)) for k, v in self.open.iterator()):
                if start + self.size <= bound:
                    told.append(("settled", reference, start, reads, bases))
                    self.open.removeKey((start,))
        self.place.update((frontier, bound))
        return told

    def close(self) -> None:
        pass


def settling(rows: DataFrame, size: int, chunks_late: int = 2) -> DataFrame:
    """A stream of kind ("settled", "late" or "unplaced"), reference, chunk_start, reads, bases of a stream of reference, position, span.  Its query needs the state store that start() sets."""
    processor = Frontier(size, chunks_late * size)
    return counted_where_read(rows, size).groupBy("reference").transformWithStateInPandas(processor, _TOLD, "Append", "None")


def start(rows: DataFrame, size: int, target: str, checkpoint: str, chunks_late: int = 2) -> StreamingQuery:
    """settling() of what has arrived, as Parquet at target in a folder for each kind; started again on the same checkpoint it goes on, and nothing is told twice."""
    spark = rows.sparkSession
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        told = settling(rows, size, chunks_late)
        return told.writeStream.partitionBy("kind").format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


def told(spark: SparkSession, target: str) -> DataFrame:
    """What start() has written."""
    return spark.read.schema("reference string, chunk_start long, reads long, bases long, kind string").parquet(target)


def open_chunks(spark: SparkSession, checkpoint: str) -> DataFrame:
    """reference, chunk_start, reads, bases of the chunks that have not settled yet."""
    state = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "open").load()
    return state.select(F.col("key.reference").alias("reference"), F.col("user_map_key.chunk_start").alias("chunk_start"), F.col("user_map_value.reads").alias("reads"), F.col("user_map_value.bases").alias("bases"))


def frontiers(spark: SparkSession, checkpoint: str) -> DataFrame:
    """reference, frontier, settled (the bound below which chunks have been told) of every reference."""
    state = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "place").load()
    return state.select(F.col("key.reference").alias("reference"), "value.frontier", "value.settled")
