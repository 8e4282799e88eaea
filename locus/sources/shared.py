"""Where intermediate tables go: the folder that all executors and the driver share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir.  Only where it is unset and all runs on this machine (tests) it is a folder of our own; a cluster without the setting is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        set_already = spark.sparkContext._jsc.sc().getCheckpointDir()
        if set_already.isDefined():
            folder = set_already.get()
        elif spark.sparkContext.master.split("[")[0] == "local":
            folder = f"file://{tempfile.mkdtemp(prefix='locus-')}"
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def new_folder(spark: SparkSession, within: str | None = None) -> str:
    """The name of a folder that nobody else has."""
    return f"{(within or shared_dir(spark)).rstrip('/')}/locus-{uuid.uuid4().hex}"


def materialised(df: DataFrame, folder: str | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder, or in a scratch() folder: computed once, safe from the loss of executors."""
    path = new_folder(df.sparkSession, folder)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(table: DataFrame, most: int = 100_000) -> DataFrame:
    """table, to be broadcast in joins if it has that many rows at most: Spark takes a table made on the driver for a large one, and would deal the other side out by the few keys of this one."""
    return F.broadcast(table) if table.limit(most + 1).count() <= most else table


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """A folder in the shared one for tables that are of no use afterwards; it is removed at the end, so what is to stay must be written elsewhere by then."""
    folder = f"{shared_dir(spark).rstrip('/')}/locus-scratch-{uuid.uuid4().hex}"
    try:
        yield folder
    finally:
        remove(spark, folder)


def checkpointed(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint (for small tables inside loops)."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _file_system(spark: SparkSession, path: str):
    name = spark._jvm.org.apache.hadoop.fs.Path(path)
    return name.getFileSystem(spark._jsc.hadoopConfiguration()), name


def exists(spark: SparkSession, path: str) -> bool:
    system, name = _file_system(spark, path)
    return system.exists(name)


def remove(spark: SparkSession, path: str) -> None:
    system, name = _file_system(spark, path)
    system.delete(name, True)


def replace(spark: SparkSession, draft: str, target: str) -> None:
    """draft under the name target; what was there goes once the draft is whole."""
    system, name = _file_system(spark, target)
    if system.exists(name):
        system.delete(name, True)
    system.mkdirs(name.getParent())
    if not system.rename(_file_system(spark, draft)[1], name):
        raise OSError(f"{draft} cannot be renamed to {target}")
