"""Session helpers shared by every operator."""

from __future__ import annotations

import os
import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables, a parquet file or directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The same table as a stream of its files, whether it is one file or a folder of many."""
    files = spark.readStream.schema(table(spark, sf_dir, name).schema)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        return files.parquet(f"{sf_dir}/{name}.parquet")
    # A stream reads folders: a single file is picked from the one it lies in.
    return files.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a private one only on a local master, where there is no other machine.

    A cluster that names no folder is an error: a machine's own one would be lost with it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    master = context.master
    if not named and (not master.startswith("local") or master.startswith("local-cluster")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = named or "file://" + os.path.join(tempfile.gettempdir(), f"foliant-{os.getuid()}-checkpoints")
    context.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared checkpoint folder, its lineage cut; survives lost executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once as a table beside the checkpoints: for what is read several times, a few columns at a time."""
    path = f"{checkpoint_dir(df.sparkSession)}/table-{uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slots(spark: SparkSession) -> int:
    """Tasks that run at once, for sizing repartitions of CPU-heavy work."""
    return max(1, spark.sparkContext.defaultParallelism)


#: Bytes that a task of a CPU-heavy step reads.
TASK_BYTES = 6 << 20


def spread(df: DataFrame, by: str | None = None, size: int = 0) -> DataFrame:
    """Partitions for CPU-heavy steps: one for each TASK_BYTES of about ``size`` bytes, and no fewer than the session's and its slots."""
    shuffle = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = max(shuffle, slots(df.sparkSession), -(-size // TASK_BYTES))
    return df.repartition(n, by) if by else df.repartition(n)
