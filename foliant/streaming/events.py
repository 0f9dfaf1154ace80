"""Event and ingest streams: routing, rotation windows, fenced and idempotent sinks."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from foliant.session import checkpoint_dir


def is_client(event: Column | str = "event_type", prefix: str = "client.") -> Column:
    c = F.col(event) if isinstance(event, str) else event
    return F.coalesce(c.startswith(prefix), F.lit(False))


def routed(events: DataFrame, event: str = "event_type") -> tuple[DataFrame, DataFrame]:
    """(application events, client events), for two sinks; works on batches and streams."""
    return events.filter(~is_client(event)), events.filter(is_client(event))


def rotation_windows(events: DataFrame, ts: str = "ts", width: str = "4 hours", late: str | None = None) -> DataFrame:
    """(window_start, events, value): tumbling windows as long as a log file; ``late`` is the watermark of a stream."""
    if late:
        # A watermark needs an instant; local timestamps are taken in the session's zone.
        events = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return events.groupBy(F.window(ts, width).alias("w")).agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("value")).select(F.col("w.start").alias("window_start"), "events", "value")


def cut_values(m: Column | str, most: int = 500) -> Column:
    """Map values cut to ``most`` characters."""
    return F.transform_values(m, lambda _, v: v.substr(1, most))


def fenced(results: DataFrame, versions: DataFrame, key: str = "notebook_id") -> DataFrame:
    """Results whose conversation hasn't been cleared since they began (equal version; a missing one is 0)."""
    now = versions.select(key, F.col("version").alias("_now"))
    return results.join(now, key, "left").filter(F.coalesce("version", F.lit(0)) == F.coalesce("_now", F.lit(0))).drop("_now")


def file_stream(spark: SparkSession, folder: str, pattern: str = "*", max_files: int = 1000) -> DataFrame:
    """New files of a landing folder as (path, modificationTime, length, content)."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    return spark.readStream.schema(schema).format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", max_files).load(folder)


def index_stream(files: DataFrame, index_batch: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Runs ``index_batch(rows, batch id)`` on each micro-batch; the checkpoint replays a lost one under the same id."""
    writer = files.writeStream.foreachBatch(index_batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def finished(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """What an aggregating stream holds once it has read all that is there now, from a table beside the checkpoints.

    Each batch replaces the table's state (``complete``) or is a part of its own under its number, so a repeated batch replaces itself.
    """
    spark = stream.sparkSession
    place = f"{checkpoint_dir(spark)}/stream-{uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{place}/rows/batch={0 if mode == 'complete' else number}")

    writer = stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{place}/checkpoint")
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{place}/rows")
