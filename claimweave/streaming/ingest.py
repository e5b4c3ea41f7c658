"""Incremental ingest as a stream: new files in, rows of unseen keys appended once.

An extension: the batch engine's skip-what-exists rule, kept by a file source, a checkpoint and an
anti-join in every micro-batch.  Replayed batches add nothing twice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.relational import pending
from ..storage import exists


def append_new(batch: DataFrame, target: str, keys: Sequence[str], within: str | None = None) -> None:
    """Appends the rows of unseen keys.  Only the key columns of the target are read, and with ``within``, one of the
    keys, only its folders that the batch falls into: the target is laid out by it.  A key with a null equals no other and is always new."""
    spark = batch.sparkSession
    fresh = batch.dropDuplicates(list(keys))
    if exists(spark, target + "/_SUCCESS"):
        done = spark.read.parquet(target)
        if within is not None:
            here = [r[0] for r in fresh.select(within).distinct().collect()]  # folders of one micro-batch
            done = done.where(F.col(within).isin(here))
        fresh = pending(fresh, done, keys)
    out = fresh.write.mode("append")
    (out.partitionBy(within) if within else out).parquet(target)


def ingest(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, keys: Sequence[str], within: str | None = None) -> StreamingQuery:
    """Runs through all files there are, then stops; run again, it takes the new ones."""
    stream = spark.readStream.schema(schema).json(source)
    return stream.writeStream.foreachBatch(lambda batch, _: append_new(batch, target, keys, within)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events by type and window of event time; rows later than the watermark are dropped (streams only)."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    return timed.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")
