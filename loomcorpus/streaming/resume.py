"""Incremental runs: what arrived since the last run is processed, and nothing twice."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def process_new(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, step: Callable[[DataFrame], DataFrame], files_per_batch: int | None = None, on_batch: Callable[[int, int], None] | None = None) -> int:
    """Runs ``step`` over files of ``source`` not seen before and appends to ``target``.

    The checkpoint remembers files, so a second call without new ones does nothing and a call
    after a failure goes on where that one stopped. A batch is one folder of ``target`` that is
    overwritten if it is tried again. Returns the rows written; ``on_batch(id, rows)`` hears of
    each batch.
    """
    written = 0

    def commit(batch: DataFrame, ident: int) -> None:
        nonlocal written
        path = f"{target}/batch={ident}"
        step(batch).write.mode("overwrite").parquet(path)
        rows = spark.read.parquet(path).count()
        written += rows
        if on_batch:
            on_batch(ident, rows)

    stream = spark.readStream.schema(schema)
    if files_per_batch:
        stream = stream.option("maxFilesPerTrigger", files_per_batch)
    query = stream.parquet(source).writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return written


def latest_by_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """The newest row of every key, for reading a target with several versions of an item."""
    return df.groupBy(key).agg(F.max_by(F.struct(*[c for c in df.columns if c != key]), order).alias("v")).select(key, "v.*")


def windowed_counts(stream: DataFrame, time: str, group: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Tumbling-window counts of a stream; events later than the watermark are left out."""
    counts = stream.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), group).agg(F.count("*").alias("events"))
    return counts.select(F.col("w.start").alias("start"), group, "events")
