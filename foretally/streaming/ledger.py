"""Structured Streaming forms of the run ledger and of status counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def _timed(rows: DataFrame) -> DataFrame:
    """A watermark needs a timestamp with a time zone: times without one are taken in the session's."""
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def window_counts(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Events and values by window and type; `events` is a stream or a table."""
    w = F.window("ts", width)
    return _timed(events).withWatermark("ts", late).groupBy(w, "event_type").agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents")).select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n", "cents")


def once_per_run(runs: DataFrame, late: str = "2 days") -> DataFrame:
    """A stream of finished runs without repeated keys."""
    return _timed(runs).withWatermark("ts", late).dropDuplicatesWithinWatermark(["run_key"])


def append_to(runs: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream to the ledger table, a part per batch; a batch that is tried again overwrites its own part."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return runs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
