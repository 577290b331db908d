"""Windows over event time, on streams and, with the same code, on tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.storage import shared_path


def tumbling(events: DataFrame, width: str = "1 day", late: str = "1 hour", slide: str | None = None) -> DataFrame:
    """window_start, event_type, n, total; on a stream, events later than `late` are dropped."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", width, slide or width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 hour", key: str = "user_id") -> DataFrame:
    """key, session_start, session_end, n: events no further apart than the gap."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.session_window("ts", gap), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n")


def drained(stream: DataFrame, what: str) -> DataFrame:
    """Runs a stream over all that is there and returns the complete result as a table."""
    spark = stream.sparkSession
    out = shared_path(spark, what)

    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    query = stream.writeStream.outputMode("complete").option("checkpointLocation", shared_path(spark, f"{what}-state")).foreachBatch(keep).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
