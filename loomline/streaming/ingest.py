"""Delivered lines as a stream: late and repeated deliveries settled by watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def once_per_line(lines: DataFrame, late: str = "30 days") -> DataFrame:
    """Streaming lines with each (source, entry) passed on once, as first delivered, within ``late`` of the newest ``ingested_at``."""
    return lines.withWatermark("ingested_at", late).dropDuplicatesWithinWatermark(["source_id", "entry_id"])


def hourly(lines: DataFrame, late: str = "1 day") -> DataFrame:
    """Lines by hour of delivery and type, closed once the watermark has passed."""
    return lines.withWatermark("ingested_at", late).groupBy(F.window("ingested_at", "1 hour"), "entry_type").agg(F.count("*").alias("lines"))


def to_table(lines: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream to Parquet files, all that is available now."""
    return lines.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
