"""End of turn on a stream: a session of speech events that a silence ends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def turns(events: DataFrame, key: str, time: str, gap: str = "800 milliseconds", late: str = "10 seconds") -> DataFrame:
    """key, start, end and n of each turn; on a stream rows come out once the watermark has passed the silence.

    Works on streams and on tables; rows without time are left out.
    """
    rows = events.filter(F.col(time).isNotNull()).select(F.col(key), F.col(time).cast("timestamp").alias("__t"))
    rows = rows.withWatermark("__t", late)
    done = rows.groupBy(F.col(key), F.session_window("__t", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return done.select(key, F.col("w.start").alias("turn_start"), F.col("w.end").alias("turn_end"), "n")


def windowed(events: DataFrame, time: str, size: str, by: list[str], late: str = "10 minutes") -> DataFrame:
    """Counts by tumbling windows of event time, with late rows up to the watermark."""
    rows = events.filter(F.col(time).isNotNull()).withColumn("__t", F.col(time).cast("timestamp")).withWatermark("__t", late)
    return rows.groupBy(F.window("__t", size).alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), *by, "n")


def first_seen(events: DataFrame, key: str, time: str, late: str = "10 minutes") -> DataFrame:
    """Rows without the ones delivered again within the watermark."""
    return events.withColumn("__t", F.col(time).cast("timestamp")).withWatermark("__t", late).dropDuplicatesWithinWatermark([key]).drop("__t")


def store(stream: DataFrame, path: str, checkpoint: str):
    """Appends a stream to Parquet exactly once; ends when all that is there was read."""
    return stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
