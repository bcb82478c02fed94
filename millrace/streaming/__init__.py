"""The same sessions and counts over streams, with bounded state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_stream(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_per_trigger).load(path)


def windowed_counts(events: DataFrame, ts: str, keys: Sequence[str], size: str, late: str, slide: str | None = None) -> DataFrame:
    """Counts in windows of time; state is dropped once the watermark has passed a window."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, size, slide or size), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n")


def stream_sessions(events: DataFrame, ts: str, keys: Sequence[str], gap: str, late: str) -> DataFrame:
    """Sessions that end after a gap, with their bounds and counts."""
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap), *keys).agg(F.count("*").alias("n"), F.min(ts).alias("first"), F.max(ts).alias("last")).drop("session_window")


def dedup_stream(events: DataFrame, ts: str, keys: Sequence[str], late: str) -> DataFrame:
    """The first event of each key within the watermark."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(list(keys))
