"""Arithmetic on clips, frames, scores and segments, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def compose_clip(video: Column, start_s: Column, end_s: Column | None = None) -> Column:
    """The bounds of a clip of a clip: both relative to the current view, inside it and in order."""
    low = F.coalesce(video["from_s"], F.lit(0.0))
    new_low = low + start_s
    new_high = video["to_s"] if end_s is None else low + end_s
    bad = (start_s < 0) | F.coalesce(new_high < new_low, F.lit(False)) | F.coalesce(new_high > video["to_s"], F.lit(False))
    checked = F.when(bad, F.raise_error(F.lit("clip bounds lie outside the view")).cast("double")).otherwise(new_low)
    return F.struct(video["uri"].alias("uri"), checked.alias("from_s"), new_high.alias("to_s"))


def clip_frames(from_s: Column, to_s: Column, fps: Column) -> Column:
    """The half-open range of frame numbers that a clip touches."""
    return F.struct(F.floor(from_s * fps).cast("bigint").alias("low"), F.ceil(to_s * fps).cast("bigint").alias("high"))


def sample_indices(count: Column, most: int) -> Column:
    """At most ``most`` evenly spread frame numbers, distinct and rising; one alone is the last."""
    if most < 1:
        raise ValueError("most is positive")
    if most == 1:
        return F.when(count > 0, F.array((count - 1).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    spread = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.bround(i * (count - 1) / F.lit(most - 1)).cast("bigint"))
    return F.when(count > 0, F.array_sort(F.array_distinct(spread))).otherwise(F.array().cast("array<bigint>"))


def sample_times(duration: Column, n: int) -> Column:
    """``n`` evenly spread times from 0 to the duration, to six places."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.round(i * duration / F.lit(max(n - 1, 1)), 6))


def reward_progress(logits: Column) -> Column:
    """The expected progress in [0, 1] of ten progress logits, by their softmax."""
    ten = F.slice(logits, 1, 10)
    top = F.array_max(ten)
    weights = F.transform(ten, lambda x: F.exp(x - top))
    total = F.aggregate(weights, F.lit(0.0), lambda s, x: s + x)
    return F.aggregate(F.transform(weights, lambda x, i: x * i / 9.0), F.lit(0.0), lambda s, x: s + x) / total


def reward_success(logits: Column) -> Column:
    """The probability of success, of the logit after the ten."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-F.get(logits, F.lit(10))))


def checked_logits(logits: Column) -> Column:
    return F.when(F.size(logits) < 13, F.raise_error(F.lit("13 logits at least")).cast("array<double>")).otherwise(logits)


def normalize_segments(segments: Column) -> Column:
    """Segments with start below end, from 0 on, to three places, in order; missing labels are numbered.

    ``segments`` is an array of (start, end, label).
    """
    kept = F.filter(F.transform(segments, lambda s: F.struct(F.round(F.greatest(s["start"].cast("double"), F.lit(0.0)), 3).alias("start"), F.round(F.greatest(s["end"].cast("double"), F.lit(0.0)), 3).alias("end"), s["label"].alias("label"))), lambda s: s["end"] > s["start"])
    ordered = F.array_sort(kept, lambda a, b: F.when((a["start"] < b["start"]) | ((a["start"] == b["start"]) & (a["end"] < b["end"])), -1).when((a["start"] == b["start"]) & (a["end"] == b["end"]), 0).otherwise(1))
    return F.transform(ordered, lambda s, i: F.struct(s["start"], s["end"], F.when(F.coalesce(F.trim(s["label"]), F.lit("")) == "", F.concat(F.lit("segment "), (i + 1).cast("string"))).otherwise(F.trim(s["label"])).alias("label")))


def normalize_label(label: Column) -> Column:
    """Lower case, white space collapsed."""
    return F.trim(F.regexp_replace(F.lower(label), r"\s+", " "))


def overlaps(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """``df`` with ``overlaps``: whether a segment begins before the one before it has ended."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    return df.withColumn("overlaps", F.coalesce(F.col(start) < F.lag(end).over(w), F.lit(False)))


def image_from_message(data: bytes, width: int, height: int, step: int, encoding: str, big_endian: bool = False) -> list:
    """Rows of RGB pixels of a raw camera message: mono, rgb, bgr and with alpha, 8 or 16 bits, padded lines."""
    import numpy as np

    channels = {"mono8": 1, "mono16": 1, "8UC1": 1, "16UC1": 1, "rgb8": 3, "bgr8": 3, "rgb16": 3, "bgr16": 3, "8UC3": 3, "rgba8": 4, "bgra8": 4, "rgba16": 4, "bgra16": 4}
    if encoding not in channels:
        raise ValueError(f"encoding {encoding}")
    wide = "16" in encoding
    n, size = channels[encoding], 2 if wide else 1
    lines = np.frombuffer(data, np.uint8)[: step * height].reshape(height, step)[:, : width * n * size]
    x = np.ascontiguousarray(lines)
    x = (x.view(">u2" if big_endian else "<u2") // 257).astype(np.uint8) if wide else x
    x = x.reshape(height, width, n)
    x = np.repeat(x, 3, axis=2) if n == 1 else x[:, :, :3]
    return (x[:, :, ::-1] if encoding.startswith("bgr") else x).tolist()
