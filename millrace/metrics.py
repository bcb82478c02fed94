"""Counts and figures of a run: observed beside the rows, or added up by callbacks."""

from __future__ import annotations

import bisect
import math
import time
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark import AccumulatorParam
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def observed(df: DataFrame, **values: Column) -> tuple[DataFrame, Observation]:
    """``df`` whose aggregates are there once an action on it has ended, without a pass of their own."""
    seen = Observation()
    return df.observe(seen, *(c.alias(n) for n, c in (values or {"rows": F.count(F.lit(1))}).items())), seen


class Counters:
    """Named sums that callbacks add to; a retried task may add twice, as with any accumulator."""

    def __init__(self, spark: SparkSession, *names: str):
        self._sums = {n: spark.sparkContext.accumulator(0) for n in names}

    def log_throughput(self, name: str, amount: int = 1) -> None:
        self._sums[name].add(amount)

    def values(self) -> dict[str, int]:
        return {n: a.value for n, a in self._sums.items()}


class _Merged(AccumulatorParam):
    """Adds up dictionaries of (count, sum, least, greatest, last) by key; the last one is that of the greatest time."""

    def zero(self, value: dict) -> dict:
        return {}

    def addInPlace(self, a: dict, b: dict) -> dict:
        for key, (n, total, low, high, last) in b.items():
            held = a.get(key)
            a[key] = (n, total, low, high, last) if held is None else (held[0] + n, held[1] + total, min(held[2], low), max(held[3], high), max(held[4], last))
        return a


class Metrics:
    """Counters, gauges and histograms with labels, logged by callbacks and read on the driver.

    A retried task may log twice, as with any accumulator. A histogram keeps counts by upper
    bounds, so that what the driver holds grows with names and labels, not with values.
    """

    def __init__(self, spark: SparkSession, bounds: Sequence[float] = (0.001, 0.01, 0.1, 1, 10, 100, 1000)):
        if list(bounds) != sorted(set(bounds)):
            raise ValueError("bounds ascend")
        self._seen, self._bounds = spark.sparkContext.accumulator({}, _Merged()), tuple(bounds)

    def _log(self, kind: str, name: str, value: float, labels: dict[str, Any], bound: float | None = None) -> None:
        key = (kind, name, tuple(sorted((k, str(v)) for k, v in labels.items())), bound)
        self._seen.add({key: (1, value, value, value, (time.time(), value))})

    def log_throughput(self, name: str, amount: float = 1, **labels: Any) -> None:
        self._log("counter", name, amount, labels)

    def log_gauge(self, name: str, value: float, **labels: Any) -> None:
        self._log("gauge", name, value, labels)

    def log_gauges(self, values: Mapping[str, float], **labels: Any) -> None:
        for name, value in values.items():
            self.log_gauge(name, value, **labels)

    def log_histogram(self, name: str, value: float, **labels: Any) -> None:
        at = bisect.bisect_left(self._bounds, value)
        self._log("histogram", name, value, labels, self._bounds[at] if at < len(self._bounds) else math.inf)

    def _of(self, kind: str, name: str, labels: dict[str, Any]) -> dict[float | None, tuple]:
        want = tuple(sorted((k, str(v)) for k, v in labels.items()))
        return {key[3]: value for key, value in self._seen.value.items() if key[:3] == (kind, name, want)}

    def counter(self, name: str, **labels: Any) -> float:
        return sum(v[1] for v in self._of("counter", name, labels).values())

    def gauge(self, name: str, **labels: Any) -> float | None:
        """The value that was logged last, by the clocks of the machines."""
        return next((v[4][1] for v in self._of("gauge", name, labels).values()), None)

    def histogram(self, name: str, **labels: Any) -> dict[str, Any]:
        """count, sum, min, max, and the counts by upper bound that are not 0."""
        parts = self._of("histogram", name, labels)
        if not parts:
            return {"count": 0, "sum": 0.0, "min": None, "max": None, "buckets": {}}
        values = list(parts.values())
        return {"count": sum(v[0] for v in values), "sum": sum(v[1] for v in values), "min": min(v[2] for v in values), "max": max(v[3] for v in values), "buckets": {b: parts[b][0] for b in sorted(parts)}}


def shard_counts(df: DataFrame, shard: str = "__shard_id") -> DataFrame:
    return df.groupBy(shard).agg(F.count("*").alias("rows"))


def gpu(count: int = 1, kind: str | None = None) -> dict[str, Any]:
    """Settings that ask Spark for graphics processors for each task."""
    if count < 1:
        raise ValueError("one processor at least")
    return {"spark.task.resource.gpu.amount": str(count), "spark.executor.resource.gpu.amount": str(count), **({"spark.executor.resource.gpu.vendor": kind} if kind else {})}
