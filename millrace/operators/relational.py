"""Grouping, ordering, joining and de-duplication: thin names over Spark's own operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dedup(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key by ``order``; partial minima are taken before the shuffle, so that hot keys do not gather."""
    rows = F.struct(*(F.col(f"`{c}`") for c in df.columns))
    best = df.groupBy(*keys).agg(F.min_by(rows, F.struct(*order)).alias("__r"))
    return best.select("__r.*")


def group_combine(df: DataFrame, keys: Sequence[str], **aggregates: Column) -> DataFrame:
    return df.groupBy(*keys).agg(*(c.alias(n) for n, c in aggregates.items()))


def cube(df: DataFrame, keys: Sequence[str], **aggregates: Column) -> DataFrame:
    """Groups of all subsets of the keys; a key that a row sums over is null."""
    return df.cube(*keys).agg(*(c.alias(n) for n, c in aggregates.items()))


def rollup(df: DataFrame, keys: Sequence[str], **aggregates: Column) -> DataFrame:
    """Groups of the keys, then of all but the last, up to the whole table."""
    return df.rollup(*keys).agg(*(c.alias(n) for n, c in aggregates.items()))


def distinct(df: DataFrame) -> DataFrame:
    return df.distinct()


def intersect(left: DataFrame, right: DataFrame, every: bool = False) -> DataFrame:
    """Rows of both sides, nulls alike; with ``every`` as often as the side that has fewer."""
    return left.intersectAll(right) if every else left.intersect(right)


def except_(left: DataFrame, right: DataFrame, every: bool = False) -> DataFrame:
    """Rows of the left side that the right has not; with ``every`` one of them for each that it has."""
    return left.exceptAll(right) if every else left.subtract(right)


def global_sort(df: DataFrame, *order: Column | str) -> DataFrame:
    return df.orderBy(*order)


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each key; Spark keeps ``k`` a key before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner", broadcast_bytes: int = 64 << 20) -> DataFrame:
    """An equi-join; the right side is broadcast only where its planned size is known to be small."""
    size = int(str(right._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return left.join(F.broadcast(right) if size <= broadcast_bytes and how in ("inner", "left", "left_semi", "left_anti") else right, list(on), how)


def salted_join(left: DataFrame, right: DataFrame, on: Sequence[str], salts: int = 16) -> DataFrame:
    """An inner join whose hot keys are dealt over ``salts`` tasks: left rows by hash, right rows to each."""
    l = left.withColumn("__salt", F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in left.columns)), F.lit(salts)).cast("int"))  # noqa: E741
    r = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return l.join(r, [*on, "__salt"]).drop("__salt")


def union(first: DataFrame, *more: DataFrame, strict: bool = True) -> DataFrame:
    for df in more:
        first = first.unionByName(df, allowMissingColumns=not strict)
    return first


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))
