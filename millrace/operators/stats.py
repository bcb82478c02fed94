"""Mergeable feature statistics of vector columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUANTILES = (0.01, 0.10, 0.50, 0.90, 0.99)
BINS = 5000
#: Columns that number frames and get no statistics.
SKIPPED = ("index", "episode_index", "task_index", "frame_index", "timestamp")


def _long(df: DataFrame, keys: Sequence[str], vector: str) -> DataFrame:
    """(keys, dim, x) of all elements; a column of numbers is a vector of one."""
    kind = df.schema[vector].dataType
    v = F.col(f"`{vector}`") if isinstance(kind, T.ArrayType) else F.array(F.col(f"`{vector}`"))
    return df.select(*keys, F.posexplode(v).alias("dim", "x")).select(*keys, F.col("dim").cast("bigint").alias("dim"), F.col("x").cast("double").alias("x"))


def feature_stats(df: DataFrame, keys: Sequence[str], vector: str) -> DataFrame:
    """min, max, mean, population std and count of each element of a vector column."""
    return _long(df, keys, vector).groupBy(*keys, "dim").agg(F.min("x").alias("min"), F.max("x").alias("max"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.count("x").alias("count"))


def feature_quantiles(df: DataFrame, keys: Sequence[str], vector: str, quantiles: Sequence[float] = QUANTILES, bins: int = BINS) -> DataFrame:
    """Quantiles of each element by a histogram of ``bins`` bins, as ``q01`` and so on.

    Two passes: the range, widened by 1e-10 on either side, then counts of bins, of which there are
    at most ``bins`` a key, whatever the number of rows. A quantile is where the running count
    reaches its share, linear inside the bin; in the first bin it is the lower edge. With fewer
    than two rows all are the mean.
    """
    long = _long(df, keys, vector)
    k = [*keys, "dim"]
    span = long.groupBy(*k).agg((F.min("x") - 1e-10).alias("lo"), (F.max("x") + 1e-10).alias("hi"), F.count("x").alias("n"), F.avg("x").alias("mean"))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.least(F.floor((F.col("x") - F.col("lo")) / width), F.lit(bins - 1))
    counts = long.join(span, k).groupBy(*k, "lo", "hi", "n", "mean", at.alias("b")).agg(F.count("*").alias("c"))
    w = Window.partitionBy(*k).orderBy("b")
    running = counts.withColumn("cum", F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    width = (F.col("hi") - F.col("lo")) / bins
    outs = []
    for q in quantiles:
        need = F.lit(q) * F.col("n")
        before = F.col("cum") - F.col("c")
        value = F.when(F.col("b") == 0, F.col("lo")).otherwise(F.col("lo") + width * F.col("b") + (need - before) / F.col("c") * width)
        hit = F.when(F.col("cum") >= need, F.struct("b", value.alias("v")))
        outs.append(F.when(F.max("n") < 2, F.max("mean")).otherwise(F.min(hit)["v"]).alias(f"q{round(q * 100):02d}"))
    return running.groupBy(*k).agg(*outs)


def merge_stats(df: DataFrame, keys: Sequence[str], quantiles: Sequence[str] = ()) -> DataFrame:
    """Statistics of parts (``min max mean std count`` and quantile columns) as those of the whole.

    Means and variances are pooled by count, quantiles are count-weighted averages and null where
    a part lacks them.
    """
    total = F.greatest(F.sum("count").cast("double"), F.lit(1e-12))
    mean = F.sum(F.col("mean") * F.col("count")) / total
    # sum of n * (std^2 + mean^2) less the mean's share is the pooled variance
    square = F.sum((F.col("std") * F.col("std") + F.col("mean") * F.col("mean")) * F.col("count")) / total
    extra = [F.when(F.count(q) == F.count(F.lit(1)), F.sum(F.col(q) * F.col("count")) / total).alias(q) for q in quantiles]
    return df.groupBy(*keys).agg(F.min("min").alias("min"), F.max("max").alias("max"), mean.alias("mean"), F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))).alias("std"), F.sum("count").cast("bigint").alias("count"), *extra)


def stat_columns(schema: T.StructType) -> list[str]:
    """Numeric columns and vectors of numbers, without those that number frames."""
    def numeric(t: T.DataType) -> bool:
        return isinstance(t, T.NumericType) or isinstance(t, T.ArrayType) and isinstance(t.elementType, T.NumericType)

    return [f.name for f in schema if f.name not in SKIPPED and numeric(f.dataType)]


def regular(df: DataFrame, vector: str) -> Column:
    """Whether all of a group's vectors are there, finite and of one length."""
    v = F.col(f"`{vector}`").cast("array<double>")
    odd = v.isNull() | F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (F.max(F.coalesce(odd, F.lit(True)).cast("int")) == 0) & (F.min(F.size(v)) == F.max(F.size(v)))


def ranges(df: DataFrame, keys: Sequence[str], low: str, high: str) -> DataFrame:
    """The range that each key's rows need."""
    return df.groupBy(*keys).agg(F.min(low).alias("low"), F.max(high).alias("high"))


def dataset_totals(episodes: DataFrame, frames: str = "length") -> DataFrame:
    return episodes.agg(F.count("*").alias("total_episodes"), F.coalesce(F.sum(frames), F.lit(0)).cast("bigint").alias("total_frames"))


#: Names of the statistics that are written with episodes.
KEPT = ("min", "max", "mean", "std", "count", *(f"q{round(q * 100):02d}" for q in QUANTILES))


def episode_stats(frames: DataFrame, key: str) -> DataFrame | None:
    """(key, feature, dim, ``KEPT``) of the numeric columns of all episodes; None without such columns."""
    out = None
    for name in stat_columns(frames.schema):
        held = frames.select(key, F.col(f"`{name}`").alias("__v"))
        one = feature_stats(held, [key], "__v").join(feature_quantiles(held, [key], "__v"), [key, "dim"]).withColumn("feature", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def with_stats(episodes: DataFrame, parts: DataFrame | None, key: str) -> DataFrame:
    """Episodes with an array column ``stats/<feature>/<statistic>`` for each, by element."""
    if parts is None:
        return episodes
    out = episodes
    names = [r["feature"] for r in parts.select("feature").distinct().orderBy("feature").collect()]  # bounded: columns
    for name in names:
        rows = parts.filter(F.col("feature") == name).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("dim", *KEPT))).alias("__s"))
        values = [F.col(f"__s.{k}").alias(f"stats/{name}/{k}") for k in KEPT]
        out = out.join(rows.select(key, *values), key, "left")
    return out


def described(parts: DataFrame | None) -> dict[str, dict[str, list]]:
    """Statistics of the whole dataset, pooled from those of its episodes: lists by element for each feature."""
    if parts is None:
        return {}
    rows = merge_stats(parts, ["feature", "dim"], [k for k in KEPT if k.startswith("q")]).orderBy("feature", "dim").collect()  # bounded: elements of features
    out: dict[str, dict[str, list]] = {}
    for r in rows:
        for k in KEPT:
            out.setdefault(r["feature"], {}).setdefault(k, []).append(r[k])
    return out
