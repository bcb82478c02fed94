"""Alignment of event series: as-of joins, sparse unions, sessions and rates.

All are windows over one shuffle by key. Events carry their value inside a struct that is
never null, so that an event whose value is null is still an event.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

METHODS = ("hold", "nearest", "interpolate")


def asof(primary: DataFrame, events: DataFrame, keys: Sequence[str], ts: str, values: Sequence[str], seq: str, method: str = "hold", prefix: str | None = None) -> DataFrame:
    """``primary`` with the ``values`` of one event each, and that event's time ``<prefix>_ts``.

    hold: the latest event not after the row, the last of equal ones. nearest: the closest event, the
    earlier of two as close; of equal times the first where it is met from before and the last
    where it lies behind. interpolate: linear between the neighbours where both are numbers or
    arrays of one length, else nearest; outside the events and on them as nearest. A row
    without any event gets nulls. ``seq`` orders events of one time.
    """
    if method not in METHODS:
        raise ValueError(method)
    prefix = prefix or values[0]
    own = primary.columns
    t = F.col(ts)
    event = F.struct(t.alias("t"), *(F.col(v).alias(f"v{i}") for i, v in enumerate(values)), F.col(seq).alias("s"))
    left = primary.select(*keys, t.alias("__t"), F.lit(0).alias("__e"), F.struct(*(F.col(f"`{c}`") for c in own)).alias("__row"), F.lit(None).cast("bigint").alias("__s"))
    right = events.select(*keys, t.alias("__t"), F.lit(1).alias("__e"), F.col(seq).cast("bigint").alias("__s"), event.alias("__ev"))
    both = left.unionByName(right, allowMissingColumns=True)
    part = Window.partitionBy(*keys)
    if method == "hold":
        w = part.orderBy("__t", F.desc("__e"), "__s").rowsBetween(Window.unboundedPreceding, 0)
        picked = both.withColumn("L", F.last("__ev", ignorenulls=True).over(w)).filter("__e = 0")
        return picked.select("__row.*", *(F.col(f"L.v{i}").alias(v) for i, v in enumerate(values)), F.col("L.t").alias(f"{prefix}_ts"))
    order = part.orderBy("__t", "__e", "__s")
    both = both.withColumn("L", F.last("__ev", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    both = both.withColumn("R", F.first("__ev", ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))).filter("__e = 0")
    kind = primary.schema[ts].dataType
    at, at_l, at_r = (_ticks(F.col(c), kind) for c in ("__t", "L.t", "R.t"))
    gap_l, gap_r = at - at_l, at_r - at
    to_left = F.col("R").isNull() | (F.col("L").isNotNull() & (gap_l <= gap_r))
    near = F.when(to_left, F.col("L")).otherwise(F.col("R"))
    out = both.withColumn("N", near)
    if method == "nearest":
        return out.select("__row.*", *(F.col(f"N.v{i}").alias(v) for i, v in enumerate(values)), F.col("N.t").alias(f"{prefix}_ts"))
    span = at_r - at_l
    share = gap_l.cast("double") / F.when(span > 0, span)
    inside = F.col("L").isNotNull() & F.col("R").isNotNull() & (gap_r > 0) & (span > 0)
    made = [_between(F.col(f"L.v{i}"), F.col(f"R.v{i}"), F.col(f"N.v{i}"), share, inside, events.schema[v].dataType).alias(v) for i, v in enumerate(values)]
    return out.select("__row.*", *made, F.col("N.t").alias(f"{prefix}_ts"))


def _ticks(t: Column, kind: T.DataType) -> Column:
    """Times as numbers: timestamps in microseconds, numbers as they are."""
    if isinstance(kind, T.TimestampNTZType):
        return F.unix_micros(t.cast("timestamp"))
    return F.unix_micros(t) if isinstance(kind, T.TimestampType) else t


def _between(left: Column, right: Column, near: Column, share: Column, inside: Column, kind: T.DataType) -> Column:
    mix = lambda a, b: (1 - share) * a + share * b
    if isinstance(kind, T.NumericType):
        a, b = left.cast("double"), right.cast("double")
        return F.when(inside & a.isNotNull() & b.isNotNull(), mix(a, b)).otherwise(near.cast("double"))
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.NumericType):
        a, b = left.cast("array<double>"), right.cast("array<double>")
        return F.when(inside & (F.size(a) == F.size(b)), F.zip_with(a, b, mix)).otherwise(near.cast("array<double>"))
    return near


def sparse_outer(fields: dict[str, DataFrame], keys: Sequence[str], ts: str, seq: str, value: str) -> DataFrame:
    """One row for each key, time and occurrence over all fields, with the fields' values or null.

    Events of a field at one time are numbered by ``seq``; those of one number share a row.
    """
    rows = None
    for name, df in fields.items():
        nth = F.row_number().over(Window.partitionBy(*keys, ts).orderBy(seq)) - 1
        one = df.select(*keys, ts, nth.cast("bigint").alias("occurrence"), F.col(value).alias(name))
        rows = one if rows is None else rows.unionByName(one, allowMissingColumns=True)
    return rows.groupBy(*keys, ts, "occurrence").agg(*(F.max(n).alias(n) if not isinstance(rows.schema[n].dataType, (T.MapType,)) else F.first(n, True).alias(n) for n in fields))


def gap_sessions(df: DataFrame, keys: Sequence[str], ts: str, gap: Column | int, order: Sequence[str], output: str = "session") -> DataFrame:
    """``df`` with session numbers from 0: a new one after each gap that is larger than ``gap``."""
    w = Window.partitionBy(*keys).orderBy(ts, *order)
    step = F.col(ts) - F.lag(ts).over(w)
    new = F.coalesce((step > gap).cast("int"), F.lit(0))
    return df.withColumn("__new", new).withColumn(output, F.sum("__new").over(w).cast("bigint")).drop("__new")


def marker_sessions(df: DataFrame, keys: Sequence[str], ts: str, is_marker: Column, output: str = "session") -> DataFrame:
    """``df`` with session numbers from 0: each marker begins one, together with what shares its time.

    Rows before a key's first marker are left out; a key without markers is one session.
    """
    w = Window.partitionBy(*keys).orderBy(ts).rangeBetween(Window.unboundedPreceding, 0)
    flag = F.coalesce(is_marker, F.lit(False)).cast("int")
    marked = df.withColumn("__m", flag).withColumn("__n", F.sum("__m").over(w)).withColumn("__any", F.max("__m").over(Window.partitionBy(*keys)))
    kept = marked.filter("__n > 0 OR __any = 0")
    return kept.withColumn(output, F.greatest(F.col("__n") - 1, F.lit(0)).cast("bigint")).drop("__m", "__n", "__any")


def infer_fps(df: DataFrame, keys: Sequence[str], seconds: Column, output: str = "fps") -> DataFrame:
    """For each key 1 / the median of the positive steps in time; null with fewer than two times."""
    w = Window.partitionBy(*keys).orderBy("__s")
    steps = df.select(*keys, seconds.cast("double").alias("__s")).withColumn("__d", F.col("__s") - F.lag("__s").over(w))
    return steps.groupBy(*keys).agg((1 / F.median(F.when(F.col("__d") > 0, F.col("__d")))).alias(output))


def snap_fps(fps: Column, default: float = 30.0) -> Column:
    """A rate within 1e-6 of a whole number as that number; ``default`` for null."""
    return F.coalesce(F.when(F.abs(fps - F.round(fps)) < 1e-6, F.round(fps)).otherwise(fps), F.lit(default))


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], output: str) -> DataFrame:
    """``df`` with each row's number from 0 within its key."""
    return df.withColumn(output, (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).cast("bigint"))


def windows_of(df: DataFrame, keys: Sequence[str], ts: str, windows: DataFrame, low: str, high: str) -> DataFrame:
    """Rows inside half-open windows ``[low, high)`` of their key."""
    return df.join(windows, list(keys)).filter((F.col(ts) >= F.col(low)) & (F.col(ts) < F.col(high)))
