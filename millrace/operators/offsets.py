"""Running sums and numbers over a whole table, without putting it in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def slots_of(df: DataFrame, order: str, slots: int) -> Column:
    """A slot for each row that rises with ``order``; equal values share one."""
    c = F.col(f"`{order}`").cast("double")
    bounds = df.select(c.alias("x")).filter("x IS NOT NULL").approxQuantile("x", [i / slots for i in range(1, slots)], 0.2 / slots) if slots > 1 else []
    return F.coalesce(F.size(F.filter(F.array(*(F.lit(float(b)) for b in sorted(set(bounds)))).cast("array<double>"), lambda b: b < c)), F.lit(-1))


def running_offsets(df: DataFrame, keys: list[str], order: str, size: str, output: str, slots: int | None = None) -> DataFrame:
    """``df`` with ``output``: the sum of ``size`` over the rows before, by ``order``, within ``keys``.

    Rows go to slots by approximate quantiles of the numeric ``order``, those of a key too, so that
    a key with many rows is dealt to several tasks; sums inside the slots start from the sums of the
    key's slots before, of which there is one a slot. Nulls of ``size`` count as 0; equal orders go
    by their size; null keys are a key.
    """
    amount = F.coalesce(F.col(size), F.lit(0)).cast("bigint")
    by = [F.col(f"`{order}`").asc_nulls_first(), amount]
    slots = slots or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = df.withColumn("__slot", slots_of(df, order, slots))
    part = ["__slot"]
    if keys:
        held = held.withColumn("__key", F.struct(*(F.col(k) for k in keys)))  # a struct of nulls is equal to another
        part = ["__key", "__slot"]
    sums = held.groupBy(*part).agg(F.sum(amount).alias("__sum"))
    before = (Window.partitionBy("__key") if keys else Window).orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1)  # one row a slot
    base = sums.select(*part, F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__base"))
    w = Window.partitionBy(*part).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    inside = held.withColumn("__in", F.coalesce(F.sum(amount).over(w), F.lit(0)))
    joined = inside.join(base if keys else F.broadcast(base), part)
    return joined.withColumn(output, (F.col("__base") + F.col("__in")).cast("bigint")).drop("__key", "__slot", "__base", "__in")


def global_index(df: DataFrame, order: str, output: str, slots: int | None = None) -> DataFrame:
    """``df`` with ``output``: each row's number from 0 by ``order``."""
    return running_offsets(df.withColumn("__one", F.lit(1)), [], order, "__one", output, slots).drop("__one")
