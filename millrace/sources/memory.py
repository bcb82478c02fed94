"""Rows from Python: items, numbered tasks, and sources of one's own."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping
from typing import Any

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource
from pyspark.sql.pandas.types import to_arrow_schema

from millrace.functions.types import field
from millrace.plans.dataset import Dataset
from millrace.plans.row import Row
from millrace.plans.steps import infer, plain


def _rows(result: Any, scalar: str) -> Iterator[Row]:
    """Nothing for None, one row for a mapping, rows for an iterable, else one scalar."""
    if result is None:
        return
    if isinstance(result, Mapping):
        yield Row(result)
    elif isinstance(result, Iterable) and not isinstance(result, (str, bytes, bytearray)):
        for x in result:
            yield Row(x) if isinstance(x, Mapping) else Row({scalar: x})
    else:
        yield Row({scalar: result})


def from_items(spark: SparkSession, items: Iterable[Any], items_per_shard: int = 1000, dtypes: Mapping[str, Any] | None = None) -> Dataset:
    """Items in memory as rows; what is no mapping is the column ``item``."""
    if items_per_shard < 1:
        raise ValueError("items_per_shard is positive")
    rows = [Row(x) if isinstance(x, Mapping) else Row(item=x) for x in items]
    schema = T.StructType([field(n, t) for n, t in dtypes.items()]) if dtypes else infer(rows, T.StructType([]))
    table = pa.Table.from_pylist([{n: plain(r.get(n)) for n in schema.names} for r in rows], schema=to_arrow_schema(schema))
    df = spark.createDataFrame(table, schema) if len(schema) else spark.createDataFrame([], schema)
    return Dataset(df.repartition(max(1, -(-len(rows) // items_per_shard))) if len(rows) > items_per_shard else df, (("from_items", len(rows)),))


def task(spark: SparkSession, fn: Callable[[int, int], Any], num_tasks: int, dtypes: Mapping[str, Any] | None = None) -> Dataset:
    """``fn(rank, num_tasks)`` once for each rank, each in a task of its own; without dtypes rank 0 is tried first."""
    if num_tasks < 1:
        raise ValueError("one task at least")
    schema = T.StructType([field(n, t) for n, t in dtypes.items()]) if dtypes else infer(list(_rows(fn(0, num_tasks), "result")), T.StructType([]))
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rank in b.column(0).to_pylist():
                rows = [{n: plain(r.get(n)) for n in schema.names} for r in _rows(fn(rank, num_tasks), "result")]
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return Dataset(spark.range(0, num_tasks, 1, num_tasks).mapInArrow(run, schema), (("task", fn),))


def from_source(spark: SparkSession, source: type[DataSource], **options: Any) -> Dataset:
    """A data source of one's own, by Spark's Python data source interface."""
    spark.dataSource.register(source)
    return Dataset(spark.read.format(source.name()).options(**options).load(), (("from_source", source.name()),))
