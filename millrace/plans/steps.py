"""Python callbacks as Arrow batch operations."""

from __future__ import annotations

import asyncio
import inspect
import itertools
from collections.abc import Callable, Iterator, Mapping
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

from millrace.functions.types import schema_with_dtypes
from millrace.plans.row import Row

#: Rows on which a callback is tried to learn the columns it makes, where it declares none.
SAMPLE_ROWS = 32


def plain(value: Any) -> Any:
    """NumPy values as Python ones, nested."""
    if isinstance(value, np.ndarray):
        return plain(value.tolist())
    if isinstance(value, np.generic):
        return value.item()
    if isinstance(value, Mapping):
        return {k: plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return value


def merged(row: Row, result: Any) -> Row:
    """A row replaces the input, a mapping patches it."""
    if isinstance(result, Row):
        return result
    if isinstance(result, Mapping):
        return row.update(result)
    raise TypeError(f"a callback gives a Row or a mapping, not {type(result).__name__}")


def mapped(fn: Callable) -> Callable[[Iterator[Row]], Iterator[Row]]:
    return lambda rows: (merged(r, fn(r)) for r in rows)


def flat_mapped(fn: Callable) -> Callable[[Iterator[Row]], Iterator[Row]]:
    return lambda rows: (merged(r, x) for r in rows for x in fn(r))


def filtered(fn: Callable) -> Callable[[Iterator[Row]], Iterator[Row]]:
    return lambda rows: (r for r in rows if fn(r))


def batched(fn: Callable, size: int) -> Callable[[Iterator[Row]], Iterator[Row]]:
    def run(rows: Iterator[Row]) -> Iterator[Row]:
        for batch in itertools.batched(rows, size):
            for out in fn(list(batch)):
                if not isinstance(out, Row):
                    raise TypeError("a batch callback gives rows")
                yield out

    return run


def awaited(fn: Callable, in_flight: int, ordered: bool) -> Callable[[Iterator[Row]], Iterator[Row]]:
    """A bounded window of coroutines in one event loop for a partition; the first failure ends it."""

    def run(rows: Iterator[Row]) -> Iterator[Row]:
        loop = asyncio.new_event_loop()

        async def one(row: Row) -> Row:
            out = fn(row)
            return merged(row, await out if inspect.isawaitable(out) else out)

        window: list[asyncio.Task] = []
        try:
            for row in rows:
                window.append(loop.create_task(one(row)))
                if len(window) >= in_flight:
                    yield _next(loop, window, ordered)
            while window:
                yield _next(loop, window, ordered)
        finally:
            for task in window:
                task.cancel()
            if window:
                loop.run_until_complete(asyncio.gather(*window, return_exceptions=True))
            close = getattr(fn, "aclose", None)
            if close is not None:
                loop.run_until_complete(close())
            loop.close()

    return run


def _next(loop: asyncio.AbstractEventLoop, window: list[asyncio.Task], ordered: bool) -> Row:
    if ordered:
        return loop.run_until_complete(window.pop(0))
    done, _ = loop.run_until_complete(asyncio.wait(window, return_when=asyncio.FIRST_COMPLETED))
    task = next(t for t in window if t in done)
    window.remove(task)
    return task.result()


def infer(rows: list[Row], base: T.StructType) -> T.StructType:
    """``base`` with the columns that ``rows`` have besides, in the order in which they are first seen.

    A column of ``base`` that no row has is gone; one whose values changed gets their type.
    """
    names = dict.fromkeys(n for r in rows for n in r)
    known = to_arrow_schema(base)
    fields = []
    for n in names:
        values = [plain(r.get(n)) for r in rows]
        if n in base.names:
            try:
                pa.array(values, known.field(n).type)
                fields.append(base[n])
                continue
            except (pa.ArrowInvalid, pa.ArrowTypeError, TypeError):
                pass
        t = pa.array(values).type
        fields.append(T.StructField(n, T.StringType() if pa.types.is_null(t) else from_arrow_schema(pa.schema([(n, t)]))[0].dataType))
    return T.StructType(fields)


def apply_rows(df: DataFrame, run: Callable[[Iterator[Row]], Iterator[Row]], dtypes: Mapping[str, Any] | None, keeps: bool = False) -> DataFrame:
    """``df`` through a row callback.

    The schema is that of ``df`` with ``dtypes`` laid over it. Where no dtypes are given, the
    callback is tried on the first rows; a column that shows up only later is an error.
    """
    given = df.schema
    if keeps:
        schema = given
    elif dtypes:
        schema = schema_with_dtypes(given, dtypes)
    else:
        tried = list(run(iter([Row(r.asDict(recursive=True)) for r in df.limit(SAMPLE_ROWS).collect()])))
        schema = infer(tried, given) if tried else given
    arrow, names = to_arrow_schema(schema), set(schema.names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (Row(x) for b in batches for x in b.to_pylist())
        for part in itertools.batched(run(rows), 2048):
            for r in part:
                if not names.issuperset(r):
                    raise KeyError(f"columns {sorted(set(r) - names)} were not declared; give their dtypes")
            yield pa.RecordBatch.from_pylist([{n: plain(r.get(n)) for n in schema.names} for r in part], schema=arrow)

    return df.mapInArrow(work, schema)


def apply_table(df: DataFrame, fn: Callable[[pa.Table], pa.Table], dtypes: Mapping[str, Any] | None) -> DataFrame:
    """``df`` through a callback on Arrow tables, batch by batch."""
    if dtypes:
        schema = schema_with_dtypes(df.schema, dtypes)
    else:
        schema = from_arrow_schema(_checked(fn(df.limit(SAMPLE_ROWS).toArrow())).schema)
    arrow = to_arrow_schema(schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from _checked(fn(pa.Table.from_batches([b]))).select(schema.names).cast(arrow).to_batches()

    return df.mapInArrow(work, schema)


def _checked(table: Any) -> pa.Table:
    if not isinstance(table, pa.Table):
        raise TypeError(f"a table callback gives a table, not {type(table).__name__}")
    return table
