"""The dataset: an immutable plan over a DataFrame, with an optional sink."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.expr import RESERVED, Expr, lower
from millrace.functions.types import apply_dtypes, field as typed
from millrace.plans import steps
from millrace.plans.row import Row

#: Shards that can be listed.
MAX_SHARDS = 10_000


def _free(*names: str) -> None:
    for n in names:
        if n in RESERVED:
            raise ValueError(f"{n} is reserved")


def _quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


@dataclass(frozen=True)
class Dataset:
    """A lazy DataFrame, the names of its steps for rendering, and what is to be written."""

    df: DataFrame
    steps: tuple[tuple[str, Any], ...] = ()
    sink: Any = None
    limits: Mapping[str, int] = field(default_factory=dict)

    def _then(self, df: DataFrame, name: str, detail: Any = None) -> Dataset:
        return replace(self, df=df, steps=(*self.steps, (name, detail)))

    def _ids(self) -> list[str]:
        return [c for c in RESERVED if c in self.df.columns]

    def _visible(self) -> list[str]:
        return [c for c in self.df.columns if c not in RESERVED]

    def _known(self, *names: str) -> None:
        for n in names:
            if n not in self.df.columns:
                raise KeyError(n)

    # --- structure ------------------------------------------------------------------------

    def select(self, *names: str) -> Dataset:
        """The named columns in their order; the identity columns stay."""
        if not names:
            raise ValueError("select needs a column")
        _free(*names)
        self._known(*names)
        return self._then(self.df.select(*map(_quoted, [*names, *self._ids()])), "select", names)

    def drop(self, *names: str) -> Dataset:
        if not names:
            raise ValueError("drop needs a column")
        _free(*names)
        self._known(*names)
        return self._then(self.df.drop(*names), "drop", names)

    def rename(self, **names: str) -> Dataset:
        """All renamings at once; old names that are unknown are passed over."""
        _free(*names, *names.values())
        new = [names.get(c, c) for c in self.df.columns]
        if len(set(new)) < len(new):
            raise ValueError(f"two columns of one name in {new}")
        return self._then(self.df.select(*(_quoted(c).alias(n) for c, n in zip(self.df.columns, new, strict=True))), "rename", names)

    def cast(self, **dtypes: Any) -> Dataset:
        """Casts that fail where a value would change."""
        _free(*dtypes)
        return self._then(apply_dtypes(self.df, dtypes), "cast", {k: str(v) for k, v in dtypes.items()})

    def with_columns(self, **values: Any) -> Dataset:
        """New or replaced columns, one after the other: later ones see earlier ones."""
        _free(*values)
        df = self.df
        for name, value in values.items():
            df = df.withColumn(name, lower(value, df.schema))
        return self._then(df, "with_columns", {k: repr(v) for k, v in values.items()})

    def with_column(self, name: str, value: Any) -> Dataset:
        return self.with_columns(**{name: value})

    def filter(self, condition: Expr | Callable[[Row], Any]) -> Dataset:
        """Rows for which an expression is true (null is not), or a callback gives a true value."""
        if isinstance(condition, Expr):
            return self._then(self.df.filter(lower(condition, self.df.schema).cast("boolean")), "filter", repr(condition))
        return self._then(steps.apply_rows(self.df, steps.filtered(condition), None, keeps=True), "filter", condition)

    # --- callbacks ------------------------------------------------------------------------

    def map(self, fn: Callable[[Row], Any], dtypes: Mapping[str, Any] | None = None) -> Dataset:
        """``fn`` gives a Row, which replaces the row, or a mapping, which patches it."""
        return self._then(steps.apply_rows(self.df, steps.mapped(fn), dtypes), "map", fn)

    def flat_map(self, fn: Callable[[Row], Any], dtypes: Mapping[str, Any] | None = None) -> Dataset:
        return self._then(steps.apply_rows(self.df, steps.flat_mapped(fn), dtypes), "flat_map", fn)

    def batch_map(self, fn: Callable[[list[Row]], Any], batch_size: int, dtypes: Mapping[str, Any] | None = None) -> Dataset:
        """``fn`` on lists of rows; batches end with their partition."""
        if batch_size < 2:
            raise ValueError("a batch has two rows at least")
        return self._then(steps.apply_rows(self.df, steps.batched(fn, batch_size), dtypes), "batch_map", fn)

    def map_async(self, fn: Callable[[Row], Any], max_in_flight: int = 16, preserve_order: bool = True, dtypes: Mapping[str, Any] | None = None) -> Dataset:
        if max_in_flight < 1:
            raise ValueError("one call at least is in flight")
        return self._then(steps.apply_rows(self.df, steps.awaited(fn, max_in_flight, preserve_order), dtypes), "map_async", fn)

    def map_table(self, fn: Callable, dtypes: Mapping[str, Any] | None = None) -> Dataset:
        """``fn`` on Arrow tables of a batch each."""
        return self._then(steps.apply_table(self.df, fn, dtypes), "map_table", fn)

    def transform(self, fn: Callable[..., DataFrame], *args: Any, **kwargs: Any) -> Dataset:
        """Any function from DataFrame to DataFrame, as the operators of this library are."""
        return self._then(fn(self.df, *args, **kwargs), getattr(fn, "__name__", "transform"), None)

    add_step = transform

    # --- limits ---------------------------------------------------------------------------

    def _limited(self, conf: str, n: int) -> Dataset:
        if n <= 0:
            raise ValueError("a limit is positive")
        return replace(self, limits={**self.limits, conf: n})

    def with_max_block_rows(self, n: int) -> Dataset:
        return self._limited("spark.sql.execution.arrow.maxRecordsPerBatch", n)

    def with_max_vectorized_block_bytes(self, n: int) -> Dataset:
        return self._limited("spark.sql.execution.arrow.maxBytesPerBatch", n)

    def _run(self, action: Callable[[], Any]) -> Any:
        """An action under the limits, which are put back after it."""
        conf = self.df.sparkSession.conf
        before = {k: conf.get(k, None) for k in self.limits}
        for k, n in self.limits.items():
            conf.set(k, str(n))
        try:
            return action()
        finally:
            for k, v in before.items():
                conf.unset(k) if v is None else conf.set(k, v)

    # --- results --------------------------------------------------------------------------

    def _shown(self) -> DataFrame:
        return self.df.select(*map(_quoted, self._visible()))

    def iter_rows(self) -> Iterator[Row]:
        return (Row(r.asDict(recursive=True)) for r in self._shown().toLocalIterator())

    __iter__ = iter_rows

    def materialize(self) -> list[Row]:
        return self._run(lambda: [Row(r.asDict(recursive=True)) for r in self._shown().collect()])

    def take(self, n: int) -> list[Row]:
        """The first ``n`` rows; none for 0."""
        if n < 0:
            raise ValueError("take needs a number that is not negative")
        return self._run(lambda: [Row(r.asDict(recursive=True)) for r in self._shown().limit(n).collect()])

    def output_schema(self) -> T.StructType:
        return self._shown().schema

    def list_shards(self) -> list[int]:
        """Numbers of the partitions that the plan reads or makes; more than MAX_SHARDS are an error."""
        n = self.df.rdd.getNumPartitions()
        if n > MAX_SHARDS:
            raise ValueError(f"{n} shards; {MAX_SHARDS} can be listed")
        return list(range(n))

    def plan(self) -> str:
        """The steps as JSON; callbacks by name."""
        shown = [{"name": n, "detail": getattr(d, "__name__", d) if callable(d) else d} for n, d in self.steps]
        if self.sink is not None:
            shown.append({"name": "write", "detail": repr(self.sink)})
        return json.dumps(shown, default=str)

    def explain(self, mode: str = "formatted") -> None:
        self.df.explain(mode)

    # --- sinks ----------------------------------------------------------------------------

    def with_sink(self, sink: Any) -> Dataset:
        """The dataset with a sink in place of any other; None takes it off."""
        return replace(self, sink=sink)

    def write_jsonl(self, output: str, assets: Any = None, **options: Any) -> Dataset:
        from millrace.sinks import JsonlSink

        return self.with_sink(JsonlSink(output, assets=assets, options=options))

    def write_parquet(self, output: str, compression: str | None = None, assets: Any = None, dtypes: Mapping[str, Any] | None = None) -> Dataset:
        from millrace.sinks import ParquetSink

        return self.with_sink(ParquetSink(output, compression=compression, assets=assets, dtypes=dtypes))

    def write_zarr(self, output: str, arrays: Mapping[str, str], attrs: Mapping[str, Any] | None = None, order: str | None = None) -> Dataset:
        from millrace.sinks import ZarrSink

        return self.with_sink(ZarrSink(output, arrays, attrs or {}, order))

    def write_lance(self, output: str, mode: str = "create") -> Dataset:
        from millrace.sinks import LanceSink

        return self.with_sink(LanceSink(output, mode))

    def write_episodes(self, output: str, **options: Any) -> Dataset:
        from millrace.sinks import EpisodeSink

        return self.with_sink(EpisodeSink(output, **options))

    def launch_local(self, name: str = "run", num_workers: int | str = "auto") -> dict:
        """Runs the plan into its sink, or counts its rows; parallelism and retries are the session's."""
        if not name:
            raise ValueError("a run needs a name")
        if num_workers != "auto" and int(num_workers) < 1:
            raise ValueError("one worker at least")
        from millrace.sinks import NullSink

        return self._run(lambda: (self.sink or NullSink()).write(self._shown()))

    def with_dtypes(self, **dtypes: Any) -> Dataset:
        """Columns marked with types and metadata; types must agree."""
        df = self.df
        for n, t in dtypes.items():
            f = typed(n, t)
            df = df.withColumn(n, _quoted(n).cast(f.dataType).alias(n, metadata=f.metadata))
        return self._then(df, "with_dtypes", list(dtypes))
