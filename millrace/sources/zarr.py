"""Array stores of version 2 (JSON metadata, chunks raw, zlib, gzip or zstd), by pure Python."""

from __future__ import annotations

import gzip
import itertools
import json
import math
import zipfile
import zlib
from collections.abc import Iterator, Mapping, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from millrace.functions.types import field
from millrace.plans.dataset import Dataset
from millrace.plans.steps import infer, plain
from millrace.plans.row import Row
from millrace.sources.blobs import BATCH_ROWS

#: Bytes of the arrays that a task reads at a time.
BLOCK_BYTES = 32 << 20


class Store:
    """A group on a file system, or in a zip file there."""

    def __init__(self, root: str):
        self.fs, self.root = pafs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (pafs.LocalFileSystem(), root.rstrip("/"))
        self.zip = zipfile.ZipFile(self.fs.open_input_file(self.root)) if self.root.endswith(".zip") else None

    def read(self, key: str) -> bytes | None:
        if self.zip:
            return self.zip.read(key) if key in self.zip.NameToInfo else None
        try:
            with self.fs.open_input_file(f"{self.root}/{key}") as f:
                return f.read()
        except FileNotFoundError:
            return None

    def attrs(self, path: str = "") -> dict:
        raw = self.read(f"{path}/.zattrs".lstrip("/"))
        return json.loads(raw) if raw else {}

    def array(self, path: str) -> Array:
        raw = self.read(f"{path}/.zarray")
        if raw is None:
            raise KeyError(path)
        return Array(self, path, json.loads(raw))


class Array:
    def __init__(self, store: Store, path: str, meta: dict):
        if meta.get("order", "C") != "C" or meta.get("filters"):
            raise ValueError(f"{path}: only C order without filters is supported")
        self.store, self.path, self.meta = store, path, meta
        self.shape, self.chunks, self.dtype = tuple(meta["shape"]), tuple(meta["chunks"]), np.dtype(meta["dtype"])
        self._held: dict[tuple[int, ...], np.ndarray] = {}

    @property
    def bytes(self) -> int:
        return math.prod(self.shape) * self.dtype.itemsize

    def _chunk(self, at: tuple[int, ...]) -> np.ndarray:
        """A chunk; those that begin like the last one along the first axis are kept for the rows that follow."""
        if at not in self._held:
            if self._held and next(iter(self._held))[:1] != at[:1]:
                self._held.clear()
            self._held[at] = self._read(at)
        return self._held[at]

    def _read(self, at: tuple[int, ...]) -> np.ndarray:
        raw = self.store.read(f"{self.path}/{self.meta.get('dimension_separator', '.').join(map(str, at)) or '0'}")
        if raw is None:
            return np.full(self.chunks, self.meta.get("fill_value") or 0, self.dtype)
        kind = (self.meta.get("compressor") or {}).get("id")
        if kind == "zlib":
            raw = zlib.decompress(raw)
        elif kind == "gzip":
            raw = gzip.decompress(raw)
        elif kind == "zstd":
            import zstandard

            raw = zstandard.ZstdDecompressor().decompress(raw, max_output_size=math.prod(self.chunks) * self.dtype.itemsize)
        elif kind is not None:
            raise ValueError(f"{self.path}: compressor {kind} is not supported")
        return np.frombuffer(raw, self.dtype).reshape(self.chunks)

    def read(self, low: int = 0, high: int | None = None) -> np.ndarray:
        """Rows ``low`` to ``high`` of the first axis; only their chunks are read."""
        if not self.shape:
            return self._chunk(()).reshape(())
        high = self.shape[0] if high is None else min(high, self.shape[0])
        out = np.empty((max(high - low, 0), *self.shape[1:]), self.dtype)
        first = range(low // self.chunks[0], -(-high // self.chunks[0])) if high > low else ()
        rest = [range(-(-s // c)) for s, c in zip(self.shape[1:], self.chunks[1:], strict=True)]
        for at in itertools.product(first, *rest):
            chunk = self._chunk(at)
            begin = at[0] * self.chunks[0]
            a, b = max(low, begin), min(high, begin + self.chunks[0])
            inner = tuple(slice(0, min(c, s - i * c)) for i, c, s in zip(at[1:], self.chunks[1:], self.shape[1:], strict=True))
            where = tuple(slice(i * c, min((i + 1) * c, s)) for i, c, s in zip(at[1:], self.chunks[1:], self.shape[1:], strict=True))
            out[(slice(a - low, b - low), *where)] = chunk[(slice(a - begin, b - begin), *inner)]
        return out


def read_zarr(spark: SparkSession, inputs: str | Sequence[str], arrays: Mapping[str, str], attrs: Mapping[str, str] | None = None, row_ends: str | None = None, split_leading_axis: bool = False, leading_axis_row_size: int = 1, index_column: str | None = "row_index", dtypes: Mapping[str, Any] | None = None) -> Dataset:
    """Rows of array stores in one of three ways.

    By default a store is one row. With ``row_ends`` the named array of cumulative ends cuts the
    first axis; with ``split_leading_axis`` every ``leading_axis_row_size`` entries are a row. Ends
    must not fall and must end with the arrays' length; arrays must be of one length. The driver
    reads sizes, the last end and the first row; tasks read rows in blocks of ``BLOCK_BYTES`` of the arrays,
    and their ends, so that a falling end is an error of its task.
    """
    if row_ends and split_leading_axis:
        raise ValueError("row_ends and split_leading_axis exclude each other")
    if leading_axis_row_size < 1:
        raise ValueError("leading_axis_row_size is positive")
    plan = []
    for root in [inputs] if isinstance(inputs, str) else inputs:
        store = Store(root)
        if not row_ends and not split_leading_axis:
            plan.append((root, 0, 1))
            continue
        held = [store.array(p) for p in arrays.values()]
        sizes = {a.shape[0] for a in held}
        if len(sizes) != 1:
            raise ValueError(f"{root}: arrays of several lengths {sorted(sizes)}")
        (size,) = sizes
        n = -(-size // leading_axis_row_size)
        if row_ends:
            ends = store.array(row_ends)
            n = ends.shape[0]
            if (int(ends.read(n - 1, n)[0]) if n else 0) != size:
                raise ValueError(f"{root}: ends do not rise to {size}")
        step = min(BATCH_ROWS, max(1, n * BLOCK_BYTES // max(1, sum(a.bytes for a in held))))
        plan += [(root, i, min(i + step, n)) for i in range(0, n, step)]

    def bounds(store: Store, first: int, last: int, size: int) -> list[int]:
        """Where the rows ``first`` to ``last`` begin, and where the last one ends."""
        if not row_ends:
            return [min(i * leading_axis_row_size, size) for i in range(first, last + 1)]
        ends = store.array(row_ends)
        out = [*(ends.read(first - 1, first).tolist() if first else [0]), *ends.read(first, last).tolist()]
        if any(b < a for a, b in itertools.pairwise(out)):
            raise ValueError(f"{store.root}: ends do not rise to {size}")
        return out

    def rows(root: str, first: int, last: int) -> Iterator[dict]:
        store = Store(root)
        held, known = {c: store.array(p) for c, p in arrays.items()}, store.attrs()
        for key in (attrs or {}).values():
            if key not in known:
                raise KeyError(f"{root}: attribute {key}")
        cut = row_ends or split_leading_axis
        places = bounds(store, first, last, next(iter(held.values())).shape[0]) if cut else [0, None]
        for i, (low, high) in enumerate(itertools.pairwise(places), first):
            out = {c: a.read(low, high) for c, a in held.items()} | {c: known[k] for c, k in (attrs or {}).items()}
            yield plain({**out, **({index_column: i} if index_column else {}), "file_path": root})

    schema = T.StructType([field(n, t) for n, t in dtypes.items()]) if dtypes else infer([Row(x) for root, first, _ in plan[:1] for x in rows(root, first, first + 1)], T.StructType([]))
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in b.to_pylist():
                made = [{n: x.get(n) for n in schema.names} for x in rows(p["root"], p["first"], p["last"])]
                yield pa.RecordBatch.from_pylist(made, schema=arrow)

    df = spark.createDataFrame(plan, "root string, first long, last long")
    return Dataset(df.repartition(min(max(1, len(plan)), 2000)).mapInArrow(run, schema), (("read_zarr", None),))
