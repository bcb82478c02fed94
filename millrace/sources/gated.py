"""Readers that need libraries which may be absent; each says which one it misses."""

from __future__ import annotations

import importlib
from collections.abc import Iterator, Mapping, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from millrace.plans.dataset import Dataset


def need(library: str, purpose: str) -> Any:
    try:
        return importlib.import_module(library)
    except ImportError as e:
        raise ImportError(f"{purpose} needs the library {library}, which is not installed") from e


def read_hdf5(spark: SparkSession, inputs: str | Sequence[str], datasets: Mapping[str, str], groups: str | Sequence[str] = "/", attrs: Mapping[str, str] | None = None, missing_policy: str = "error", group_path_column: str | None = "group_path", dtypes: Mapping[str, Any] | None = None) -> Dataset:
    """One row for each matched group of each file; ``missing_policy`` is error, drop_row or set_null."""
    need("h5py", "read_hdf5")
    if missing_policy not in ("error", "drop_row", "set_null"):
        raise ValueError(missing_policy)
    from millrace.sources.tabular import read_files

    wanted = [groups] if isinstance(groups, str) else list(groups)

    def rows(row: Any) -> Iterator[dict]:
        import fnmatch
        import io

        import h5py

        with h5py.File(io.BytesIO(row["content"]), "r") as f:
            names = ["/"]
            f.visititems(lambda n, o: names.append("/" + n) if isinstance(o, h5py.Group) else None)
            for name in (n for n in names if any(fnmatch.fnmatch(n, w.replace("**", "*")) for w in wanted)):
                g, out, lost = f[name], {}, False
                for column, path in datasets.items():
                    if path in g:
                        out[column] = g[path][()]
                    else:
                        lost, out[column] = True, None
                for column, key in (attrs or {}).items():
                    if key in g.attrs:
                        out[column] = g.attrs[key]
                    else:
                        lost, out[column] = True, None
                if lost and missing_policy == "error":
                    raise KeyError(f"{row['file_path']}{name}")
                if not lost or missing_policy == "set_null":
                    yield {**out, "content": None, **({group_path_column: name} if group_path_column else {})}

    return read_files(spark, inputs, content_column="content").flat_map(rows, dtypes=dtypes).drop("content")


def load_lance(spark: SparkSession, uri: str, version: int | None = None, columns: Sequence[str] | None = None, batch_size: int = 8192) -> Dataset:
    """A pinned version of a dataset, a task for each fragment; row addresses are the identity."""
    lance = need("lance", "load_lance")
    data = lance.dataset(uri, version=version)
    from pyspark.sql.pandas.types import from_arrow_schema

    schema = from_arrow_schema(data.scanner(columns=columns, limit=0).to_table().schema)
    ids = [f.fragment_id for f in data.get_fragments()]
    pinned = data.version

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import lance as lib

        held = lib.dataset(uri, version=pinned)
        for b in batches:
            for i in b.column(0).to_pylist():
                yield from held.get_fragment(i).to_batches(columns=columns, batch_size=batch_size)

    df = spark.createDataFrame([(i,) for i in ids], "id long").repartition(max(1, len(ids)), "id").mapInArrow(run, schema)
    return Dataset(df, (("load_lance", uri),))


def read_hf_dataset(spark: SparkSession, repo: str, config: str | None = None, split: str = "train", **options: Any) -> Dataset:
    """The Parquet files of a hub dataset's split, read by Spark."""
    datasets = need("datasets", "read_hf_dataset")
    builder = datasets.load_dataset_builder(repo, config)
    files = [str(x) for x in builder.config.data_files[split]]
    from millrace.sources.tabular import read_parquet

    return read_parquet(spark, files, **options)


def read_tfds(spark: SparkSession, name: str, split: str = "train", examples_per_shard: int = 1000, dtypes: Mapping[str, Any] | None = None) -> Dataset:
    """Row ranges of a split, each read in a task of its own."""
    tfds = need("tensorflow_datasets", "read_tfds")
    total = tfds.builder(name).info.splits[split].num_examples
    from millrace.sources.memory import task

    def part(rank: int, n: int) -> list[dict]:
        import tensorflow_datasets as lib

        low, high = rank * examples_per_shard, min(total, (rank + 1) * examples_per_shard)
        return [dict(x) for x in lib.as_numpy(lib.load(name, split=f"{split}[{low}:{high}]"))]

    return task(spark, part, max(1, -(-total // examples_per_shard)), dtypes)


def asset_column(name: str, kind: str) -> Any:
    return F.col(name).alias(name, metadata={"asset_type": kind})
