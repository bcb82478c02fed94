"""Byte ranges of files, and files as streams."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import Any, BinaryIO
from urllib.parse import quote, urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Schemes of the paths that tasks open themselves.
OPENED = ("file", "s3", "gs")
#: Bytes read from a stream at a time.
STREAM_BYTES = 1 << 20
#: Rows and bytes of the batches that readers of streams make.
BATCH_ROWS, BATCH_BYTES = 4096, 8 << 20


def opened(path: str) -> BinaryIO:
    """The file at a path as Spark lists it, read as it is, whatever its suffix."""
    if path.startswith("file:"):
        fs, inner = pafs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    else:
        fs, inner = pafs.FileSystem.from_uri(quote(path, safe=":/"))
    return io.BufferedReader(fs.open_input_stream(inner, compression=None), STREAM_BYTES)


def from_streams(spark: SparkSession, inputs: str | Sequence[str], run: Callable[[str, BinaryIO], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """What ``run`` yields for the path and the stream of each file.

    Paths of schemes in ``OPENED`` are listed by Spark and opened by the tasks, which never hold a
    whole file, however large. Files of other stores come through Spark's reader, whole, 2 GB at most.
    """
    from millrace.sources.tabular import read_files

    paths = [inputs] if isinstance(inputs, str) else list(inputs)
    default = spark._jvm.org.apache.hadoop.fs.FileSystem.getDefaultUri(spark._jsc.hadoopConfiguration()).getScheme()
    if all((urlsplit(str(p)).scheme or default) in OPENED for p in paths):
        files = read_files(spark, inputs, size_column=None).df.select("file_path", F.lit(None).cast("binary").alias("content"))
    else:
        files = read_files(spark, inputs, content_column="content", size_column=None).df.select("file_path", "content")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                with opened(path) if not data.is_valid else io.BufferedReader(pa.BufferReader(data.as_buffer())) as f:
                    yield from run(path, f)

    return files.mapInArrow(read, schema)


def read_blob(reference: Mapping[str, Any]) -> bytes:
    """Exactly the bytes of ``{path, offset, size}``; an early end of the file is an error."""
    path, offset, size = reference["path"], reference["offset"], reference["size"]
    for name, v in (("offset", offset), ("size", size)):
        if isinstance(v, bool) or not isinstance(v, int) or v < 0:
            raise ValueError(f"{name} is a number that is not negative: {v!r}")
    fs, inner = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)
    with fs.open_input_file(inner) as f:
        f.seek(offset)
        data = f.read(size)
    if len(data) != size:
        raise EOFError(f"{path}: {len(data)} of {size} bytes at {offset}")
    return data


def with_blobs(df: DataFrame, column: str, output: str) -> DataFrame:
    """``df`` with the bytes that the references in ``column`` name, in batches; null for null."""
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = pa.array([None if r is None else read_blob(r) for r in b.column(at).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns, data], [*b.schema.names, output])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(output, T.BinaryType())]))
