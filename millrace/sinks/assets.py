"""Media that travel with rows: copied to files, or packed into blocks."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from millrace.functions.types import BLOB

POLICIES = ("error", "drop_row", "set_null")


@dataclass(frozen=True)
class FileAssets:
    """One file an asset, under ``subdir``; the column gets the new path."""

    columns: tuple[str, ...]
    subdir: str = "assets"
    missing_policy: str = "error"


@dataclass(frozen=True)
class BlobAssets:
    """Assets one after the other in blocks of about ``target_bytes``; the column gets path, offset and size."""

    columns: tuple[str, ...]
    subdir: str = "blobs"
    target_bytes: int = 1 << 30
    missing_policy: str = "error"


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def is_missing(e: Exception) -> bool:
    """Whether an error says that the asset is not there; other errors are always raised."""
    return isinstance(e, FileNotFoundError) or any(x in str(e).lower() for x in ("404", "entry not found", "no such file"))


def _load(value: Any) -> tuple[bytes, str]:
    if isinstance(value, (bytes, bytearray)):
        return bytes(value), "asset"
    if isinstance(value, dict):
        if value.get("bytes") is not None:
            return value["bytes"], value.get("path") or "asset"
        value = value["path"]
    fs, inner = _open(value)
    with fs.open_input_file(inner) as f:
        return f.read(), value


def safe_name(path: str) -> str:
    return re.sub(r"[^A-Za-z0-9._-]+", "_", path.rstrip("/").rpartition("/")[2]) or "asset"


def write_assets(df: DataFrame, output: str, config: FileAssets | BlobAssets) -> DataFrame:
    """``df`` with the assets of the configured columns stored under ``output`` and the columns rewritten.

    File names hold the partition and the attempt, so that a retried task never touches what
    another attempt wrote. Lists are stored element by element; a missing element is null
    under ``set_null``, alone.
    """
    if config.missing_policy not in POLICIES:
        raise ValueError(config.missing_policy)
    blob = isinstance(config, BlobAssets)
    new = BLOB if blob else T.StringType()
    fields = [T.StructField(f.name, (T.ArrayType(new) if isinstance(f.dataType, T.ArrayType) else new), True, f.metadata) if f.name in config.columns else f for f in df.schema]
    schema = T.StructType(fields)
    arrow = to_arrow_schema(schema)
    lost = object()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        shard = f"{task.partitionId():05d}__a{task.taskAttemptId()}" if task else "00000__a0"
        fs, root = _open(f"{output.rstrip('/')}/{config.subdir}")
        blocks: dict[str, list] = {}
        number = 0

        def put(column: str, row: int, item: int | None, value: Any) -> Any:
            if value is None:
                return None
            try:
                data, source = _load(value)
            except Exception as e:
                if config.missing_policy == "error" or not is_missing(e):
                    raise
                return lost
            if not blob:
                name = f"{shard}/{column}/{row}{'' if item is None else f'-{item}'}-{safe_name(source)}"
                fs.create_dir(f"{root}/{name}".rpartition("/")[0], recursive=True)
                with fs.open_output_stream(f"{root}/{name}") as f:
                    f.write(data)
                return f"{output.rstrip('/')}/{config.subdir}/{name}"
            block = blocks.setdefault(column, [None, 0, -1])
            if block[0] is None or block[1] and block[1] + len(data) > config.target_bytes:
                if block[0] is not None:
                    block[0].close()
                block[2] += 1
                fs.create_dir(f"{root}/{shard}", recursive=True)
                block[0], block[1] = fs.open_output_stream(f"{root}/{shard}/{column}-{block[2]}.bin"), 0
            at, block[1] = block[1], block[1] + len(data)
            block[0].write(data)
            return {"path": f"{output.rstrip('/')}/{config.subdir}/{shard}/{column}-{block[2]}.bin", "offset": at, "size": len(data)}

        for b in batches:
            rows = []
            for r in b.to_pylist():
                gone = False
                for c in config.columns:
                    v = r[c]
                    if isinstance(v, list):
                        got = [put(c, number, i, x) for i, x in enumerate(v)]
                        gone |= config.missing_policy == "drop_row" and lost in got
                        r[c] = [None if x is lost else x for x in got]
                    else:
                        got = put(c, number, None, v)
                        gone |= config.missing_policy == "drop_row" and got is lost
                        r[c] = None if got is lost else got
                number += 1
                if not gone:
                    rows.append(r)
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)
        for f, _, _ in blocks.values():
            if f is not None:
                f.close()

    return df.mapInArrow(run, schema)


def blob_offsets(df: DataFrame, order: str, size: str) -> DataFrame:
    from millrace.operators.offsets import running_offsets

    return running_offsets(df, [], order, size, "offset").withColumn("end", F.col("offset") + F.col(size))
