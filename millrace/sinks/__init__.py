"""Writers. Each has ``write(df)``, which runs the plan and returns counts."""

from __future__ import annotations

import json
import math
from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from millrace.functions.types import apply_dtypes
from millrace.shared import checkpointed
from millrace.sinks.assets import BlobAssets, FileAssets, write_assets
from millrace.sinks.base import NamedFilesSink, Sink

__all__ = ["BlobAssets", "EpisodeSink", "FileAssets", "JsonlSink", "LanceSink", "NamedFilesSink", "NullSink", "ParquetSink", "Sink", "ZarrSink", "write_assets"]


def _counted(df: DataFrame) -> tuple[DataFrame, Observation]:
    """``df`` that counts its rows while it is written."""
    seen = Observation()
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen


@dataclass(frozen=True)
class NullSink:
    """Counts rows and throws them away."""

    def write(self, df: DataFrame) -> dict:
        df, seen = _counted(df)
        df.write.format("noop").mode("overwrite").save()
        return {"rows": seen.get["rows"]}


@dataclass(frozen=True)
class JsonlSink:
    """Lines of JSON, nulls written; task output is committed once, whatever is retried."""

    output: str
    assets: Any = None
    options: Mapping[str, Any] = field(default_factory=dict)

    def write(self, df: DataFrame) -> dict:
        df = write_assets(df, self.output, self.assets) if self.assets else df
        df, seen = _counted(df)
        df.write.mode("overwrite").options(**self.options).option("ignoreNullFields", False).json(self.output)
        return {"rows": seen.get["rows"], "output": self.output}


@dataclass(frozen=True)
class ParquetSink:
    output: str
    compression: str | None = None
    assets: Any = None
    dtypes: Mapping[str, Any] | None = None

    def write(self, df: DataFrame) -> dict:
        df = write_assets(df, self.output, self.assets) if self.assets else df
        df, seen = _counted(apply_dtypes(df, self.dtypes))
        writer = df.write.mode("overwrite")
        (writer.option("compression", self.compression) if self.compression else writer).parquet(self.output)
        return {"rows": seen.get["rows"], "output": self.output}


@dataclass(frozen=True)
class LanceSink:
    """Fragments written by the tasks and committed by the driver at once; needs the library lance."""

    output: str
    mode: str = "create"

    def write(self, df: DataFrame) -> dict:
        from millrace.sources.gated import need

        if self.mode not in ("create", "append", "overwrite"):
            raise ValueError(self.mode)
        lance = need("lance", "write_lance")
        from pyspark.sql.pandas.types import to_arrow_schema

        schema, output = to_arrow_schema(df.schema), self.output

        def fragments(batches):
            import pickle

            import lance as lib
            import pyarrow as pa

            made = lib.fragment.write_fragments(pa.RecordBatchReader.from_batches(schema, batches), output, schema=schema)
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(f) for f in made], pa.binary())], ["fragment"])

        import pickle

        df, seen = _counted(df)
        made = [pickle.loads(r["fragment"]) for r in df.mapInArrow(fragments, "fragment binary").collect()]
        if self.mode == "append":
            held = lance.dataset(output)
            lance.LanceDataset.commit(output, lance.LanceOperation.Append(made), read_version=held.version)
        else:
            lance.LanceDataset.commit(output, lance.LanceOperation.Overwrite(schema, made))
        return {"rows": seen.get["rows"], "output": output}


def _put(root: str, files: Mapping[str, bytes]) -> None:
    fs, path = pafs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (pafs.LocalFileSystem(), root.rstrip("/"))
    for name, data in files.items():
        fs.create_dir(f"{path}/{name}".rpartition("/")[0], recursive=True)
        with fs.open_output_stream(f"{path}/{name}") as f:
            f.write(data)


#: Row ends in a chunk of their array.
ENDS_CHUNK = 1 << 16


@dataclass(frozen=True)
class ZarrSink:
    """Rows appended along the first axis of arrays, with cumulative row ends.

    ``arrays`` maps array paths to columns of (nested) numbers. Arrays of a row must be of one
    length, and all rows of one inner shape and type. Chunks hold as many entries of the first axis
    as make ``chunk_bytes``, one at least. Offsets come from a running sum of lengths over
    ``order``; rows are cut at the ends of chunks, and the pieces of a chunk meet in one task,
    which writes it whole, again after a failure.
    """

    output: str
    arrays: Mapping[str, str]
    attrs: Mapping[str, Any] = field(default_factory=dict)
    order: str | None = None
    ends_path: str = "meta/episode_ends"
    chunk_bytes: int = 4 << 20

    def write(self, df: DataFrame) -> dict:
        from millrace.operators.offsets import global_index, running_offsets

        if not self.arrays:
            raise ValueError("no arrays")
        if self.chunk_bytes < 1:
            raise ValueError("chunk_bytes is positive")
        columns, output = dict(self.arrays), self.output
        some = next(iter(columns.values()))
        keyed = df.withColumn("__order", F.col(self.order)) if self.order else checkpointed(df.withColumn("__order", F.monotonically_increasing_id()))
        sized = keyed.select("__order", *dict.fromkeys(columns.values()), F.size(some).cast("bigint").alias("__n"), *(F.size(c).alias(f"__n_{i}") for i, c in enumerate(columns.values())))
        odd = sized.filter(" OR ".join(f"__n_{i} <> __n" for i in range(len(columns)))).limit(1).count()
        if odd:
            raise ValueError("arrays of a row are of several lengths")
        placed = checkpointed(running_offsets(sized, [], "__order", "__n", "__low").select("__low", "__n", *dict.fromkeys(columns.values())))
        sample = placed.filter("__n > 0").limit(1).collect() or placed.limit(1).collect()
        shapes = {p: np.asarray(sample[0][c]) for p, c in columns.items()} if sample else {}
        steps = {p: max(1, self.chunk_bytes // max(1, x.dtype.itemsize * math.prod(x.shape[1:]))) for p, x in shapes.items()}

        def cut(batches):
            import pyarrow as pa

            for b in batches:
                for r in b.to_pylist():
                    low, out = r["__low"], []
                    for path, c in columns.items():
                        x, step = np.asarray(r[c], shapes[path].dtype), steps[path]
                        if len(x) and x.shape[1:] != shapes[path].shape[1:]:
                            raise ValueError(f"{path}: shape {x.shape[1:]} after {shapes[path].shape[1:]}")
                        for k in range(low // step, -(-(low + len(x)) // step)):
                            first, last = max(low, k * step), min(low + len(x), (k + 1) * step)
                            out.append((path, k, first - k * step, np.ascontiguousarray(x[first - low : last - low]).tobytes()))
                    yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.binary()))], ["path", "chunk", "at", "data"])

        def join(pieces):
            import pyarrow as pa

            path, number = pieces["path"][0].as_py(), pieces["chunk"][0].as_py()
            x = shapes[path]
            one = x.dtype.itemsize * math.prod(x.shape[1:])
            data = bytearray(one * steps[path])
            for at, part in zip(pieces["at"].to_pylist(), pieces["data"].to_pylist(), strict=True):
                data[at * one : at * one + len(part)] = part
            _put(output, {f"{path}/{'.'.join(map(str, (number, *([0] * (x.ndim - 1)))))}": bytes(data)})
            return pa.table({"written": [number]})

        ends_path = self.ends_path

        def join_ends(rows):
            import pyarrow as pa

            data = np.zeros(ENDS_CHUNK, "<i8")
            at = rows["at"].to_numpy()
            data[at] = rows["end"].to_numpy()
            number = rows["chunk"][0].as_py()
            _put(output, {f"{ends_path}/{number}": data.tobytes()})
            return pa.table({"written": [number]})

        pieces = placed.filter("__n > 0").mapInArrow(cut, "path string, chunk long, at long, data binary")
        pieces.groupBy("path", "chunk").applyInArrow(join, "written long").write.format("noop").mode("overwrite").save()
        ends = global_index(placed.select((F.col("__low") + F.greatest("__n", F.lit(0))).alias("end")), "end", "__i")
        ends = ends.select("end", F.floor(F.col("__i") / ENDS_CHUNK).alias("chunk"), (F.col("__i") % ENDS_CHUNK).alias("at"))
        ends.groupBy("chunk").applyInArrow(join_ends, "written long").write.format("noop").mode("overwrite").save()
        rows, size = placed.agg(F.count("*"), F.coalesce(F.max(F.col("__low") + F.col("__n")), F.lit(0))).first()
        plain = {"zarr_format": 2, "compressor": None, "fill_value": 0, "order": "C", "filters": None}
        meta = {".zgroup": {"zarr_format": 2}, ".zattrs": dict(self.attrs)}
        for path, x in shapes.items():
            meta[f"{path}/.zarray"] = {**plain, "shape": [size, *x.shape[1:]], "chunks": [steps[path], *x.shape[1:]], "dtype": x.dtype.str}
        meta[f"{ends_path}/.zarray"] = {**plain, "shape": [rows], "chunks": [ENDS_CHUNK], "dtype": "<i8"}
        _put(output, {k: json.dumps(v).encode() for k, v in meta.items()})
        return {"rows": rows, "output": output}


@dataclass(frozen=True)
class EpisodeSink:
    """Episode tables: frames, episodes with statistics, tasks, and the dataset's description and statistics.

    ``df`` has a row an episode with ``frames``, an array of structs, and ``tasks``, an array of
    texts. Episode ids are made unique, frames get global indices from running sums, and
    task numbers follow the order of the texts' first episodes.
    """

    output: str
    fps: float = 30.0
    robot_type: str | None = None
    frames_per_file: int = 1_000_000

    def write(self, df: DataFrame) -> dict:
        from millrace.operators import episodes as ops, stats

        if not math.isfinite(self.fps) or self.fps <= 0:
            raise ValueError("fps is a positive number")
        tables = ops.episode_tables(checkpointed(df))
        frames = checkpointed(tables.frames)
        tables = ops.Tables(tables.episodes, frames, tables.tasks)
        parts = stats.episode_stats(frames, "episode_index")
        whole = stats.described(parts)
        tables = ops.Tables(checkpointed(stats.with_stats(tables.episodes, parts, "episode_index")), frames, tables.tasks)
        for name, t in (("data/chunk-000", tables.frames.sortWithinPartitions("index")), ("meta/episodes", tables.episodes)):
            t.write.mode("overwrite").option("maxRecordsPerFile", self.frames_per_file).parquet(f"{self.output}/{name}")
        tables.tasks.coalesce(1).write.mode("overwrite").parquet(f"{self.output}/meta/tasks.parquet")
        total = tables.episodes.agg(F.count("*").alias("episodes"), F.sum("length").alias("frames")).first()
        n_tasks = tables.tasks.count()
        fps = round(self.fps) if abs(self.fps - round(self.fps)) < 1e-6 else self.fps
        info = {"fps": fps, "robot_type": self.robot_type, "total_episodes": total["episodes"], "total_frames": total["frames"] or 0, "total_tasks": n_tasks, "splits": {"train": f"0:{total['episodes']}"}, "features": ops.feature_map(tables.frames.schema)}
        _put(self.output, {"meta/info.json": json.dumps(info, indent=2).encode(), "meta/stats.json": json.dumps(whole, indent=2).encode()})
        return {"rows": total["episodes"], "output": self.output}
