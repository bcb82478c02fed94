"""A base for sinks of one's own, and files with names of one's own."""

from __future__ import annotations

import json
import pickle
import re
import string
from abc import ABC, abstractmethod
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame


class Sink(ABC):
    """Writes partitions in tasks and commits on the driver what the successful attempts wrote.

    The driver gets one message a partition, so that attempts which failed or lost a race are not
    among those that :meth:`commit` sees. The sink itself is pickled to the tasks.
    """

    def prepare(self, df: DataFrame) -> DataFrame:
        """The rows to write, on the driver before any task."""
        return df

    @abstractmethod
    def write_part(self, part: int, attempt: int, batches: Iterator[pa.RecordBatch]) -> Any:
        """Writes a partition; what it returns goes to :meth:`commit`."""

    def commit(self, messages: list[Any]) -> dict:
        """After all partitions, with their messages by partition; what it returns is added to the counts."""
        return {}

    def abort(self, error: Exception) -> None:
        """After a failure, which is raised again."""

    def write(self, df: DataFrame) -> dict:
        sink = self

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            task, rows = TaskContext.get(), 0

            def counted() -> Iterator[pa.RecordBatch]:
                nonlocal rows
                for b in batches:
                    rows += len(b)
                    yield b

            message = pickle.dumps(sink.write_part(task.partitionId(), task.taskAttemptId(), counted()))
            yield pa.RecordBatch.from_arrays([pa.array([task.partitionId()]), pa.array([rows]), pa.array([message], pa.binary())], ["part", "n", "message"])

        try:
            done = sorted(self.prepare(df).mapInArrow(run, "part long, n long, message binary").collect(), key=lambda r: r["part"])
            return {"rows": sum(r["n"] for r in done), **self.commit([pickle.loads(r["message"]) for r in done])}
        except Exception as e:
            self.abort(e)
            raise


#: Fields that a template of file names must have, and has no others.
NAME_FIELDS = ("shard_id", "worker_id")


def checked_template(template: str) -> str:
    """``template`` if it has both fields, plain, and no others; a ValueError otherwise."""
    try:
        parts = list(string.Formatter().parse(template))
    except ValueError as e:
        raise ValueError(f"template {template!r}: {e}") from e
    fields = [f for _, f, _, _ in parts if f is not None]
    if any(spec or change for _, f, spec, change in parts if f is not None) or set(fields) != set(NAME_FIELDS):
        raise ValueError(f"template {template!r} needs {{shard_id}} and {{worker_id}}, plain, and no other fields")
    return template


@dataclass(frozen=True)
class NamedFilesSink(Sink):
    """A file a partition, named by ``template``; its ending, .parquet or .jsonl, tells the format.

    ``shard_id`` is the partition and ``worker_id`` the attempt, so that no attempt touches the file of
    another. The commit deletes the files under ``output`` whose names fit the template and
    which no successful attempt wrote: those of failed attempts and of runs before. Partitions
    without rows have no file. Use it without speculative execution, whose late attempts may write after the commit.
    """

    output: str
    template: str = "{shard_id}__w{worker_id}.parquet"

    def __post_init__(self):
        checked_template(self.template)
        if not self.template.endswith((".parquet", ".jsonl")):
            raise ValueError(f"template {self.template!r} ends neither with .parquet nor with .jsonl")

    def _root(self) -> tuple[pafs.FileSystem, str]:
        if "://" in self.output or self.output.startswith("file:"):
            return pafs.FileSystem.from_uri(self.output)
        return pafs.LocalFileSystem(), self.output.rstrip("/")

    def write_part(self, part: int, attempt: int, batches: Iterator[pa.RecordBatch]) -> str | None:
        name = self.template.format(shard_id=f"{part:05d}", worker_id=attempt)
        fs, root = self._root()
        first = next((b for b in batches if len(b)), None)
        if first is None:
            return None
        fs.create_dir(f"{root}/{name}".rpartition("/")[0], recursive=True)
        with fs.open_output_stream(f"{root}/{name}") as out:
            if name.endswith(".parquet"):
                with pq.ParquetWriter(out, first.schema) as writer:
                    writer.write_batch(first)
                    for b in batches:
                        writer.write_batch(b)
            else:
                _write_lines(out, first)
                for b in batches:
                    _write_lines(out, b)
        return name

    def commit(self, messages: list[str | None]) -> dict:
        kept = {m for m in messages if m is not None}
        digits = dict.fromkeys(NAME_FIELDS, "[0-9]+")
        fits = re.compile("".join(re.escape(text) + (digits[f] if f is not None else "") for text, f, _, _ in string.Formatter().parse(self.template)))
        fs, root = self._root()
        for info in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True, recursive=True)):
            name = info.path[len(root) :].lstrip("/")
            if info.type == pafs.FileType.File and name not in kept and fits.fullmatch(name):
                fs.delete_file(info.path)
        return {"output": self.output, "files": sorted(kept)}


def _write_lines(out: pa.NativeFile, batch: pa.RecordBatch) -> None:
    for row in batch.to_pylist():
        out.write(json.dumps(row, default=str).encode() + b"\n")
