"""Record files of serialised examples, decoded without other libraries."""

from __future__ import annotations

import gzip
import io
import struct
import zlib
from collections.abc import Iterator, Mapping, Sequence
from typing import Any, BinaryIO

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from millrace.functions.types import field
from millrace.plans.dataset import Dataset
from millrace.sources.blobs import BATCH_BYTES, BATCH_ROWS, from_streams


def _varint(b: memoryview, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        x = b[at]
        at += 1
        out |= (x & 0x7F) << shift
        if x < 0x80:
            return out, at
        shift += 7


def fields(b: memoryview) -> Iterator[tuple[int, Any]]:
    """(number, value) of the fields of a message in wire format."""
    at = 0
    while at < len(b):
        tag, at = _varint(b, at)
        number, wire = tag >> 3, tag & 7
        if wire == 0:
            value, at = _varint(b, at)
        elif wire == 2:
            size, at = _varint(b, at)
            value, at = b[at : at + size], at + size
        elif wire in (1, 5):
            size = 8 if wire == 1 else 4
            value, at = b[at : at + size], at + size
        else:
            raise ValueError(f"wire type {wire}")
        yield number, value


def _values(feature: memoryview) -> list:
    """The list of a feature: bytes (1), floats (2) or whole numbers (3), packed or not."""
    for kind, body in fields(feature):
        out: list = []
        for _, v in fields(body):
            if kind == 1:
                out.append(bytes(v))
            elif kind == 2:
                out += struct.unpack(f"<{len(v) // 4}f", v)
            elif isinstance(v, int):
                out.append(v - (1 << 64) if v >= 1 << 63 else v)
            else:
                at = 0
                while at < len(v):
                    x, at = _varint(v, at)
                    out.append(x - (1 << 64) if x >= 1 << 63 else x)
        return out
    return []


def example(data: bytes) -> dict[str, list]:
    out = {}
    for _, features in fields(memoryview(data)):
        for _, entry in fields(features):
            pair = dict(fields(entry))
            out[bytes(pair[1]).decode()] = _values(pair.get(2, memoryview(b"")))
    return out


class _Inflated(io.RawIOBase):
    """What a zlib stream holds."""

    def __init__(self, f: BinaryIO):
        self.f, self.z = f, zlib.decompressobj()

    def readable(self) -> bool:
        return True

    def readinto(self, out) -> int:
        got = b""
        while not got and not self.z.eof:
            data = self.z.unconsumed_tail or self.f.read(1 << 16)
            if not data:
                raise EOFError("a compressed file is cut off")
            got = self.z.decompress(data, len(out))
        out[: len(got)] = got
        return len(got)


def _packed(head: bytes) -> str:
    """How a file that begins so is compressed. A plain one begins with the size of a record, whose upper half is 0."""
    if head[:3] == b"\x1f\x8b\x08":
        return "gzip"
    if head[:1] == b"\x78" and len(head) > 2 and not (head[0] << 8 | head[1]) % 31 and head[4:8] != bytes(4):
        return "zlib"
    return "none"


def payloads(f: BinaryIO, compression: str = "auto") -> Iterator[bytes]:
    """The records of a file, one held at a time."""
    f = io.BufferedReader(f)
    if compression == "auto":
        compression = _packed(f.peek(8)[:8])
    if compression == "gzip":
        f = gzip.GzipFile(fileobj=f)
    elif compression == "zlib":
        f = io.BufferedReader(_Inflated(f))
    while head := f.read(12):
        if len(head) == 12:
            (size,) = struct.unpack_from("<Q", head)
            body = f.read(size + 4)
        if len(head) < 12 or len(body) < size + 4:
            raise EOFError("a record is cut off")
        yield body[:size]


def read_tfrecords(spark: SparkSession, inputs: str | Sequence[str], features: Mapping[str, Any], compression: str = "auto") -> Dataset:
    """Examples with the declared features; a type that is no array takes the first value, a missing one is null. Files are read as streams."""
    schema = T.StructType([field(n, t) for n, t in features.items()])
    arrow = to_arrow_schema(schema)

    def value(x: list | None, t: T.DataType) -> Any:
        if x is None:
            return None
        inner = t.elementType if isinstance(t, T.ArrayType) else t
        if isinstance(inner, T.StringType):
            x = [v.decode("utf-8", "replace") if isinstance(v, bytes) else v for v in x]
        return x if isinstance(t, T.ArrayType) else x[0] if x else None

    def run(_: str, f: BinaryIO) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        size = 0
        for p in payloads(f, compression):
            r = example(p)
            held.append({x.name: value(r.get(x.name), x.dataType) for x in schema})
            size += len(p)
            if len(held) >= BATCH_ROWS or size >= BATCH_BYTES:
                yield pa.RecordBatch.from_pylist(held, schema=arrow)
                held, size = [], 0
        yield pa.RecordBatch.from_pylist(held, schema=arrow)

    return Dataset(from_streams(spark, inputs, run, schema), (("read_tfrecords", None),))
