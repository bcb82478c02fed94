"""Robot logs: messages as rows, and episodes aligned by the operators of ``align``."""

from __future__ import annotations

import io
import re
import struct
import zlib
from collections.abc import Iterator, Mapping, Sequence
from typing import Any, BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators import align
from millrace.plans.dataset import Dataset
from millrace.shared import checkpointed
from millrace.sources.blobs import BATCH_BYTES, BATCH_ROWS, from_streams

#: The file magic and the record codes that are read.
MAGIC = b"\x89MCAP0\r\n"
SCHEMA, CHANNEL, MESSAGE, CHUNK = 0x03, 0x04, 0x05, 0x06


def _text(b: bytes, at: int) -> tuple[str, int]:
    (n,) = struct.unpack_from("<I", b, at)
    return bytes(b[at + 4 : at + 4 + n]).decode(), at + 4 + n


def messages(f: BinaryIO) -> Iterator[tuple[str, int, int, str, bytes]]:
    """(topic, sequence, log time in ns, encoding, payload) of all messages, in file order; a chunk is held at a time."""
    if f.read(8) != MAGIC:
        raise ValueError("not a log of this format")
    yield from _records(f, {})


def _records(f: BinaryIO, channels: dict[int, tuple[str, str]]) -> Iterator[tuple[str, int, int, str, bytes]]:
    while len(head := f.read(9)) == 9 and head[:8] != MAGIC:
        code, size = struct.unpack("<BQ", head)
        body = f.read(size)
        if len(body) < size:
            raise EOFError("a record is cut off")
        if code == CHANNEL:
            (number,) = struct.unpack_from("<H", body, 0)
            topic, where = _text(body, 4)
            channels[number] = (topic, _text(body, where)[0])
        elif code == MESSAGE:
            number, sequence, log_time, _ = struct.unpack_from("<HIQQ", body, 0)
            topic, encoding = channels[number]
            yield topic, sequence, log_time, encoding, body[22:]
        elif code == CHUNK:
            plain_size = struct.unpack_from("<Q", body, 16)[0]
            kind, where = _text(body, 28)
            (n,) = struct.unpack_from("<Q", body, where)
            raw = body[where + 8 : where + 8 + n]
            if kind == "zstd":
                import zstandard

                raw = zstandard.ZstdDecompressor().decompress(raw, max_output_size=plain_size)
            elif kind == "lz4":
                raw = pa.Codec("lz4").decompress(raw, plain_size).to_pybytes()
            elif kind == "zlib":
                raw = zlib.decompress(raw)
            elif kind:
                raise ValueError(f"compression {kind} is not supported")
            yield from _records(io.BytesIO(raw), channels)


def read_messages(spark: SparkSession, inputs: str | Sequence[str]) -> DataFrame:
    """(file_path, topic, seq, log_time, encoding, data): ``seq`` is the place in the file. Files are read as streams."""
    names = ["file_path", "topic", "seq", "log_time", "encoding", "data"]

    def run(path: str, f: BinaryIO) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for i, (t, _, at, e, p) in enumerate(messages(f)):
            held.append((path, t, i, at, e, p))
            size += len(p)
            if len(held) >= BATCH_ROWS or size >= BATCH_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*held, strict=True)], names)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*held, strict=True)], names)

    return from_streams(spark, inputs, run, "file_path string, topic string, seq long, log_time long, encoding string, data binary")


def split_source(source: str, topics: Sequence[str]) -> tuple[str, list[str]]:
    """The topic of a dotted source, the longest that fits, and the fields inside its messages."""
    if source in topics:
        return source, []
    fits = [t for t in topics if source.startswith(t + ".")]
    if not fits:
        raise KeyError(source)
    topic = max(fits, key=len)
    return topic, source[len(topic) + 1 :].split(".")


def _leaves(t: T.DataType, name: str) -> Iterator[tuple[str, T.DataType]]:
    """The names and types inside a message that are no objects themselves, but for empty ones."""
    if isinstance(t, T.StructType) and t.fields:
        for f in sorted(t.fields, key=lambda f: f.name):
            yield from _leaves(f.dataType, f"{name}.{f.name}")
    else:
        yield name, T.StringType() if isinstance(t, T.StructType | T.NullType | T.VariantType) else t


def default_fields(log: DataFrame, marker: str | None = None) -> dict[str, tuple[str, str]]:
    """All fields of all topics but the marker's, each under its dotted source, with the type that all messages share.

    Numbers with a fraction are doubles; what has no type of its own, or several, is a string of JSON.
    """
    kinds = log.groupBy("topic").agg(F.schema_of_variant_agg(F.parse_json(F.col("data").cast("string"))).alias("kind"))
    out = {}
    for topic, kind in sorted(tuple(r) for r in kinds.collect()):  # bounded: channels of a robot
        if topic != marker:
            plain = re.sub(r"\bDECIMAL\(\d+, ?\d+\)", "DOUBLE", kind).replace("OBJECT<", "STRUCT<")
            plain = re.sub(r"\b(VOID|VARIANT)\b(?!:)", "STRING", plain)
            out |= {n: (n, t.simpleString()) for n, t in _leaves(T._parse_datatype_string(plain), topic)}
    return out


def read_mcap(spark: SparkSession, inputs: str | Sequence[str], fields: Mapping[str, tuple[str, str]] | None = None, sync_primary: str | None = None, sync_method: str = "nearest", include_skew: bool = False, gap_s: float | None = None, marker: str | None = None) -> Dataset:
    """One row an event of the primary field, or of any field without one, in its episode.

    ``fields`` maps a column to (dotted source, type), as ("/joints.q", "array<double>"), read from
    JSON payloads; without it all fields of all topics are columns. Episodes begin after gaps of
    more than ``gap_s`` seconds over all topics or at messages of the topic ``marker``; what stands
    before the first marker is left out. The logs are decoded for their topics and once more
    for all fields together, whose values are then kept in the shared folder.
    """
    log = read_messages(spark, inputs)
    if fields is None:
        fields = default_fields(log, marker)
    topics = [r["topic"] for r in log.select("topic").distinct().collect()]  # bounded: channels of a robot
    names = {n: f"v{i}" for i, n in enumerate(fields)}

    def of_message(source: str, kind: str):
        """A struct with the field's value, null in messages that have none."""
        topic, path = split_source(source, topics)
        value = F.get_json_object(F.col("data").cast("string"), "$" + "".join(f".{p}" for p in path))
        typed = F.from_json(value, kind) if kind.startswith(("array", "struct", "map")) else value.cast(kind)
        return F.when((F.col("topic") == topic) & value.isNotNull(), F.struct(typed.alias("v")))

    key = ["file_path"]
    log = log.select(*key, "topic", "seq", "log_time", *(of_message(*fields[n]).alias(v) for n, v in names.items()))
    if gap_s is not None:
        log = align.gap_sessions(log, key, "log_time", int(gap_s * 1e9), ["seq"], "episode")
    elif marker is not None:
        log = align.marker_sessions(log, key, "log_time", F.col("topic") == marker, "episode")
    else:
        log = log.withColumn("episode", F.lit(0).cast("bigint"))
    log = checkpointed(log)
    key = [*key, "episode"]

    def of(name: str) -> DataFrame:
        return log.filter(F.col(names[name]).isNotNull()).select(*key, F.col("log_time").alias("ts"), "seq", F.col(f"{names[name]}.v").alias("v"))

    if sync_primary is None:
        out = align.sparse_outer({names[n]: of(n) for n in fields}, key, "ts", "seq", "v")
        return Dataset(out.withColumnsRenamed({v: n for n, v in names.items()}), (("read_mcap", "sparse"),))
    out, renamed = of(sync_primary).withColumnRenamed("v", names[sync_primary]), {v: n for n, v in names.items()}
    for name, v in names.items():
        if name != sync_primary:
            events = of(name).select(*key, "ts", F.col("v").alias(v), "seq")
            out = align.asof(out, events, key, "ts", [v], "seq", sync_method)
            if include_skew:
                out = out.withColumns({f"{v}_at": F.col(f"{v}_ts") / 1e9, f"{v}_skew": (F.col(f"{v}_ts") - F.col("ts")) / 1e6})
                renamed |= {f"{v}_at": f"mcap.{name}.timestamp", f"{v}_skew": f"mcap.{name}.skew_ms"}
            out = out.drop(f"{v}_ts")
    out = align.numbered(out, key, ["ts", "seq"], "frame_index").withColumn("timestamp", F.col("ts") / 1e9)
    return Dataset(out.drop("seq").withColumnsRenamed(renamed), (("read_mcap", sync_method),))
