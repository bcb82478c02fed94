"""Data types: constructors, names, and media columns marked by field metadata."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_type

null, bool_, string, large_string, binary, large_binary = T.NullType, T.BooleanType, T.StringType, T.StringType, T.BinaryType, T.BinaryType
int8, int16, int32, int64 = T.ByteType, T.ShortType, T.IntegerType, T.LongType
uint8, uint16, uint32 = T.ShortType, T.IntegerType, T.LongType
float32, float64, date = T.FloatType, T.DoubleType, T.DateType


def uint64() -> T.DataType:
    return T.DecimalType(20, 0)


def duration(unit: str = "us") -> T.DataType:
    """Spark reads durations of Arrow files as whole numbers of their unit."""
    return T.LongType()


def time(unit: str = "us") -> T.DataType:
    return T.LongType()


def timestamp(unit: str = "us", tz: str | None = None) -> T.DataType:
    return T.TimestampType() if tz else T.TimestampNTZType()


def list_(element: Any, size: int | None = None) -> T.ArrayType:
    return T.ArrayType(dtype(element))


large_list = list_


def struct(fields: Mapping[str, Any] | Sequence[tuple[str, Any]]) -> T.StructType:
    pairs = fields.items() if isinstance(fields, Mapping) else fields
    return T.StructType([T.StructField(n, dtype(t)) for n, t in pairs])


def map_(key: Any, value: Any) -> T.MapType:
    return T.MapType(dtype(key), dtype(value))


#: Kinds of media and how a column may store them.
ASSETS = ("file", "image", "audio", "video", "pdf")
BLOB = T.StructType([T.StructField("path", T.StringType(), False), T.StructField("offset", T.LongType(), False), T.StructField("size", T.LongType(), False)])
BYTES_WITH_PATH = T.StructType([T.StructField("bytes", T.BinaryType()), T.StructField("path", T.StringType())])
FRAMES = T.ArrayType(T.ArrayType(T.ArrayType(T.ArrayType(T.ShortType()))))


def asset(kind: str = "file", storage: str = "path") -> T.StructField:
    """A nameless field of a media column; give it where a dtype is asked for."""
    if kind not in ASSETS:
        raise ValueError(f"no asset kind {kind}")
    kinds = {"path": T.StringType(), "bytes": T.BinaryType(), "bytes_with_path": BYTES_WITH_PATH, "blob_reference": BLOB, "frame_array": FRAMES}
    return T.StructField("", kinds[storage], True, {"asset_type": kind})


def blob_reference(kind: str = "file") -> T.StructField:
    return asset(kind, "blob_reference")


def video_frame_array() -> T.StructField:
    return asset("video", "frame_array")


def _plain(t: T.DataType) -> T.DataType:
    """The type without nullability, for comparison."""
    if isinstance(t, T.StructType):
        return T.StructType([T.StructField(f.name, _plain(f.dataType)) for f in t])
    if isinstance(t, T.ArrayType):
        return T.ArrayType(_plain(t.elementType))
    return t


def asset_storage(field: T.StructField) -> str | None:
    """How a media column stores its values; None for other columns."""
    if "asset_type" not in field.metadata:
        return None
    t = _plain(field.dataType)
    known = {"path": T.StringType(), "bytes": T.BinaryType(), "bytes_with_path": BYTES_WITH_PATH, "blob_reference": BLOB, "frame_array": FRAMES}
    return next((k for k, v in known.items() if t == _plain(v)), None)


def dtype(value: Any) -> T.DataType:
    """A Spark type from a type, a field, an Arrow type or alias, or a DDL string."""
    if isinstance(value, T.StructField):
        return value.dataType
    if isinstance(value, T.DataType):
        return value
    if isinstance(value, type) and issubclass(value, T.DataType):
        return value()
    if isinstance(value, (pa.DataType, pa.Field)):
        return from_arrow_type(value.type if isinstance(value, pa.Field) else value)
    aliases = {"bool": T.BooleanType, "int8": T.ByteType, "int16": T.ShortType, "int32": T.IntegerType, "int64": T.LongType, "uint8": T.ShortType, "uint16": T.IntegerType, "uint32": T.LongType, "float32": T.FloatType, "float64": T.DoubleType, "float": T.FloatType, "double": T.DoubleType, "string": T.StringType, "utf8": T.StringType, "binary": T.BinaryType, "date32": T.DateType}
    if value in aliases:
        return aliases[value]()
    if value == "uint64":
        return uint64()
    return T._parse_datatype_string(value)


def field(name: str, value: Any) -> T.StructField:
    metadata = value.metadata if isinstance(value, T.StructField) else {k.decode(): v.decode() for k, v in (value.metadata or {}).items()} if isinstance(value, pa.Field) else {}
    return T.StructField(name, dtype(value), True, metadata)


def schema_with_dtypes(schema: T.StructType, dtypes: Mapping[str, Any] | None) -> T.StructType:
    """``schema`` with the types of ``dtypes``; names it does not have are appended."""
    new = {n: field(n, t) for n, t in (dtypes or {}).items()}
    out = [new.pop(f.name, f) for f in schema]
    return T.StructType([*out, *new.values()])


def safe_cast(c: Column, source: T.DataType, target: T.DataType, name: str) -> Column:
    """A cast that fails where a value would change: fractions, overflow, unparsable text."""
    whole = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
    if isinstance(source, (T.FloatType, T.DoubleType, T.DecimalType)) and isinstance(target, whole):
        lossy = c.isNotNull() & (c != F.floor(c))
        return F.when(lossy, F.raise_error(F.concat(F.lit(f"{name}: "), c.cast("string"), F.lit(" has a fraction")))).otherwise(c.cast(target))
    return c.cast(target)


def apply_dtypes(df: DataFrame, dtypes: Mapping[str, Any] | None, strict: bool = True) -> DataFrame:
    """``df`` with columns cast; an unknown name is an error if ``strict``."""
    for name, t in (dtypes or {}).items():
        if name not in df.columns:
            if strict:
                raise KeyError(name)
            continue
        new = field(name, t)
        cast = safe_cast(F.col(f"`{name}`"), df.schema[name].dataType, new.dataType, name)
        df = df.withColumn(name, cast.alias(name, metadata=new.metadata) if new.metadata else cast)
    return df
