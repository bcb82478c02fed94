"""Text, Parquet and whole files, by Spark's own readers: splits, pushdown and pruning are theirs."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.expr import RESERVED, Expr, lower
from millrace.functions.types import apply_dtypes, asset
from millrace.plans.dataset import Dataset
from millrace.shared import scratch

Inputs = str | Sequence[str]


def _paths(inputs: Inputs) -> list[str]:
    paths = [inputs] if isinstance(inputs, str) else list(inputs)
    if not paths:
        raise ValueError("no inputs")
    return paths


def _is_dir(spark: SparkSession, path: str) -> bool:
    if any(c in path for c in "*?[{"):
        return False
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).isDirectory(p)


def _load(spark: SparkSession, fmt: str, inputs: Inputs, suffixes: Sequence[str], schema: T.StructType | None = None, **options: Any) -> DataFrame:
    """Files in their order; the suffix filter holds for directories only, never for named files or globs."""
    found = []
    for path in _paths(inputs):
        reader = spark.read.format(fmt).options(**options)
        if suffixes and _is_dir(spark, path):
            reader = reader.option("recursiveFileLookup", True).option("pathGlobFilter", "{" + ",".join(f"*{s}" for s in suffixes) + "}" if len(suffixes) > 1 else f"*{suffixes[0]}")
        found.append((reader.schema(schema) if schema is not None else reader).load(path))
    if len(found) > 1 and fmt != "binaryFile":  # a union hides where its rows come from
        found = [df.select("*", "_metadata") for df in found]
    out = found[0]
    for df in found[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def _finish(df: DataFrame, name: str, file_path_column: str | None, dtypes: Mapping[str, Any] | None, identity: bool, indexed: bool = False) -> Dataset:
    """The path column unless the data has it, the identity columns if asked for, and dtypes."""
    new = []
    if file_path_column and file_path_column not in df.columns:
        new.append(F.col("_metadata.file_path").alias(file_path_column))
    if identity:
        block = F.concat_ws(":", "_metadata.file_path", F.col("_metadata.file_block_start").cast("string"))
        new.append(F.substring(F.sha2(block, 256), 1, 12).alias(RESERVED[0]))
        new.append((F.col("_metadata.row_index") if indexed else F.lit(None).cast("bigint")).alias(RESERVED[1]))
    if new:
        df = df.select("*", *new)
    df = df.drop("_metadata") if "_metadata" in df.columns else df
    return Dataset(apply_dtypes(df, dtypes, strict=False), ((name, None),))


def read_parquet(spark: SparkSession, inputs: Inputs, columns: Sequence[str] | None = None, filter: Expr | None = None, file_path_column: str | None = "file_path", dtypes: Mapping[str, Any] | None = None, identity: bool = False) -> Dataset:  # noqa: A002
    """Parquet with a projection and a filter that reach the scan.

    The filter sees columns after ``dtypes``, and may use some that the projection leaves out. The
    synthetic path column cannot be asked for by name.
    """
    if columns is not None and file_path_column in columns:
        raise ValueError(f"{file_path_column} is added by the reader")
    out = _finish(_load(spark, "parquet", inputs, (".parquet", ".pq")), "read_parquet", file_path_column, dtypes, identity, indexed=True)
    df = out.df
    if filter is not None:
        df = df.filter(lower(filter, df.schema))
    if columns is not None:
        missing = [c for c in columns if c not in df.columns]
        if missing:
            raise KeyError(missing[0])
        extra = [c for c in (file_path_column, *RESERVED) if c in df.columns and c not in columns]
        df = df.select(*(F.col(f"`{c}`") for c in [*columns, *extra]))
    return Dataset(df, out.steps)


def read_csv(spark: SparkSession, inputs: Inputs, multiline_rows: bool = False, encoding: str = "UTF-8", file_path_column: str | None = "file_path", dtypes: Mapping[str, Any] | None = None, identity: bool = False) -> Dataset:
    """CSV with a header line. Types are inferred once over all files; with ``multiline_rows`` all are strings."""
    df = _load(spark, "csv", inputs, (".csv", ".csv.gz"), header=True, inferSchema=not multiline_rows, multiLine=multiline_rows, encoding=encoding, quote='"', escape='"')
    return _finish(df, "read_csv", file_path_column, dtypes, identity)


def read_jsonl(spark: SparkSession, inputs: Inputs, file_path_column: str | None = "file_path", dtypes: Mapping[str, Any] | None = None, schema: T.StructType | None = None, identity: bool = False) -> Dataset:
    """One JSON object a line; a line that is none is an error."""
    df = _load(spark, "json", inputs, (".jsonl", ".ndjson", ".jsonl.gz", ".json", ".json.gz"), schema, mode="FAILFAST")
    return _finish(df, "read_jsonl", file_path_column, dtypes, identity)


def read_json(spark: SparkSession, inputs: Inputs, lines: bool = False, file_path_column: str | None = "file_path", dtypes: Mapping[str, Any] | None = None, schema: T.StructType | None = None) -> Dataset:
    """Each file is one object, an array of objects, or lines of objects; with ``lines`` all are lines.

    A file that is none of them is an error. Without a schema the objects are written to the
    shared folder first, so that Spark's reader finds their types over all files.
    """
    if lines:
        return read_jsonl(spark, inputs, file_path_column, dtypes, schema)
    files = _load(spark, "text", inputs, (".json", ".json.gz", ".jsonl", ".ndjson"), wholetext=True).select(F.col("_metadata.file_path").alias("__path"), F.trim("value").alias("__text"))
    whole = F.col("__text")
    rows = F.filter(F.split(whole, "\n"), lambda x: F.trim(x) != "")
    is_object = lambda x: F.coalesce(F.ltrim(F.get_json_object(x, "$")).startswith("{"), F.lit(False))
    found = F.when(whole.startswith("["), F.from_json(whole, "array<string>")).when(is_object(F.get(rows, F.lit(0))), rows).when(is_object(whole), F.array(whole))
    wrong = F.raise_error(F.concat(F.lit("no JSON object, array or lines in "), F.col("__path"))).cast("array<string>")
    objects = files.filter(whole != "").select("__path", F.explode(F.coalesce(found, wrong)).alias("__text"))
    objects = objects.withColumn("__text", F.when(is_object(F.col("__text")), F.col("__text")).otherwise(F.raise_error(F.concat(F.lit("a row is no object in "), F.col("__path"))).cast("string")))
    if schema is None:
        held = scratch(spark)
        objects.select(F.translate("__text", "\r\n", "  ").alias("value")).write.text(held)
        schema = spark.read.json(held).schema
    df = objects.select("__path", F.from_json("__text", schema, {"mode": "FAILFAST"}).alias("__row")).select("__row.*", *([F.col("__path").alias(file_path_column)] if file_path_column and file_path_column not in schema.names else []))
    return Dataset(apply_dtypes(df, dtypes, strict=False), (("read_json", None),))


def read_files(spark: SparkSession, inputs: Inputs, content_column: str | None = None, size_column: str | None = "size", path_column: str = "file_path", decode_fn: Callable[[bytes], Any] | None = None, dtypes: Mapping[str, Any] | None = None) -> Dataset:
    """One row a file. Contents are read only where ``content_column`` asks for them."""
    df = _load(spark, "binaryFile", inputs, ())
    columns = [F.col("path").alias(path_column)]
    if size_column:
        columns.append(F.col("length").alias(size_column))
    if content_column or decode_fn:
        columns.append(F.col("content").alias(content_column or "content"))
    out = Dataset(df.select(*columns), (("read_files", None),))
    if decode_fn is None:
        return out
    name = content_column or "content"
    return out.map(lambda row: {name: decode_fn(row[name])}, dtypes=dtypes)


def read_videos(spark: SparkSession, inputs: Inputs, column: str = "video_path") -> Dataset:
    """Paths of videos, in a column that is marked as one of videos."""
    df = read_files(spark, inputs, size_column=None, path_column=column).df
    return Dataset(df.select(F.col(column).alias(column, metadata=asset("video").metadata)), (("read_videos", None),))
