"""Web archives: dense scans of archive files, and ranged fetches by an index."""

from __future__ import annotations

import gzip
import io
from collections.abc import Callable, Iterator, Sequence
from typing import Any, BinaryIO

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.expr import Expr, col, lower
from millrace.plans.dataset import Dataset
from millrace.plans.row import Row
from millrace.sources.blobs import BATCH_BYTES, from_streams, read_blob


def filter_html() -> Expr:
    return (col("content_mime_type") == "text/html") | (col("content_mime_detected") == "text/html")


def filter_pdf() -> Expr:
    return (col("content_mime_type") == "application/pdf") | (col("content_mime_detected") == "application/pdf")


def filter_truncated() -> Expr:
    return col("content_truncated").is_not_null()


def filter_not_truncated() -> Expr:
    return col("content_truncated").is_null()


def filter_domain_suffixes(*suffixes: str) -> Expr:
    if not suffixes:
        raise ValueError("no suffixes")
    return col("url_host_registry_suffix").is_in(suffixes)


def _head(f: io.BufferedIOBase) -> dict[str, Any]:
    """Header fields up to the empty line; a name that comes again has a list."""
    out: dict[str, Any] = {}
    while (line := f.readline()) not in (b"\r\n", b"\n", b""):
        name, _, value = line.decode("utf-8", "replace").partition(":")
        name, value = name.strip().lower(), value.strip()
        if name in out:
            out[name] = [*(out[name] if isinstance(out[name], list) else [out[name]]), value]
        else:
            out[name] = value
    return out


def records(f: io.BufferedIOBase, kinds: Sequence[str] = ("response", "conversion")) -> Iterator[dict[str, Any]]:
    """Records of an archive: ``headers``, ``http_status``, ``http_headers``, ``body``."""
    while line := f.readline():
        if not line.startswith(b"WARC/"):
            continue
        headers = _head(f)
        payload = f.read(int(headers.get("content-length", 0)))
        if headers.get("warc-type") not in kinds:
            continue
        out: dict[str, Any] = {"headers": headers, "http_status": None, "http_headers": {}, "body": payload}
        if headers.get("warc-type") == "response" and payload.startswith(b"HTTP/"):
            inner = io.BytesIO(payload)
            status = inner.readline().decode("utf-8", "replace").split(" ", 2)
            out |= {"http_status": int(status[1]) if len(status) > 1 and status[1].isdigit() else None, "http_headers": _head(inner), "body": inner.read()}
        yield out


_RECORD = T.StructType([
    T.StructField("url", T.StringType()),
    T.StructField("date", T.StringType()),
    T.StructField("record_id", T.StringType()),
    T.StructField("record_type", T.StringType()),
    T.StructField("http_status", T.IntegerType()),
    T.StructField("headers", T.MapType(T.StringType(), T.ArrayType(T.StringType()))),
    T.StructField("http_headers", T.MapType(T.StringType(), T.ArrayType(T.StringType()))),
    T.StructField("content", T.BinaryType()),
    T.StructField("text", T.StringType()),
])


def _lists(headers: dict[str, Any]) -> list[tuple[str, list[str]]]:
    return [(k, v if isinstance(v, list) else [v]) for k, v in headers.items()]


def _row(r: dict[str, Any]) -> dict[str, Any]:
    h = r["headers"]
    wet = h.get("warc-type") == "conversion"
    return {"url": h.get("warc-target-uri"), "date": h.get("warc-date"), "record_id": h.get("warc-record-id"), "record_type": h.get("warc-type"), "http_status": r["http_status"], "headers": _lists(h), "http_headers": _lists(r["http_headers"]), "content": None if wet else r["body"], "text": r["body"].decode("utf-8", "replace") if wet else None}


#: The root of the public archives, and the ends of the names of their files.
CRAWL_ROOT, SUFFIXES = "s3://commoncrawl", {"warc": ".warc.gz", "wet": ".warc.wet.gz"}


def archive_paths(spark: SparkSession, dumps: str | Sequence[str], archive_format: str = "warc", segments: str | Sequence[str] | None = None, num_files: int | None = None, root: str = CRAWL_ROOT) -> list[str]:
    """Globs of the archives of whole dumps, or of some segments; with ``num_files`` the first files by path."""
    if archive_format not in SUFFIXES:
        raise ValueError(f"format {archive_format!r} is none of {', '.join(SUFFIXES)}")
    if num_files is not None and num_files <= 0:
        raise ValueError("num_files must be positive")
    dumps, segments = ([x] if isinstance(x, str) else list(x or ()) for x in (dumps, segments))
    if not dumps:
        raise ValueError("no dumps")
    globs = [f"{root.rstrip('/')}/crawl-data/{d}/segments/{s}/{archive_format}/*{SUFFIXES[archive_format]}" for d in dumps for s in segments or ["*"]]
    if num_files is None:
        return globs
    found = []
    for g in globs:
        path = spark._jvm.org.apache.hadoop.fs.Path(g)
        found += [str(f.getPath()) for f in path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or ()]
    if not found:
        raise FileNotFoundError(globs[0])
    return sorted(set(found))[:num_files]


def read_commoncrawl(spark: SparkSession, inputs: str | Sequence[str] | None = None, output_fields: Sequence[str] | None = None, dumps: str | Sequence[str] | None = None, archive_format: str = "warc", segments: str | Sequence[str] | None = None, num_files: int | None = None, root: str = CRAWL_ROOT, file_path_column: str | None = None) -> Dataset:
    """All response and conversion records of the archives (WARC or WET, plain or gzip), read as streams.

    The archives are those at ``inputs``, or those of ``dumps`` under ``root``. Header names are
    lower case and have a list of values, for those that come again. ``output_fields`` names
    columns, or headers of the archive or else of the response in any case, of which the first value is
    given, null where there is none.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    if (inputs is None) == (dumps is None):
        raise ValueError("either inputs or dumps")
    if inputs is None:
        inputs = archive_paths(spark, dumps, archive_format, segments, num_files, root)
    schema = T.StructType([*_RECORD, T.StructField("__path", T.StringType())])
    arrow = to_arrow_schema(schema)

    def run(path: str, raw: BinaryIO) -> Iterator[pa.RecordBatch]:
        f = io.BufferedReader(gzip.GzipFile(fileobj=raw)) if raw.peek(2)[:2] == b"\x1f\x8b" else raw
        held: list[dict] = []
        size = 0
        for r in records(f):
            held.append(_row(r) | {"__path": path})
            size += len(r["body"])
            if len(held) >= 64 or size >= BATCH_BYTES:
                yield pa.RecordBatch.from_pylist(held, schema=arrow)
                held, size = [], 0
        yield pa.RecordBatch.from_pylist(held, schema=arrow)

    def first(name: str):
        if name in _RECORD.names:
            return F.col(name)
        return F.coalesce(*(F.get(F.col(h)[name.lower()], F.lit(0)) for h in ("headers", "http_headers"))).alias(name)

    df = from_streams(spark, inputs, run, schema)
    path = [F.col("__path").alias(file_path_column)] if file_path_column else []
    return Dataset(df.select(*map(first, output_fields or _RECORD.names), *path), (("read_commoncrawl", None),))


def read_commoncrawl_from_index(spark: SparkSession, index: str | Sequence[str], root: str, filter: Expr | None = None, filter_fn: Callable[[Row], bool] | None = None, parallelism: int | None = None) -> Dataset:  # noqa: A002
    """Records that the rows of a Parquet index name, fetched by byte range.

    The filter reaches the index scan, which reads five columns unless ``filter_fn`` needs all.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    from millrace.sources.tabular import read_parquet

    rows = read_parquet(spark, index, file_path_column=None)
    if filter is not None:
        rows = Dataset(rows.df.filter(lower(filter, rows.df.schema)), rows.steps)
    if filter_fn is not None:
        rows = rows.filter(filter_fn)
    places = rows.df.select("url", "warc_filename", F.col("warc_record_offset").cast("bigint").alias("offset"), F.col("warc_record_length").cast("bigint").alias("length"))
    if parallelism:
        places = places.repartition(parallelism)
    arrow = to_arrow_schema(_RECORD)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                data = read_blob({"path": f"{root.rstrip('/')}/{r['warc_filename']}", "offset": r["offset"], "size": r["length"]})
                f = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(data))) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)
                yield pa.RecordBatch.from_pylist([_row(x) for x in records(f)], schema=arrow)

    return Dataset(places.mapInArrow(run, _RECORD), (("read_commoncrawl_from_index", None),))
