"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import hashlib
import inspect
import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker holds at a time.
SLICE_BYTES = 8 << 20
#: Bytes of an Arrow batch that goes to a Python worker, and the setting that bounds it.
BATCH_BYTES, BATCH_CONF = 8 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"
#: Text bytes aimed at for one unit of shuffled work.
UNIT_BYTES = 8 << 20
#: Largest bytes that any operator here broadcasts; beyond it each has another way.
BROADCAST_BYTES = 64 << 20


def release() -> None:
    """Gives freed memory of this Python worker back, as workers are kept for tasks of other operators."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def frugal(run: Callable) -> Callable:
    """``run``, a function of batches or of tables, with :func:`release` when it ends."""

    def batches(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(given)
        finally:
            release()

    def table(rows: pa.Table) -> pa.Table:
        try:
            return run(rows)
        finally:
            release()

    def tables(left: pa.Table, right: pa.Table) -> pa.Table:
        try:
            return run(left, right)
        finally:
            release()

    return batches if inspect.isgeneratorfunction(run) else table if len(inspect.signature(run).parameters) == 1 else tables


def mapped(df: DataFrame, run: Callable, schema) -> DataFrame:
    """``df.mapInArrow(frugal(run), schema)`` over batches of about ``BATCH_BYTES``.

    Spark's own bound on a batch is in rows, and long texts make that many times larger in the
    JVM and in the worker. The session's setting stays where it is set.
    """
    conf = df.sparkSession.conf
    if not set_by_user(df.sparkSession, BATCH_CONF):
        conf.set(BATCH_CONF, str(BATCH_BYTES))
    return df.mapInArrow(frugal(run), schema)


def set_by_user(spark: SparkSession, name: str) -> bool:
    given = spark.sparkContext.getConf().get(name, "") or spark.conf.getAll.get(name, "")
    return given not in ("", str(BATCH_BYTES))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sliced(texts: pa.ChunkedArray | pa.Array, limit: int = SLICE_BYTES):
    """(start, end) row ranges of about ``limit`` bytes, at least one row each."""
    n = len(texts)
    if not n:
        return
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    start, held = 0, 0
    for i, s in enumerate(sizes):
        if i > start and held + s > limit:
            yield start, i
            start, held = i, 0
        held += s
    yield start, n


def plan_bytes(df: DataFrame) -> int:
    """Bytes the optimizer expects of ``df``; 0 where it has no usable figure."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 55 else 0


def units(df: DataFrame, unit_bytes: int = UNIT_BYTES, least: int = 8) -> int:
    """How many units of about ``unit_bytes`` the rows of ``df`` make.

    The figure grows with the input and steers only how work is dealt out, never the
    result; where the plan has no size, rows and text bytes are counted.
    """
    size = plan_bytes(df)
    if not size:
        size = int(df.select(F.sum(F.length(F.coalesce("text", F.lit(""))))).first()[0] or 0)
    return max(least, math.ceil(size * 2 / unit_bytes))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Where the setting is absent, as in tests on one machine, a folder under the
    warehouse is used.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", "") or spark.conf.get("spark.checkpoint.dir", "")
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/checkpoints"
    return base.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}")
    return df.checkpoint(eager=True)


_U = np.uint64
_rng = np.random.default_rng(20250311)
_LANES = [tuple(_U(int(x) | 1) for x in _rng.integers(1 << 60, 1 << 63, 4)) for _ in range(2)]
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Bytes from which on a word is hashed and compared by itself.
LONG_WORD = 2048


def mixed(h: np.ndarray, lane: int = 0) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers; a lane's has nothing to do with the other's."""
    a, b, _, _ = _LANES[lane]
    h = (h ^ (h >> _U(32))) * a
    h = (h ^ (h >> _U(29))) * b
    return h ^ (h >> _U(32))


class Stretches:
    """Bytes of which many stretches are hashed or compared at once, eight bytes a step."""

    def __init__(self, data: bytes):
        self.data = data
        self.words = np.ndarray((len(data) + 1,), "<u8", buffer=data + bytes(8), strides=(1,))

    def _steps(self, starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray | slice, int]]:
        """(which stretches, step) of those that reach into each step, long ones left out."""
        some: np.ndarray | slice = slice(None)
        at = np.flatnonzero(sizes <= LONG_WORD) if (sizes > LONG_WORD).any() else None
        if at is not None:
            some = at
        k = 0
        while len(sizes[some]):
            yield some, k
            k += 1
            left = sizes[some] > 8 * k
            some = np.flatnonzero(left) if isinstance(some, slice) else some[left]

    def hashes(self, starts: np.ndarray, ends: np.ndarray, lane: int = 0) -> np.ndarray:
        """A 64-bit hash of each stretch, mixed after every eight bytes."""
        sizes = ends - starts
        h = mixed(sizes.astype(np.uint64) * _LANES[lane][2] + _LANES[lane][3], lane)
        for some, k in self._steps(starts, sizes):
            part = self.words[starts[some] + 8 * k] & _MASKS[np.minimum(sizes[some] - 8 * k, 8)]
            h[some] = mixed(h[some] ^ part, lane)
        for i in np.flatnonzero(sizes > LONG_WORD).tolist():
            h[i] = int.from_bytes(hashlib.blake2b(self.data[starts[i] : ends[i]], digest_size=8, salt=bytes([lane])).digest(), "little")
        return h

    def same(self, starts: np.ndarray, ends: np.ndarray, other: Stretches, at: np.ndarray, until: np.ndarray) -> np.ndarray:
        """Whether each stretch has the bytes of ``other``'s stretch beside it."""
        sizes = ends - starts
        out = sizes == until - at
        these = np.flatnonzero(out)
        a, b, n = starts[these], at[these], sizes[these]
        for some, k in self._steps(a, n):
            x, y = self.words[a[some] + 8 * k], other.words[b[some] + 8 * k]
            differ = (x ^ y) & _MASKS[np.minimum(n[some] - 8 * k, 8)] != 0
            if differ.any():
                out[these[some][differ]] = False
        for i in np.flatnonzero(n > LONG_WORD).tolist():
            out[these[i]] = self.data[a[i] : a[i] + n[i]] == other.data[b[i] : b[i] + n[i]]
        return out
