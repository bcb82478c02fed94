"""Toxicity by a factorization machine over hashed terms.

The terms of a text are its lower-case words and their beginnings, hashed into a fixed
number of buckets. The machine adds to the weights of the buckets that a text has the
inner products of their factors, pair by pair, so that terms which are harmless alone can
count together. Every bucket of the fitted rows has a weight and factors. Weights are
fitted first; factors start from the leading eigenvectors of the matrix of all pairs of
buckets, each pair with the sum of what the weights leave unexplained in the rows that have
it, so that pairs are found whatever their buckets tell alone. Then both are fitted together.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import mapped, release, sigmoid, table
from millrace.llm.labelled import SAMPLE_ROWS, held_out, sample

BUCKET_BITS = 20
FACTORS = 8
#: Standard deviations of a bucket's label 1 rows from which its weight learns at full rate, and the power by which others are slower.
FULL_GAIN, SLOWNESS = 4.0, 4
#: Passes over the rows for the weights, for the pair matrix, and for both parts together; rows that move them at a time.
WEIGHT_EPOCHS, PAIR_ROUNDS, JOINT_EPOCHS, BLOCK_ROWS = 25, 6, 40, 256
#: Fewest steps for both parts together, so that few rows are fitted as closely.
JOINT_STEPS = 1200
#: Of the joint passes every so manieth moves the factors of all buckets, the others those of buckets that have some.
WHOLE_EVERY = 8
#: Weight of a row of label 1 in fitting, which are the fewer.
TOXIC_WEIGHT = 3.0
THRESHOLD = 0.7

_WORD = re.compile(rb"[a-z\x80-\xff]+")
#: Lengths in bytes of the word beginnings that are terms of their own.
_HEADS = (5, 7)


def buckets(text: str | None, memo: dict[bytes, tuple[int, ...]]) -> set[int]:
    """The buckets of a text's terms. ``memo`` keeps the buckets of words seen before."""
    out: set[int] = set()
    mask = (1 << BUCKET_BITS) - 1
    for w in set(_WORD.findall((text or "").lower().encode("utf-8", "replace"))):
        got = memo.get(w)
        if got is None:
            if len(memo) > 100_000:
                memo.clear()
            got = memo[w] = (zlib.crc32(w) & mask, *(zlib.crc32(w[:n], 1) & mask for n in _HEADS if len(w) > n))
        out.update(got)
    return out


@dataclass
class Machine:
    """Buckets with a weight and factors each, and the bias; ``factors`` has a row for each factor."""

    kept: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def place(self) -> np.ndarray:
        """Positions in ``kept`` by bucket, -1 for none."""
        out = np.full(1 << BUCKET_BITS, -1, np.int32)
        out[self.kept] = np.arange(len(self.kept))
        return out

    def score(self, rows: list[np.ndarray]) -> np.ndarray:
        """Probabilities for lists of positions in ``kept``."""
        n = np.array([len(r) for r in rows], np.int64)
        at = np.concatenate([np.zeros(0, np.int64), *rows]).astype(np.int64)
        z = self.bias + _row_sums(self.weights, at, n)
        for f in self.factors.astype(np.float64):
            z += 0.5 * (_row_sums(f, at, n) ** 2 - _row_sums(f**2, at, n))
        return sigmoid(z)


def _row_sums(values: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sums of ``values`` at the positions of each row; ``n`` positions a row."""
    out = np.zeros(len(n))
    if len(at):
        out[n > 0] = np.add.reduceat(values[at].astype(np.float64), (np.cumsum(n) - n)[n > 0])
    return out


class _Block:
    """Rows that are fitted together: entries row by row, and bucket by bucket."""

    def __init__(self, at: np.ndarray, n: np.ndarray, y: np.ndarray):
        self.n, self.y = n, y
        self.cost = np.where(y > 0, TOXIC_WEIGHT, 1.0) / max(1, len(n))
        order = np.argsort(at, kind="stable").astype(np.int32)
        self.found, self.heads = np.unique(at[order], return_index=True)
        self.at = np.empty(len(at), np.int32)
        self.at[order] = np.repeat(np.arange(len(self.found), dtype=np.int32), np.diff(np.append(self.heads, len(at))))
        self.row = np.repeat(np.arange(len(n), dtype=np.int32), n)[order]

    def only(self, some: np.ndarray) -> _Block:
        """The block with the entries of those buckets that ``some`` marks."""
        keep = some[self.found[self.at]]
        n = np.bincount(np.repeat(np.arange(len(self.n)), self.n)[keep], minlength=len(self.n))
        return _Block(self.found[self.at[keep]], n, self.y)

    def sums(self, values: np.ndarray) -> np.ndarray:
        """For each row the sum of its buckets' values."""
        return _row_sums(values, self.at, self.n)

    def back(self, values: np.ndarray) -> np.ndarray:
        """For each bucket the sum of its rows' values."""
        return np.add.reduceat(values[self.row], self.heads) if len(self.row) else np.zeros(0)


def _blocks(at: np.ndarray, n: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> list[_Block]:
    """Rows in a fixed random order; sixteen blocks at least, so that few rows make enough steps too."""
    starts, out = np.cumsum(n) - n, []
    for rows in np.array_split(rng.permutation(len(n)), max(min(16, len(n)), len(n) // BLOCK_ROWS)):
        own = n[rows]
        entries = np.repeat(starts[rows] - np.cumsum(own) + own, own) + np.arange(own.sum())
        out.append(_Block(at[entries].astype(np.int32), own, y[rows]))
    return out


def _orthonormal(v: np.ndarray) -> np.ndarray:
    """Rows that span what the rows of ``v`` span, at right angles and of length one.

    By the Cholesky factor of their products, which takes one copy of ``v`` where a QR
    decomposition takes four; where that is singular, by QR.
    """
    try:
        return np.linalg.inv(np.linalg.cholesky(v @ v.T)) @ v
    except np.linalg.LinAlgError:
        return np.linalg.qr(v.T)[0].T


def _leading(blocks: list[_Block], errors: list[np.ndarray], wide: int, rng: np.random.Generator) -> np.ndarray:
    """Leading eigenvectors, FACTORS rows, of the matrix that has for each two of ``wide`` buckets the errors of the rows with both.

    It is never built: its products are added up block by block.
    """
    diagonal = np.zeros(wide)
    for b, e in zip(blocks, errors, strict=True):
        diagonal[b.found] += b.back(e)
    v = _orthonormal(rng.normal(size=(wide, FACTORS)).T)
    for _ in range(PAIR_ROUNDS):
        turned = -diagonal * v
        for b, e in zip(blocks, errors, strict=True):
            for f, t in zip(v, turned, strict=True):
                t[b.found] += b.back(e * b.sums(f[b.found]))
        v = _orthonormal(turned)
    return v


def _shrunk(v: np.ndarray, by: float) -> np.ndarray:
    """The factors of each bucket, shorter by ``by`` and none where they are shorter than that."""
    return v * np.maximum(0, 1 - by / np.maximum(np.sqrt((v**2).sum(0)), 1e-12))


def fit(kept: np.ndarray, at: np.ndarray, n: np.ndarray, y: np.ndarray, rate: float = 0.1, factor_rate: float = 0.3, l2: float = 2e-5, shrink: float = 4e-3, seed: int = 7, pace: np.ndarray | None = None) -> Machine:
    """A machine for rows with ``n`` positions in ``kept`` each, ``at`` row by row, and labels, on the log loss.

    Weights move by AdaGrad, each by its own gradients, at ``pace`` (from 0 to 1, else 1);
    factors by their joint gradient, so that pairs that many rows have move first, and shrink to
    none where little drives them. Without rows of both labels the machine always gives the
    share of label 1.
    """
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 1e-3
    prior = float(np.log(share / (1 - share)))
    if not len(y) or y.min() == y.max() or not len(kept):
        return Machine(np.zeros(0, np.int64), prior, np.zeros(0, np.float32), np.zeros((FACTORS, 0), np.float32))
    rng = np.random.default_rng(seed)
    pace = np.ones(len(kept)) if pace is None else pace.copy()
    w, g, bias, gb = np.zeros(len(kept)), np.full(len(kept), 1e-6), prior, 1e-6
    v, gv = np.zeros((FACTORS, len(kept))), 1e-6
    blocks = _blocks(at, n, y, rng)
    del at
    paired = [b.only(np.zeros(len(kept), bool)) for b in blocks]  # the entries of buckets whose factors move
    for epoch in range(WEIGHT_EPOCHS + max(JOINT_EPOCHS, JOINT_STEPS // len(blocks))):
        if epoch == WEIGHT_EPOCHS:
            errors = [(b.y - sigmoid(bias + b.sums(w[b.found]))) * b.cost * len(b.n) for b in blocks]
            v = _leading(blocks, errors, len(kept), rng)
            v = _shrunk(v * 0.2 / np.abs(v).max(1, keepdims=True).clip(1e-12), 0.05)
            g[:], gb = 1e-6, 1e-6
        if epoch >= WEIGHT_EPOCHS:
            every = (epoch - WEIGHT_EPOCHS) % WHOLE_EVERY == 0
            alive = np.abs(v).max(0) > 0
            paired = blocks if every else [b.only(alive) for b in blocks] if (epoch - WEIGHT_EPOCHS) % WHOLE_EVERY == 1 else paired
        for i in rng.permutation(len(blocks)):
            b, c = blocks[i], paired[i]
            z = bias + b.sums(w[b.found])
            own = v[:, c.found]
            s = [c.sums(f) for f in own]
            for f, t in zip(own, s, strict=True):
                z += 0.5 * (t**2 - c.sums(f**2))
            e = (sigmoid(z) - b.y) * b.cost
            if len(c.at):
                d = c.back(e)
                dv = np.array([c.back(e * t) - d * f for f, t in zip(own, s, strict=True)]) + l2 * own
                gv += (dv**2).sum()
                own = _shrunk(own - factor_rate * dv / np.sqrt(gv), shrink)
                v[:, c.found] = own
                pace[c.found] = np.maximum(pace[c.found], np.minimum(1, np.sqrt((own**2).sum(0))))
            if len(b.at):
                d = b.back(e) + l2 * w[b.found]
                g[b.found] += d**2
                w[b.found] -= rate * pace[b.found] * d / np.sqrt(g[b.found])
            gb += e.sum() ** 2
            bias -= rate * e.sum() / np.sqrt(gb)
    return Machine(kept, float(bias), w.astype(np.float32), v.astype(np.float32))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", parts: int = 3, left: int = 1, rows: int = SAMPLE_ROWS) -> Machine:
    """A machine for the labelled documents that are not held out, ``rows`` of them at most.

    The driver gets, for each row, which buckets it has; all of them are fitted, weights at a
    pace after what they show alone.
    """

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[bytes, tuple[int, ...]] = {}
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([sorted(buckets(x, memo)) for x in b.column(1).to_pylist()], pa.list_(pa.int32())), b.column(2)], ["doc_id", "b", "y"])

    got = mapped(sample(docs, labels, label, parts, left, rows), hashed, "doc_id long, b array<int>, y double").toArrow().sort_by("doc_id")
    y, n = got["y"].to_numpy(), pc.list_value_length(got["b"]).to_numpy().astype(np.int64)
    flat = pc.list_flatten(got["b"]).to_numpy()
    del got
    count = np.bincount(flat, minlength=1 << BUCKET_BITS)
    kept = np.flatnonzero(count)
    place = np.zeros(len(count), np.int32)
    place[kept] = np.arange(len(kept))
    flat, count = place[flat], count[kept]
    del place
    pace = np.zeros(len(kept))
    if len(y) and y.min() < y.max():
        mean, hits = y.mean(), np.bincount(flat, weights=np.repeat(y, n), minlength=len(kept))
        pace = np.minimum(1, np.abs(hits - count * mean) / np.sqrt(count * mean * (1 - mean) + 1) / FULL_GAIN) ** SLOWNESS
    machine = fit(kept, flat, n, y, pace=pace)
    del flat
    release()
    return machine


def score(df: DataFrame, machine: Machine, text_col: str = "text", name: str = "score") -> DataFrame:
    """``df`` with ``name``: the machine's probability that a text is toxic; narrow.

    Null and empty texts have no terms and get the score of the bias alone. Whole texts are
    read; repeated rows get equal scores; a column of ``df`` with that name is replaced. The
    machine is broadcast; the number of buckets bounds its size.
    """
    given = df.select(*[F.col(f"`{c}`") for c in df.columns if c != name])
    at = given.columns.index(text_col)
    sent = df.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        place, memo = m.place(), {}
        for whole in batches:
            for start in range(0, len(whole), 500):
                b = whole.slice(start, 500)
                rows = []
                for x in pc.cast(b.column(at), pa.string()).to_pylist():
                    got = buckets(x, memo)
                    found = place[np.fromiter(got, np.int64, len(got))]
                    rows.append(np.sort(found[found >= 0]))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(m.score(rows), pa.float64())], [*b.schema.names, name])

    return mapped(given, run, T.StructType([*given.schema.fields, T.StructField(name, T.DoubleType())]))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document: whether it was held out, its score and what that predicts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
