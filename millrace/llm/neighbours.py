"""Approximate nearest neighbours by an inverted multi-index, for the largest inner product.

The two halves of every vector are quantised by centroids of their own, so that K centroids
a half make K * K cells. A query walks pairs of centroids in the order of their summed
inner products, by a heap over the sorted halves, until the cells on its way hold the wanted
share of all rows that can be ranked, of one vector no more than ``k`` + 1; the rows of those
cells are ranked by the exact inner product.
"""

from __future__ import annotations

import heapq
import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import mapped, table

#: Rows that the centroids are fitted on at most, the first by a hash of their ids.
FIT_ROWS = 16384
#: Centroids of a half; K * K counts are all that the driver holds of the rows.
CENTROIDS = 128
#: Share of all rows that a query's cells hold at least, and the least number of rows.
SHARE, LEAST_ROWS = 0.42, 1000
#: Rows that one task holds at a time, about.
BLOCK_ROWS = 16384
#: Columns of rows and of queries dealt to blocks; the latter have no cell of their own but the bits of cells.
_DEALT = ["unit", "cell", "id", "v", "cells"]


@dataclass
class Index:
    dim: int
    halves: tuple[np.ndarray, np.ndarray]
    #: Rows of each cell, those of one vector counted k + 1 times at most, and the first block and the number of salts of each first centroid.
    counts: np.ndarray | None = None
    block: np.ndarray | None = None
    salts: np.ndarray | None = None
    rows: int = 0
    #: The sum of ``counts``.
    ranked: int = 0

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroid of each half."""
        h = self.dim // 2
        return tuple(np.argmax(part @ c.T - 0.5 * (c**2).sum(1), axis=1) for part, c in zip((x[:, :h], x[:, h:]), self.halves, strict=True))

    def spans(self) -> tuple[np.ndarray, np.ndarray]:
        """The smallest and the largest first centroid of each block."""
        n = int((self.block + self.salts).max())
        low, high = np.full(n, len(self.block)), np.full(n, -1)
        for i, (start, salts) in enumerate(zip(self.block.tolist(), self.salts.tolist(), strict=True)):
            own = slice(start, start + salts)
            low[own], high[own] = np.minimum(low[own], i), np.maximum(high[own], i)
        return low, high

    def walk(self, q: np.ndarray, want: int) -> np.ndarray:
        """Which cells the query visits until they hold ``want`` rows."""
        h = self.dim // 2
        a, b = self.halves[0] @ q[:h], self.halves[1] @ q[h:]
        oa, ob = np.argsort(-a, kind="stable").tolist(), np.argsort(-b, kind="stable").tolist()
        sa, sb, counts, wide = a[oa].tolist(), b[ob].tolist(), self.counts.tolist(), len(ob)
        seen = np.zeros(len(oa) * wide, bool)
        heap, held = [(-(sa[0] + sb[0]), 0, 0)], 0
        while heap and held < want:
            _, i, j = heapq.heappop(heap)
            cell = oa[i] * wide + ob[j]
            seen[cell] = True
            held += counts[cell]
            if j + 1 < wide:
                heapq.heappush(heap, (-(sa[i] + sb[j + 1]), i, j + 1))
            if j == 0 and i + 1 < len(oa):
                heapq.heappush(heap, (-(sa[i + 1] + sb[0]), i + 1, 0))
        return seen


def _centroids(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    """k-means on the distinct rows, from a seeded choice of them."""
    x = np.unique(x, axis=0)
    rng = np.random.default_rng(seed)
    c = x[np.sort(rng.permutation(len(x))[:k])].copy()
    for _ in range(rounds):
        at = np.argmax(x @ c.T - 0.5 * (c**2).sum(1), axis=1)
        n = np.bincount(at, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten(), np.float64).reshape(-1, dim)


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vector as doubles) of the rows that take part."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), v.alias("v")).filter(F.col("id").isNotNull() & F.col("v").isNotNull() & ~bad & F.exists("v", lambda x: x != 0))


def build(rows: DataFrame, k: int = 20) -> Index | None:
    """An index over rows of :func:`usable`, for searches of ``k``; None without any. Vectors have the commonest length."""
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not sizes:
        return None
    dim = int(sizes[0]["d"])
    fit = rows.filter(F.size("v") == dim).orderBy(F.xxhash64("id"), "id").limit(FIT_ROWS).toArrow()
    x = _matrix(fit["v"], dim)
    h, c = dim // 2, max(1, min(CENTROIDS, len(x) // 4))
    index = Index(dim, (_centroids(x[:, :h], c, 1), _centroids(x[:, h:], c, 2)))
    sent = rows.sparkSession.sparkContext.broadcast(index)

    def cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            i, j = m.cells(_matrix(b.column(0), m.dim))
            n, times = i * len(m.halves[1]) + j, np.asarray(b.column(1))
            at = np.unique(n)
            all_rows, ranked = np.bincount(n, weights=times), np.bincount(n, weights=np.minimum(times, k + 1))
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(all_rows[at].astype(np.int64)), pa.array(ranked[at].astype(np.int64))], ["cell", "n", "ranked"])

    counts = np.zeros(len(index.halves[0]) * len(index.halves[1]), np.int64)
    index.counts = np.zeros_like(counts)
    vectors = rows.filter(F.size("v") == dim).groupBy("v").agg(F.count("*").alias("times"))
    for r in vectors.mapInArrow(cell, "cell long, n long, ranked long").groupBy("cell").agg(F.sum("n").alias("n"), F.sum("ranked").alias("ranked")).collect():
        counts[r["cell"]], index.counts[r["cell"]] = r["n"], r["ranked"]
    index.rows, index.ranked = int(counts.sum()), int(index.counts.sum())
    first = counts.reshape(len(index.halves[0]), -1).sum(1)
    index.block, index.salts = np.zeros(len(first), np.int64), np.ones(len(first), np.int64)
    block, held = 0, 0
    for i, n in enumerate(first.tolist()):
        if held and held + n > BLOCK_ROWS:
            block, held = block + int(index.salts[i - 1]), 0
        index.block[i], index.salts[i] = block, max(1, math.ceil(n / BLOCK_ROWS)) if not held else 1
        held += n
    return index


def _distinct(rows: pa.Table, dim: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(vectors, ids, cells) by id, of equal vectors the first ``k`` + 1."""
    x, eid, cell = _matrix(rows["v"], dim), rows["id"].to_numpy(), rows["cell"].to_numpy()
    order = np.argsort(eid, kind="stable")
    x, eid, cell = x[order], eid[order], cell[order]
    _, same = np.unique(x, axis=0, return_inverse=True)
    by = np.argsort(same, kind="stable")
    nth = np.empty(len(x), np.int64)
    nth[by] = np.arange(len(x)) - np.searchsorted(same[by], same[by])
    return x[nth <= k], eid[nth <= k], cell[nth <= k]


def _best(q: np.ndarray, qid: np.ndarray, e: np.ndarray, eid: np.ndarray, ok: np.ndarray, k: int):
    """(query row, id, score) of the k best allowed rows of each query; ties go to smaller ids.

    The product picks; a sum for each picked pair, the same wherever the pair stands, ranks.
    """
    s = q @ e.T
    s[~ok | (qid[:, None] == eid[None, :])] = -np.inf
    least = np.partition(s, -k, axis=1)[:, -k] if s.shape[1] > k else np.full(len(q), -np.inf)
    qi, ei = np.nonzero((s >= (least - 1e-9 * (1 + np.abs(least)))[:, None]) & (s > -np.inf))
    exact = (q[qi] * e[ei]).sum(1)
    order = np.lexsort((eid[ei], -exact, qi))
    qi, ei, exact = qi[order], ei[order], exact[order]
    rank = np.arange(len(qi)) - np.searchsorted(qi, qi)
    keep = rank < k
    return qi[keep], eid[ei][keep], exact[keep]


def search(rows: DataFrame, queries: DataFrame, index: Index, k: int, share: float = SHARE) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's ``k`` nearest found, itself left out.

    Each row goes once, to the block of its first centroid, those of a centroid with many rows to
    several by a hash of the id; a query goes once to each block that its walk touches,
    with the cells of that block that it visits. Blocks are sorted before their queries, so that a
    task holds the rows of one block and passes the queries by them, however many there are. Of
    rows with one vector only the ``k`` + 1 smallest ids of a block are ranked, as no more
    can be among the nearest.
    """
    sent = rows.sparkSession.sparkContext.broadcast(index)
    want = max(math.ceil(share * index.ranked), min(LEAST_ROWS, index.ranked), k + 1)
    blocks = int((index.block + index.salts).max())

    def deal_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            i, j = m.cells(_matrix(b.column(1), m.dim))
            unit = m.block[i] + np.asarray(b.column(2)) % m.salts[i]
            cell = (i - m.spans()[0][unit]) * len(m.halves[1]) + j
            yield pa.RecordBatch.from_arrays([pa.array(unit), pa.array(cell), b.column(0), b.column(1), pa.nulls(len(b), pa.binary())], _DEALT)

    def deal_queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        low_first, high_first = m.spans()
        for whole in batches:
            for low in range(0, len(whole), 64):
                b = whole.slice(low, 64)
                units, at, bits = [], [], []
                for r, q in enumerate(_matrix(b.column(1), m.dim)):
                    seen = m.walk(q, want).reshape(len(m.halves[0]), -1)
                    touched = np.flatnonzero(seen.any(1))
                    for u in np.unique(np.concatenate([np.arange(m.block[i], m.block[i] + m.salts[i]) for i in touched])).tolist():
                        units.append(u)
                        at.append(r)
                        bits.append(np.packbits(seen[low_first[u] : high_first[u] + 1]).tobytes())
                at = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(units, pa.int64()), pa.array(np.full(len(at), -1)), b.column(0).take(at), b.column(1).take(at), pa.array(bits, pa.binary())], _DEALT)

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        unit, held, block = None, [], None
        for whole in batches:
            units, query = whole.column(0).to_numpy(), whole.column(1).to_numpy() < 0
            cuts = np.flatnonzero(np.diff(units * 2 + query)) + 1
            for low, high in itertools.pairwise([0, *cuts.tolist(), len(units)]):
                if high == low:
                    continue
                part = whole.slice(low, high - low)
                if units[low] != unit:
                    unit, held, block = units[low], [], None
                if not query[low]:
                    held.append(part.select([1, 2, 3]))
                    continue
                if block is None and held:
                    block, held = _distinct(pa.Table.from_batches(held), m.dim, k), []
                for some in range(0, len(part) if block else 0, 256):
                    b = part.slice(some, 256)
                    x, eid, cell = block
                    bits = np.frombuffer(b"".join(b.column(4).to_pylist()), np.uint8).reshape(len(b), -1)
                    ok, qid = np.unpackbits(bits, axis=1)[:, cell].astype(bool), b.column(2).to_numpy()
                    qi, ids, scores = _best(_matrix(b.column(3), m.dim), qid, x, eid, ok, k)
                    yield pa.RecordBatch.from_arrays([pa.array(qid[qi], pa.int64()), pa.array(ids, pa.int64()), pa.array(scores, pa.float64())], ["query_id", "vec_id", "score"])

    salt = F.pmod(F.xxhash64("id"), F.lit(1 << 30)).alias("h")
    schema = "unit long, cell long, id long, v array<double>, cells binary"
    e = rows.filter(F.size("v") == index.dim).select("id", "v", salt).mapInArrow(deal_rows, schema)
    q = queries.filter(F.size("v") == index.dim).select("id", "v", salt).repartition(max(8, blocks)).mapInArrow(deal_queries, schema)
    dealt = e.unionByName(q).repartition(max(8, blocks), "unit").sortWithinPartitions("unit", F.col("cell") < 0, "id")
    near = mapped(dealt, rank, "query_id long, vec_id long, score double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null, zero and not finite vectors take no part; repeated ids are rows of their own; no vectors, no rows."""
    rows = usable(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    index = build(rows, 20)
    if index is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return search(rows, rows.filter(F.col("id") % 20 == 0), index, 20)
