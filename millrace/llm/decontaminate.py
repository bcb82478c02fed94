"""Benchmark decontamination by pigeonhole edit matching.

A test item of m characters may stand in a text with up to e errors (inserted, left out or
changed characters). Cut into e + 1 pieces, it has one piece at least without an error in
any such place. An automaton finds all exact piece hits in one pass over a text, and the
surroundings of a hit are verified by Myers' bit-parallel edit distance. Both sides are
compared in lower case (A-Z) with runs of white space as one space.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import mapped, table

#: Characters of an item for each error that is allowed in it, and those under which it must stand as it is, as whole words.
CHARS_PER_ERROR, WHOLE_CHARS = 16, 24
#: Bytes of item text in one block; a benchmark of more is scanned for in several passes.
BLOCK_BYTES = 2 << 20

_LOWER = {c: c + 32 for c in range(65, 91)}
_LEAKS = "array<struct<item_id:bigint,distance:int>>"


def normal(text: str) -> str:
    return " ".join(text.translate(_LOWER).split())


def myers(item: str, text: str, most: int) -> int:
    """The least edit distance of ``item`` to a part of ``text``, or ``most`` + 1 if it is larger."""
    m = len(item)
    masks: dict[str, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best = full, 0, m, m
    for c in text:
        eq = masks.get(c, 0)
        x = eq | minus
        d = (((eq & plus) + plus) ^ plus) | eq
        up, down = minus | (full & ~(d | plus)), plus & d
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = up << 1 & full, down << 1 & full
        plus, minus = down | (full & ~(x | up)), up & x
        if score < best:
            best = score
    return min(best, most + 1)


class Matcher:
    """Finds items, (id, normal text), in normal texts."""

    def __init__(self, items: list[tuple[int, str]]):
        self.items = [(i, t, len(t) // CHARS_PER_ERROR if len(t) >= WHOLE_CHARS else 0) for i, t in items if t]
        pieces: dict[str, list[tuple[int, int]]] = {}
        for k, (_, t, e) in enumerate(self.items):
            cuts = [len(t) * j // (e + 1) for j in range(e + 2)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                pieces.setdefault(t[a:b], []).append((k, b))
        self.automaton = ahocorasick.Automaton()
        for piece, where in pieces.items():
            self.automaton.add_word(piece, where)
        if pieces:
            self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int]]:
        """(item id, least distance) of the items that stand in ``text``, by id."""
        if not self.items:
            return []
        best: dict[int, int] = {}
        tried: set[tuple[int, int]] = set()
        for end, where in self.automaton.iter(text):
            for k, stop in where:
                at = end + 1 - stop
                if best.get(k) == 0 or (k, at) in tried:
                    continue
                tried.add((k, at))
                _, item, e = self.items[k]
                if len(item) < WHOLE_CHARS:
                    if not (text[at - 1 : at].isalnum() and at or text[at + len(item) : at + len(item) + 1].isalnum()):
                        best[k] = 0
                    continue
                near = text[max(0, at - e) : at + len(item) + e]
                d = 0 if item in near else myers(item, near, e)
                if d <= e and d < best.get(k, e + 1):
                    best[k] = d
        least: dict[int, int] = {}
        for k, d in best.items():
            i = self.items[k][0]
            least[i] = min(d, least.get(i, d))
        return sorted(least.items())


def find(df: DataFrame, benchmark: DataFrame, text_col: str = "text", name: str = "leaks") -> DataFrame:
    """``df`` with the column ``leaks``: array<struct<item_id, distance>> by item id.

    Narrow: no shuffle of the texts. The benchmark (``item_id``, ``text``) is dealt into blocks of
    about ``BLOCK_BYTES`` by a hash of its ids, each collected and broadcast by itself, so
    that any size of it is matched whole, with one pass over the texts a block. Null texts
    on either side and items of fewer than ``LEAST_CHARS`` characters match nothing; repeated
    items count once; whole texts are searched. A column of ``df`` named ``leaks`` is replaced.
    """
    spark = df.sparkSession
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), "text").filter(F.col("item_id").isNotNull() & F.col("text").isNotNull()).distinct()
    size = int(items.select(F.sum(F.octet_length("text"))).first()[0] or 0)
    blocks = max(1, math.ceil(size / BLOCK_BYTES))
    kept = [c for c in df.columns if c != name]
    out = df.select(*[F.col(f"`{c}`") for c in kept], F.array().cast(_LEAKS).alias(name))
    schema, at = out.schema, kept.index(text_col)
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int32())]))
    for block in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect()
        sent = spark.sparkContext.broadcast(sorted((r["item_id"], normal(r["text"])) for r in rows))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(sent.value)
            for whole in batches:
                for low in range(0, len(whole), 500):
                    b = whole.slice(low, 500)
                    found = [matcher.find(normal(x)) if x else [] for x in pc.cast(b.column(at), pa.string()).to_pylist()]
                    old = b.column(len(kept)).to_pylist()
                    new = [[*o, *({"item_id": i, "distance": d} for i, d in f)] for o, f in zip(old, found, strict=True)]
                    yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(new, kind)], b.schema.names)

        out = mapped(out, run, T.StructType(schema.fields))
    return out if blocks == 1 else out.withColumn(name, F.array_sort(name))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document and the item that stands in it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.item_id", "leak.distance")
