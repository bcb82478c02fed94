"""Connected components of a link table, without collecting it."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import checkpointed

#: Links that one executor task joins by union-find; more are joined by rounds of the cluster.
TASK_LINKS = 2_000_000


def components(links: DataFrame, task_links: int = TASK_LINKS) -> DataFrame:
    """(id, component): each linked id and the smallest id that its links reach.

    ``links`` has ``a`` and ``b``; it should be a table that is cheap to read, as it is
    counted first. Up to ``task_links`` links, 16 bytes each, go through a union-find in one
    task; a larger table goes through rounds of :func:`_propagated`, which give the same.
    Null and equal ends are no links; no links give no rows.
    """
    clean = links.select(F.col("a").cast("bigint"), F.col("b").cast("bigint")).filter("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    if links.count() > task_links:
        return _propagated(clean)
    return clean.coalesce(1).mapInArrow(_joined, "id long, component long")


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    root: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while root[top] != top:
            top = root[top]
        while root[x] != top:
            root[x], x = top, root[x]
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(root.setdefault(a, a) if a not in root else a), find(root.setdefault(b, b) if b not in root else b)
            if a != b:
                root[max(a, b)] = min(a, b)
    ids = list(root)
    for low in range(0, len(ids), 100_000):
        some = ids[low : low + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([find(i) for i in some], pa.int64())], ["id", "component"])


def _propagated(clean: DataFrame) -> DataFrame:
    """Rounds until nothing changes: each id takes the least label around it, and labels that
    were met take over what the labels they replace had taken (pointer jumping), so that
    rounds grow with the logarithm of the longest chain. A round is checkpointed in the
    shared folder.
    """
    both = checkpointed(clean.select("a", "b").union(clean.select(F.col("b"), F.col("a"))).distinct())
    labels = checkpointed(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("label")))
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("label").alias("near")).withColumnRenamed("a", "id")
        met = labels.join(near, "id").select("id", "label", F.least("label", "near").alias("new"))
        taken = met.groupBy("label").agg(F.min("new").alias("new")).withColumnRenamed("label", "id").withColumnRenamed("new", "by")
        moved = met.join(taken, "id", "left").select("id", F.col("label").alias("old"), F.least("new", F.coalesce("by", "new")).alias("label"))
        jump = moved.select(F.col("id").alias("label"), F.col("label").alias("next"))
        after = checkpointed(moved.join(jump, "label", "left").select("id", "old", F.least("label", F.coalesce("next", "label")).alias("label")))
        done = after.filter("old <> label").limit(1).count() == 0
        labels = after.select("id", "label")
        if done:
            return labels.withColumnRenamed("label", "component")
