"""Bounded samples of labelled documents for the classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled rows that a classifier is fitted on at most; their features, not their texts, reach the driver.
SAMPLE_ROWS = 8000


def held_out(doc_id, parts: int, left: int):
    """Whether crc32 of the id's text leaves ``left`` when divided by ``parts``; null ids count as the text ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts == left


def sample(docs: DataFrame, labels: DataFrame, label: str, parts: int, left: int, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, text, y) of at most ``rows`` labelled documents that are not held out.

    They are the first in the order of a hash of the id, so that the choice is the same in
    every run. The ids are broadcast: ``rows`` bounds their size. Labels other than 0 and 1
    and null ids take no part.
    """
    y = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), parts, left))
    ids = y.groupBy("doc_id").agg(F.max(label).cast("double").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
