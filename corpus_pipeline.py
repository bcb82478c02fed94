"""A corpus of documents on its way to training data, in five stages.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a
DataFrame that, written as Parquet and read again, is the next stage's ``docs``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bpe, decontaminate, jaccard, secrets, toxicity
from millrace.llm.common import checkpointed, table

#: Ids of dropped documents that are broadcast at most; more are joined by a shuffle.
BROADCAST_IDS = 500_000


def _free(docs: DataFrame, name: str) -> str:
    """``name`` with as many underscores before it as keep it apart from the columns of ``docs``."""
    while name.lower() in map(str.lower, docs.columns):
        name = f"_{name}"
    return name


def clean_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays under the threshold; the machine is fitted on labels that are not held out.

    Each row is judged by itself: null and empty texts have the score of the bias alone, repeated
    rows go or stay together, texts are read whole. Without labels of both kinds the share
    of toxic ones is every score, so that nothing goes. Columns of any name stay as they are.
    """
    machine = toxicity.train(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    name = _free(docs, "score")
    return toxicity.score(docs, machine, name=name).filter(F.col(name) < toxicity.THRESHOLD).select(*_named(docs))


def _named(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones, that of the smallest id; documents without a group stay.

    Null and empty texts are linked with nothing and stay. Rows that repeat an id and a text
    are one group too, and one of them stays, the first by all of its columns; of rows of one id with
    different texts those go whose id is linked to a smaller one. Rows without an id have no place in
    groups and stay. Columns of any name stay as they are.
    """
    groups = jaccard.link_components(docs.select("doc_id", "text"))
    dropped = checkpointed(groups.filter("component_id < doc_id").select("doc_id").distinct())
    left = docs.join(F.broadcast(dropped) if dropped.count() <= BROADCAST_IDS else dropped, "doc_id", "left_anti").select(*_named(docs))
    repeated = checkpointed(docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 AND doc_id IS NOT NULL").select("doc_id"))
    if not repeated.limit(1).count():
        return left
    some = F.broadcast(repeated) if repeated.count() <= BROADCAST_IDS else repeated
    again = left.join(some, "doc_id", "left_semi").select(*_named(docs))
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    empty = F.trim(F.coalesce("text", F.lit(""))) == ""
    least = F.min(F.struct(*[F.col(f"`{c}`") for c in others])) if others else F.first("doc_id")
    one = again.filter(~empty).groupBy("doc_id", "text").agg(least.alias("_least"))
    one = one.select(*[F.col(f"_least.`{c}`").alias(c) if c in others else F.col(c) for c in docs.columns])
    return left.join(some, "doc_id", "left_anti").select(*_named(docs)).unionByName(again.filter(empty)).unionByName(one)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item stands.

    Each row is judged by itself, its text whole. Null and empty texts hold no item and stay, as
    all rows do where the benchmark is empty. Columns of any name stay as they are.
    """
    name = _free(docs, "leaks")
    return decontaminate.find(docs, table(spark, sf_dir, "benchmark"), name=name).filter(F.size(name) == 0).select(*_named(docs))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets replaced by a mark; ``n_chars`` counts the new text.

    Null texts stay null, with null for ``n_chars``; empty ones stay empty. Rows are redacted each by
    itself, their texts whole. Columns of any name stay as they are.
    """
    out = secrets.redact(docs, name=_free(docs, "secrets"))
    return (out.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else out).select(*_named(docs))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of each document but its text, ``n_tokens``, the token ids, little-endian in ``ids``, and ``exact``, whether they decode to its text.

    Null and empty texts have no ids and are exact; repeated rows are encoded each. Columns of
    the input that are named like the new ones are replaced.
    """
    out = bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.json"))
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("text", "n_tokens", "ids", "decoded", "exact")]
    return out.select(*kept, "n_tokens", "ids", (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("exact"))


STAGES = [
    ("toxicity", clean_toxicity),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate_benchmark),
    ("secrets", redact_secrets),
    ("bpe", encode_tokens),
]

#: Learned scores, similarity groups and merges have no SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name == "toxicity":  # the next stage reads it several times
            docs = checkpointed(docs)
    return docs
