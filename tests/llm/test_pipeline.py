"""The stages against brute force, each on its own input, written and read again between them."""

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from millrace.llm import decontaminate, toxicity
from test_matching import groups_of
from test_secrets_licenses_chat import spans_of

ROOT = "/root/testdata/sf0.01"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{ROOT}/documents.parquet")
    columns, labels = docs.columns, {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{ROOT}/labels.parquet").collect()}
    items = [decontaminate.normal(r["text"]) for r in spark.read.parquet(f"{ROOT}/benchmark.parquet").collect()]
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, ROOT).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        rows = docs.collect()
        after = {r["doc_id"]: r for r in rows}
        assert len(after) == len(rows)
        gone = set(before) - set(after)
        if name == "toxicity":
            told = [i for i in gone if i in labels]
            assert sum(labels[i] for i in told) >= 0.9 * len(told) and sum(labels.get(i, 0) for i in after) <= 0.5 * sum(labels.values())
        elif name == "near_duplicates":
            assert gone == {i for i, (n, c) in groups_of(list(before.items())).items() if c != i}
        elif name == "decontamination":
            matcher = decontaminate.Matcher(list(enumerate(items)))
            assert gone == {i for i, t in before.items() if matcher.find(decontaminate.normal(t or ""))}
            assert not any(t in decontaminate.normal(r["text"]) for r in rows for t in items)
        elif name == "secrets":
            assert not gone and all((r["text"] == before[i]) == (not spans_of(before[i])[1]) and r["n_chars"] == len(r["text"]) for i, r in after.items())
        else:
            t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
            assert not gone and all(r["exact"] and np.frombuffer(r["ids"], "<u4").tolist() == t.encode(before[i], add_special_tokens=False).ids for i, r in after.items())
        if name != "bpe":
            assert docs.columns == columns
            before = {i: r["text"] for i, r in after.items()}
    assert toxicity.THRESHOLD == 0.7


def test_run_is_the_stages(spark):
    assert corpus_pipeline.run(spark, ROOT).count() > 100 and 4 <= len(corpus_pipeline.STAGES) <= 5


def test_odd_documents(spark, tmp_path):
    """Nulls, empty and repeated rows, one long text and columns with clashing names, through each stage."""
    base = spark.read.parquet(f"{ROOT}/documents.parquet")
    extra = [c for c in ("score", "leaks", "secrets", "_score")]
    text = "one two three four five six seven eight nine ten eleven twelve " * 3
    rows = [(-1, None), (-2, ""), (-2, ""), (-3, text), (-3, text), (-4, text), (None, text), (None, None), (-5, "w" * 300000 + " token=abcdefgh"), (-6, "same " * 40000)]
    odd = spark.createDataFrame([(i, t, None, "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs = base.limit(40).select("doc_id", "text", "lang", "source", "n_chars").unionByName(odd)
    for c in extra:
        docs = docs.withColumn(c, F.lit(c))
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, ROOT)
        got.write.parquet(str(tmp_path / name))
        got = spark.read.parquet(str(tmp_path / name))
        left = [(r["doc_id"], r["text"] if "text" in got.columns else None) for r in got.collect() if r["doc_id"] is None or r["doc_id"] < 0]
        assert all(got.filter(F.col(c) != c).count() == 0 and got.filter(F.col(c).isNull()).count() == 0 for c in extra)
        if name == "near_duplicates":
            assert sorted(left, key=str) == sorted([(-1, None), (-2, ""), (-2, ""), (-4, text), (None, text), (None, None), *rows[8:]], key=str)
        elif name == "secrets":
            assert (-5, "w" * 300000 + " [SECRET]") in left and len(left) == len(rows)
        else:
            assert len(left) == len(rows)
        assert name == "bpe" or got.columns == docs.columns
        assert stage(spark, docs.limit(0), ROOT).count() == 0
