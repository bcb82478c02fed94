"""Quality by a sparse ensemble of rules over text statistics.

Small boosted trees are grown on the statistics of labelled texts; each path from a root
is a rule, a conjunction of comparisons. A logistic model with an L1 penalty weighs the
rules and drops most of them, and what is left is compiled into one Spark column
expression over the statistics columns.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import mapped, sigmoid, table
from millrace.llm.labelled import SAMPLE_ROWS, held_out, sample

THRESHOLD = 0.7
STATISTICS = (
    "chars", "words", "word_length", "upper", "digits", "symbols", "pipes", "marks", "non_ascii", "stops",
    "lines", "line_length", "repeated_lines", "repeated_words", "top_word", "top_line", "short_words", "long_words",
)

_ASCII = np.arange(256)
_UPPER = (_ASCII >= 65) & (_ASCII <= 90)
_LETTER = _UPPER | ((_ASCII >= 97) & (_ASCII <= 122)) | (_ASCII >= 128)
_DIGIT = (_ASCII >= 48) & (_ASCII <= 57)
_SYMBOL = np.isin(_ASCII, list(b"#$%&*@^~<>{}[]\\_=+"))
_KINDS = np.stack([_UPPER, _LETTER, _DIGIT, _SYMBOL, _ASCII == 0x7C, np.isin(_ASCII, list(b"!?")), _ASCII >= 128, np.isin(_ASCII, list(b".,"))]).astype(np.float64)


def statistics(text: str | None) -> list[float]:
    """The statistics of a whole text, in the order of ``STATISTICS``; zeros for an empty one."""
    if not text:
        return [0.0] * len(STATISTICS)
    raw = text.encode("utf-8", "replace")
    upper, letters, digits, symbols, pipes, marks, wide, stops = (_KINDS @ np.bincount(np.frombuffer(raw, np.uint8), minlength=256)).tolist()
    size = len(raw)
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    n, m = max(len(words), 1), max(len(lines), 1)
    seen, rows = Counter(words), Counter(lines)
    lengths = list(map(len, words))
    return [
        float(np.log1p(size)), float(np.log1p(len(words))), sum(lengths) / n, upper / max(letters, 1), digits / size, symbols / size, pipes / n, marks / n, wide / size, stops / n,
        float(np.log1p(len(lines))), float(np.log1p(size / m)), 1 - len(rows) / m, 1 - len(seen) / n, max(seen.values(), default=0) / n, max(rows.values(), default=0) / m,
        sum(x <= 2 for x in lengths) / n, sum(x >= 12 for x in lengths) / n,
    ]


def with_statistics(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with a double column ``stat_<name>`` for each statistic; narrow, one pass."""
    names = [f"stat_{s}" for s in STATISTICS]
    given = df.select(*[F.col(f"`{c}`") for c in df.columns if c not in names])
    at = given.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, len(whole), 500):
                b = whole.slice(start, 500)
                rows = np.array([statistics(x) for x in pc.cast(b.column(at), pa.string()).to_pylist()]).reshape(-1, len(names))
                yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c) for c in rows.T)], [*b.schema.names, *names])

    return mapped(given, run, T.StructType([*given.schema.fields, *(T.StructField(n, T.DoubleType()) for n in names)]))


#: A comparison is (statistic, whether above, bound): above means > bound, else <= bound.
Rule = tuple[tuple[int, bool, float], ...]


@dataclass
class Ensemble:
    """Rules with their weights, and the bias."""

    bias: float
    rules: list[tuple[Rule, float]]

    def column(self) -> Column:
        """The probability as an expression over the statistics columns."""
        z = F.lit(float(self.bias))
        for rule, weight in self.rules:
            holds = F.lit(True)
            for k, above, bound in rule:
                c = F.col(f"stat_{STATISTICS[k]}")
                holds = holds & ((c > float(bound)) if above else (c <= float(bound)))
            z = z + F.when(holds, F.lit(float(weight))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def _best_split(x: np.ndarray, g: np.ndarray, h: np.ndarray, at: np.ndarray, bounds: list[np.ndarray], least: int):
    best = (1e-6, -1, 0.0)
    total_g, total_h = g[at].sum(), h[at].sum()
    for k, cuts in enumerate(bounds):
        if not len(cuts):
            continue
        bin_ = np.searchsorted(cuts, x[at, k], side="left")
        gs, hs, ns = (np.cumsum(np.bincount(bin_, weights=w, minlength=len(cuts) + 1))[:-1] for w in (g[at], h[at], np.ones(len(at))))
        gain = gs**2 / (hs + 1) + (total_g - gs) ** 2 / (total_h - hs + 1) - total_g**2 / (total_h + 1)
        gain[(ns < least) | (len(at) - ns < least)] = -1
        i = int(np.argmax(gain))
        if gain[i] > best[0]:
            best = (float(gain[i]), k, float(cuts[i]))
    return best


def tree_rules(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 48, least: int = 8) -> list[Rule]:
    """The distinct paths, of any length, of boosted trees."""
    bounds = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) for k in range(x.shape[1])]
    z = np.full(len(y), np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    found: dict[Rule, None] = {}
    for _ in range(trees):
        p = sigmoid(z)
        g, h = y - p, p * (1 - p)
        todo: list[tuple[np.ndarray, Rule, int]] = [(np.arange(len(y)), (), 0)]
        while todo:
            at, path, level = todo.pop()
            _, k, bound = _best_split(x, g, h, at, bounds, least) if level < depth else (0, -1, 0)
            if k < 0:
                z[at] += rate * g[at].sum() / (h[at].sum() + 1)
                continue
            right = x[at, k] > bound
            for side, above in ((at[right], True), (at[~right], False)):
                rule = tuple(sorted({*path, (k, above, bound)}))
                found.setdefault(rule)
                todo.append((side, rule, level + 1))
    return list(found)


def lasso(r: np.ndarray, y: np.ndarray, penalty: float, steps: int = 600) -> tuple[float, np.ndarray]:
    """Bias and weights of a logistic model under an L1 penalty, by accelerated proximal steps."""
    n = len(y)
    scale = np.linalg.norm(np.column_stack([np.ones(n), r]), 2) ** 2 / (4 * n)
    w = np.zeros(r.shape[1] + 1)
    w[0] = np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))
    u, t = w.copy(), 1.0
    for _ in range(steps):
        e = sigmoid(u[0] + r @ u[1:]) - y
        new = u - np.concatenate(([e.mean()], r.T @ e / n)) / scale
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - penalty / scale, 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        u, w, t = new + (t - 1) / t2 * (new - w), new, t2
    return float(w[0]), w[1:]


def fit(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3) -> Ensemble:
    """The ensemble for statistics ``x`` and labels ``y``; of one label only, its share alone."""
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    if not len(y) or y.min() == y.max():
        return Ensemble(float(np.log(share / (1 - share))), [])
    rules = tree_rules(x, y)
    if not rules:
        return Ensemble(float(np.log(share / (1 - share))), [])
    holds = np.column_stack([np.logical_and.reduce([(x[:, k] > b) == above for k, above, b in rule]) for rule in rules]).astype(float)
    bias, weights = lasso(holds, y, penalty)
    return Ensemble(bias, [(r, float(w)) for r, w in zip(rules, weights, strict=True) if abs(w) > 1e-4])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", parts: int = 4, left: int = 2, rows: int = SAMPLE_ROWS) -> Ensemble:
    """An ensemble for the labelled documents that are not held out, ``rows`` of them at most."""
    got = with_statistics(sample(docs, labels, label, parts, left, rows)).drop("text").toArrow().sort_by("doc_id")
    x = np.column_stack([got[f"stat_{s}"].to_numpy() for s in STATISTICS]) if len(got) else np.zeros((0, len(STATISTICS)))
    return fit(x, got["y"].to_numpy())


def score(df: DataFrame, ensemble: Ensemble, text_col: str = "text") -> DataFrame:
    """``df`` with ``score``: the probability of label 1 for each whole text; narrow.

    Null and empty texts have zeros for statistics and are scored by them. Repeated rows get
    equal scores; columns of ``df`` named ``score`` or like the statistics are replaced.
    """
    held = with_statistics(df.drop("score"), text_col)
    return held.withColumn("score", ensemble.column()).drop(*(f"stat_{s}" for s in STATISTICS))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document: whether it was held out, its score and what that predicts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
