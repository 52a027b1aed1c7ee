"""A quality classifier: histogram gradient-boosted trees over document statistics.

Each statistic is cut into bins at quantiles; a level of a tree is grown from histograms of gradients. Trees are complete
to a fixed depth and lie in flat arrays, so a batch of rows walks all of them with a few numpy look-ups.

Defined results: null and empty texts have all statistics zero and are scored like any row; null labels are not learned from; a
document with several labels counts as good if one says so; without both kinds of label everything scores 0.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from lexloom.llm.common import bounded_sample, per_row, place
from lexloom.llm.rules import statistics

NAMES = ["words", "chars", "mean_word", "symbols", "repeats", "dup_lines", "lines", "line_words", "distinct", "top_word", "top_start", "upper", "digits", "marks", "spaced_marks", "ended"]
UPPER, DIGIT, MARK, LONE = re.compile(r"[A-ZÀ-ÖØ-Þ]"), re.compile(r"[0-9]"), re.compile(r"[^\w\s]"), re.compile(r"(?<!\S)[^\w\s]+(?!\S)")


def features(text: str | None) -> tuple:
    if not text:
        return (0.0,) * len(NAMES)
    n, word_chars, symbols, dup, repeats, lines = statistics(text)
    if not n:
        return (0.0, float(len(text)), *(0.0,) * (len(NAMES) - 2))
    words = text.encode("utf-8", "surrogatepass").split()
    times = Counter(words)
    ended = sum(x.rstrip()[-1:] in ".!?\"'" for x in text.split("\n") if x.strip())
    found = lambda p: sum(1 for _ in p.finditer(text))
    top = max(times.values())
    starts = Counter([w[:2] for w in times])
    values = (n, len(text), word_chars / n, symbols / n, repeats / n, dup / max(lines, 1), lines, n / max(lines, 1), len(times) / n, top / n, max(starts.values()) / len(times), found(UPPER) / len(text), found(DIGIT) / len(text), found(MARK) / len(text), found(LONE) / n, ended / max(lines, 1))
    return tuple(map(float, values))


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return per_row(docs, [text_col], [id_col], ", ".join(f"{x} double" for x in NAMES), lambda: features)


class Trees:
    """feature, cut: (trees, inner nodes); value: (trees, leaves). A row goes right where its statistic is over the cut."""

    def __init__(self, base: float, feature: np.ndarray, cut: np.ndarray, value: np.ndarray):
        self.base, self.feature, self.cut, self.value = base, feature, cut, value

    def logits(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        row, depth = np.arange(len(x)), int(np.log2(self.value.shape[1])) if len(self.value) else 0
        for f, c, v in zip(self.feature, self.cut, self.value, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (x[row, f[at]] > c[at])
            out += v[at - (2**depth - 1)]
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -500, 500)))


def boost(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, bins: int = 64, rate: float = 0.15, shrink: float = 1.0, least: int = 20) -> Trees:
    if not len(y) or not 0 < y.sum() < len(y):
        return Trees(-500.0, np.zeros((0, 2**depth - 1), np.int64), np.zeros((0, 2**depth - 1)), np.zeros((0, 2**depth)))
    k = x.shape[1]
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(k)]
    binned = np.stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(k)])  # bin b: over cuts[b - 1], at most cuts[b]
    base = float(np.log(y.mean() / (1 - y.mean())))
    z = np.full(len(y), base)
    feature, cut, value = np.zeros((trees, 2**depth - 1), np.int64), np.full((trees, 2**depth - 1), np.inf), np.zeros((trees, 2**depth))
    for t in range(trees):
        p = 1 / (1 + np.exp(-z))
        g, h = y - p, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for d in range(depth):
            width, first = 2**d, 2**d - 1
            best = np.full(width, 1e-6)
            gain_at = [None] * width
            for j in range(k):
                key = node * bins + binned[j]
                sums = [np.bincount(key, v, width * bins).reshape(width, bins) for v in (g, h, np.ones(len(y)))]
                lg, lh, ln = (np.cumsum(s, axis=1)[:, : len(cuts[j])] for s in sums)
                ag, ah, an = (s.sum(axis=1, keepdims=True) for s in sums)
                gain = lg**2 / (lh + shrink) + (ag - lg) ** 2 / (ah - lh + shrink) - ag**2 / (ah + shrink)
                gain[(ln < least) | (an - ln < least)] = -1
                if gain.shape[1]:
                    at = gain.argmax(axis=1)
                    for i in np.flatnonzero(gain[np.arange(width), at] > best):
                        best[i], gain_at[i] = gain[i, at[i]], (j, int(at[i]))
            right = np.zeros(len(y), np.int64)
            for i, s in enumerate(gain_at):
                if s:
                    feature[t, first + i], cut[t, first + i] = s[0], cuts[s[0]][s[1]]
                    right |= (node == i) & (binned[s[0]] > s[1])
            node = 2 * node + right
        lg, lh = (np.bincount(node, v, 2**depth) for v in (g, h))
        value[t] = rate * lg / (lh + shrink)
        z += value[t][node]
    return Trees(base, feature, cut, value)


def trained(docs: DataFrame, labels: DataFrame, learn: Column, each: int = 15_000, id_col: str = "doc_id", text_col: str = "text", label: str = "quality") -> Trees:
    """Fits on the statistics of at most `each` documents of each label value, the first by a hash of their id and text; rows with the same id and text are one."""
    known = labels.filter(F.col(label).isNotNull()).groupBy(F.col(id_col).alias("of")).agg(F.max(label).cast("int").alias("y"))
    rows = docs.filter(learn).select(F.col(id_col).alias("of"), F.xxhash64(text_col).alias("th")).distinct().join(known, "of").withColumn("place", place("of", "th"))
    chosen = bounded_sample(rows, "y", each)[0].select("of", "th", "y")
    same = (F.col(id_col) == F.col("of")) & (F.xxhash64(text_col) == F.col("th"))
    picked = docs.select(id_col, text_col).join(F.broadcast(chosen), same).select("y", "of", "th", text_col)  # `each` ids a value are broadcast
    found = per_row(picked, [text_col], ["y", "of", "th"], ", ".join(f"{x} double" for x in NAMES), lambda: features).dropDuplicates(["of", "th"]).collect()
    found = sorted(found, key=lambda r: (str(r["of"]), r["th"]))
    x = np.array([tuple(r)[3:] for r in found], float).reshape(-1, len(NAMES))
    return boost(x, np.array([r["y"] for r in found], float))


def scored(docs: DataFrame, trees: Trees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score; rows are measured and walk the trees a batch at a time."""
    docs = docs.select(id_col, text_col)

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                x = np.array([features(t) for t in part.column(1).to_pylist()], float).reshape(-1, len(NAMES))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(trees.scores(x))], names=[id_col, "score"])

    return docs.mapInArrow(run, StructType([docs.schema[id_col], StructField("score", DoubleType())]))
