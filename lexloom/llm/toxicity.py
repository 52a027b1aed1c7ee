"""Toxicity by multiple-instance learning.

A document is a bag of sentences. Each sentence has a logistic score of its words and of their first four and five letters,
and a noisy-or of these scores is the document's; in a long one that of its worst passage, as any number of clean sentences
would add up to a toxic one. Only documents have labels. The noisy-or's likelihood trains the word weights (proximal adaptive gradient with
an L1 penalty), so the weight goes to the sentences that explain a label, and these are the ones pointed out.

Defined results: null and empty texts have no sentence and score 0; a document with several labels counts as toxic if one
says so; null labels are not learned from; repeated rows are scored alike; without both kinds of label everything scores 0.
"""

from __future__ import annotations

import math
import re
from array import array
from zlib import crc32

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import bounded_sample, fresh, per_row, place

SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"[^\W\d_]+")


def sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, each: int, id_col: str = "doc_id", text_col: str = "text", most_chars: int = 12_000_000) -> tuple[list[tuple[str, int]], dict[int, int]]:
    """Texts and labels to fit on: of each label value, at most `each` documents, the first by a hash of their id and text, and up to about most_chars characters, whole and of any length. And how many of each value there are. Rows with the same id and text are one."""
    known = labels.filter(F.col(label).isNotNull()).groupBy(F.col(id_col).alias("of")).agg(F.max(label).cast("int").alias("y"))
    rows = docs.filter(learn & F.col(text_col).isNotNull()).select(F.col(id_col).alias("of"), F.xxhash64(text_col).alias("th"), F.length(text_col).alias("chars"))
    rows = rows.groupBy("of", "th").agg(F.max("chars").alias("chars")).join(known, "of").withColumn("place", place("of", "th"))
    chosen, of_all = bounded_sample(rows, "y", each, "chars", most_chars)
    # at most `each` rows for each label value are broadcast
    found = docs.filter(F.col(text_col).isNotNull()).select(id_col, text_col).join(F.broadcast(chosen.select("of", "th", "y")), (F.col(id_col) == F.col("of")) & (F.xxhash64(text_col) == F.col("th"))).select("of", "y", text_col)
    texts = {(str(r[0]), r[2], r[1]) for r in found.dropDuplicates(["of", text_col]).collect()}
    return [(t, y) for _, t, y in sorted(texts)], of_all


def marks(word: str) -> tuple[int, ...]:
    """Numbers of the word and its beginnings: CRC-32."""
    return tuple(map(crc32, (word.encode(), word[:4].encode() + b"-", word[:5].encode() + b"-")))


def softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


def fit(texts: list[tuple[str, int]], of_all: dict[int, int], least_docs: int = 4, rounds: int = 150, rate: float = 0.3, penalty: float = 2e-4) -> tuple[dict[int, float], float]:
    """Weights of words and beginnings that are not zero, and the bias."""
    y = np.array([t[1] for t in texts], float)
    if not len(y) or not 0 < y.sum() < len(y):
        return {}, -50.0
    doc, sent, feat, per_doc, n = array("i"), array("i"), array("I"), [], 0  # numbers only: the texts' words would not fit the driver
    for i, (text, _) in enumerate(texts):
        start = len(feat)
        for m in SENTENCE.finditer(text):
            own = {x for w in set(WORD.findall(m[0].lower())) for x in marks(w)}
            feat.extend(own)
            sent.extend([n] * len(own))
            doc.append(i)
            n += 1
        per_doc.append(np.unique(np.array(feat[start:], np.uint32)))
    doc, sent, feat = np.frombuffer(doc, np.int32), np.frombuffer(sent, np.int32), np.frombuffer(feat, np.uint32)
    names, df = np.unique(np.concatenate(per_doc), return_counts=True)
    names = names[df >= least_docs]
    at = np.minimum(np.searchsorted(names, feat), max(len(names) - 1, 0))
    known = names[at] == feat if len(names) else np.zeros(len(feat), bool)
    sent, feat = sent[known], at[known].astype(np.int32)
    share = of_all[1] / (of_all[0] + of_all[1])
    weight = np.where(y > 0, share / y.mean(), (1 - share) / (1 - y.mean())) / len(y)  # as often as among all labels
    w, b = np.zeros(len(names)), -math.log(max(2.0, n / len(y)) * 2)
    gw, gb = np.full(len(names), 1e-8), 1e-8
    for _ in range(rounds):
        z = b + np.bincount(sent, w[feat], n)
        total = np.maximum(np.bincount(doc, softplus(z), len(y)), 1e-9)
        slope = weight * np.where(y > 0, -1 / np.expm1(np.minimum(total, 50)), 1.0)
        g = slope[doc] / (1 + np.exp(-z))
        dw, db = np.bincount(feat, g[sent], len(names)), g.sum()
        gw, gb = gw + dw * dw, gb + db * db
        step = rate / np.sqrt(gw)
        w = w - step * dw
        w = np.sign(w) * np.maximum(np.abs(w) - step * penalty, 0)
        b -= rate / math.sqrt(gb) * db
    return {int(names[i]): float(w[i]) for i in np.flatnonzero(np.abs(w) > 1e-3)}, float(b)


class Weights(dict):
    """Word -> the sum of its marks' weights, filled as words are met and emptied when it has grown."""

    def __init__(self, of: dict[int, float], most: int = 200_000):
        self.of, self.most = of, most

    def __missing__(self, word: str) -> float:
        if len(self) >= self.most:
            self.clear()
        self[word] = out = sum(self.of.get(x, 0.0) for x in marks(word))
        return out


def passage(rest: float) -> int:
    """How many sentences in a row are scored together: those without a weight, each of which adds rest, come to 0.3 at most (a score of 0.26), for 4 sentences or more."""
    return max(4, min(128, int(0.3 / rest)))


def scorer(weights: dict[int, float], bias: float, point_out: float = 0.5):
    """text -> score, the spans of the sentences with a score of point_out or more."""
    of = Weights(weights).__getitem__
    rest = math.log1p(math.exp(bias))
    most = passage(rest)

    def score(text: str | None) -> tuple[float, list[dict]]:
        if not text:
            return 0.0, []
        own, found = [], []
        if not any(map(of, set(WORD.findall(text.lower())))):
            return -math.expm1(-rest * min(most, len(SENTENCE.findall(text)))), found
        for m in SENTENCE.finditer(text):
            z = bias + math.fsum(map(of, set(WORD.findall(m[0].lower()))))  # fsum: in any order
            own.append(z if z > 40 else math.log1p(math.exp(z)))
            if z >= 0 and (p := 1 / (1 + math.exp(-z))) >= point_out:
                found.append({"start": m.start(), "end": m.end(), "score": p})
        if len(own) <= most:
            return -math.expm1(-sum(own)), found
        upto = np.concatenate([[0.0], np.cumsum(own)])
        return -math.expm1(-float((upto[most:] - upto[:-most]).max())), found

    return score


def scored(docs: DataFrame, weights: dict[int, float], bias: float, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """keep (the id) with score and the spans of offending sentences, in code points."""
    return per_row(docs, [text_col], keep or [id_col], "score double, offending array<struct<start:int,end:int,score:double>>", lambda: scorer(weights, bias))


def trained(docs: DataFrame, labels: DataFrame, learn: Column, each: int = 2500, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic") -> tuple[dict[int, float], float]:
    return fit(*sample(docs, labels, label, learn, each, id_col, text_col))


def clean(docs: DataFrame, weights: dict[int, float], bias: float, text_col: str = "text", most: float = 0.5) -> DataFrame:
    """The rows of docs with a score under most, with docs' columns."""
    flag = fresh(docs, "toxic")

    def make():
        score = scorer(weights, bias)
        return lambda text: (score(text)[0] >= most,)

    return per_row(docs, [text_col], docs.columns, f"`{flag}` boolean", make).filter(~F.col(flag)).drop(flag)
