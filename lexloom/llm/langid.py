"""Language identification: multinomial logistic regression on TF-IDF of character n-grams.

n-grams of one to three characters go to hashed features; their document frequencies cover every row that may be learned
from. Follow-the-regularised-leader with an elastic net fits the weights on a bounded sample, and one temperature, fitted
on learnable rows that the weights have not seen, calibrates the scores.

Defined results: a null text or one without a letter is 'und' with score 0; null langs are not learned from; with nothing to
learn from everything is 'und' with score 0; ties go to the language that sorts first; repeated rows are scored alike.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import bounded_sample, per_row, place

FEATURES = 1 << 13
STRETCH = 1 << 17  # code points at a time
MIX = np.uint32(2654435761)


def counts(text: str) -> np.ndarray:
    """n-gram counts by feature; stretches of a long text overlap by two characters, so no n-gram is lost."""
    out = np.zeros(FEATURES)
    low = text.lower()
    for at in range(0, len(low), STRETCH):
        c = np.frombuffer(low[max(0, at - 2) : at + STRETCH].encode("utf-32-le", "surrogatepass"), np.uint32)
        skip = min(at, 2)
        h = c * MIX
        for n in range(1, 4):
            if n > 1:
                if len(h) < 2:
                    break
                h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * MIX + c[n - 1 :] * np.uint32(2246822519 + n)
            out += np.bincount((h * MIX)[max(0, skip - n + 1) :] >> np.uint32(32 - 13), minlength=FEATURES)
    return out


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def document_frequencies(docs: DataFrame, text_col: str) -> tuple[np.ndarray, int]:
    """Over all rows given: summed in each task, then by feature."""

    def run(batches):
        df = np.zeros(FEATURES + 1, np.int64)
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                for text in b.column(0).slice(at, 1000).to_pylist():
                    if has_letter(text):
                        df[:FEATURES] += counts(text) > 0
                        df[FEATURES] += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(df[at])], names=["feature", "n"])

    out = np.zeros(FEATURES + 1, np.int64)
    for r in docs.select(text_col).mapInArrow(run, "feature int, n long").groupBy("feature").agg(F.sum("n")).collect():
        out[r[0]] = r[1]
    return out[:FEATURES], int(out[FEATURES])


def vector(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features that occur, and their values."""
    n = counts(text)
    at = np.flatnonzero(n)
    x = np.sqrt(n[at]) * idf[at]
    return at.astype(np.uint16), (x / max(float(np.sqrt(x @ x)), 1e-12)).astype(np.float32)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(x: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, kinds: int, epochs: int = 3, alpha: float = 1.0, beta: float = 1.0, l1: float = 1e-3, l2: float = 1e-3) -> np.ndarray:
    """Weights (features + bias, kinds) after so many passes in a fixed shuffled order."""
    z, n = np.zeros((FEATURES + 1, kinds)), np.zeros((FEATURES + 1, kinds))

    def weights(at):
        return np.where(np.abs(z[at]) <= l1, 0.0, (np.sign(z[at]) * l1 - z[at]) / ((beta + np.sqrt(n[at])) / alpha + l2))

    rng = np.random.default_rng(7)
    for _ in range(epochs):
        for i in rng.permutation(len(y)):
            at = np.append(x[i][0].astype(np.int64), FEATURES)
            v = np.append(x[i][1].astype(float), 1.0)
            w = weights(at)
            p = softmax(v @ w)
            p[y[i]] -= 1
            g = v[:, None] * p[None]
            grown = n[at] + g * g
            z[at] += g - (np.sqrt(grown) - np.sqrt(n[at])) / alpha * w
            n[at] = grown
    return weights(slice(None))


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """By golden-section search of the likelihood in log temperature."""
    if not len(y):
        return 1.0

    def loss(t: float) -> float:
        z = logits / np.exp(t)
        return float(np.mean(np.log(np.exp(z - z.max(1, keepdims=True)).sum(1)) + z.max(1) - z[np.arange(len(y)), y]))

    a, b, g = -4.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        c, d = b - g * (b - a), a + g * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def logits(x: tuple[np.ndarray, np.ndarray], weights: np.ndarray) -> np.ndarray:
    return x[1].astype(float) @ weights[x[0]] + weights[-1]


class Model:
    def __init__(self, langs: list[str], idf: np.ndarray, weights: np.ndarray, heat: float):
        self.langs, self.idf, self.weights, self.heat = langs, idf, weights, heat

    def logits(self, text: str) -> np.ndarray:
        return logits(vector(text, self.idf), self.weights)

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.langs or not has_letter(text):
            return "und", 0.0
        p = softmax(self.logits(text) / self.heat)
        at = int(p.argmax())
        return self.langs[at], float(p[at])


def trained(docs: DataFrame, learn: Column, each: int = 1500, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most: int = 60_000) -> Model:
    """Fits on at most `each` documents of each language and `most` of all, the first by a hash of their id and text, whole and of any length; every fifth of them is kept for the temperature.

    Texts stay with the executors; their feature vectors come to the driver."""
    seen = docs.filter(learn & F.col(lang_col).isNotNull())
    df, n = document_frequencies(seen, text_col)
    rows = seen.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("of"), F.xxhash64(text_col).alias("th"), F.col(lang_col).alias("kind")).distinct().withColumn("place", place("of", "th"))
    kinds = rows.select("kind").distinct().count()
    chosen = bounded_sample(rows, "kind", max(1, min(each, most // max(1, kinds))))[0].select("of", "th", "kind")
    idf = np.log((1 + n) / (1 + df)) + 1
    same = F.col(id_col).eqNullSafe(F.col("of")) & (F.xxhash64(text_col) == F.col("th")) & (F.col(lang_col) == F.col("kind"))
    picked = seen.select(id_col, text_col, lang_col).join(F.broadcast(chosen), same).select("of", "th", "kind", text_col)  # `most` ids at most are broadcast

    def features():
        def one(text):
            if not has_letter(text):
                return None, None
            at, x = vector(text, idf)
            return at.tobytes(), x.tobytes()  # six bytes a feature, where lists of numbers would be some sixty on the driver

        return one

    found = per_row(picked, [text_col], ["of", "th", "kind"], "at binary, x binary", features).filter("at IS NOT NULL").dropDuplicates(["of", "th", "kind"])
    rows = sorted(found.collect(), key=lambda r: (str(r["of"]), r["th"], r["kind"]))
    langs = sorted({r["kind"] for r in rows})
    if not langs:
        return Model([], np.zeros(FEATURES), np.zeros((FEATURES + 1, 0)), 1.0)
    x, y = [(np.frombuffer(r["at"], np.uint16), np.frombuffer(r["x"], np.float32)) for r in rows], np.array([langs.index(r["kind"]) for r in rows])
    rows.clear()
    aside = np.arange(len(y)) % 5 == 0
    own = np.flatnonzero(~aside) if (~aside).any() else np.arange(len(y))
    weights = ftrl([x[i] for i in own], y[own], len(langs))
    apart = np.flatnonzero(aside)
    heat = temperature(np.array([logits(x[i], weights) for i in apart]).reshape(len(apart), -1), y[apart])
    return Model(langs, idf, weights, heat)


def predicted(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return per_row(docs, [text_col], [id_col], "lang_pred string, score double", lambda: lambda t: model.predict(t))
