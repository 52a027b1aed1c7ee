"""Detecting the language of a text, from profiles of character trigrams that are counted over given texts."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions.batches import by_row
from lexloom.functions.text import letter_count


class Letters(dict):
    """A table for str.translate that puts a blank for all but letters."""

    def __missing__(self, c: int) -> int:
        self[c] = c if chr(c).isalpha() else 32
        return self[c]


LETTERS = Letters()


def words(text: str) -> Counter:
    return Counter(text.lower().translate(LETTERS).split())


def trigrams(word: str) -> list[str]:
    """Of the word between two blanks."""
    w = f" {word} "
    return [w[i : i + 3] for i in range(len(w) - 2)]


def profiles(texts: DataFrame, text_col: str = "text", lang_col: str = "lang", top: int = 400) -> dict[str, dict[str, float]]:
    """Language -> its most frequent trigrams with their log share; counted by Spark over all texts given, by word first."""
    own = F.filter(F.split(F.lower(text_col), "[^\\p{L}]+"), lambda w: w != "")
    found = texts.filter(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.explode(own).alias("w")).groupBy("lang", "w").agg(F.count("*").alias("k"))
    padded = F.concat(F.lit(" "), F.col("w"), F.lit(" "))
    grams = found.select("lang", "k", F.explode(F.transform(F.sequence(F.lit(1), F.length("w")), lambda i: F.substring(padded, i, 3))).alias("g")).groupBy("lang", "g").agg(F.sum("k").alias("n"))
    share = F.log(F.col("n") / F.sum("n").over(Window.partitionBy("lang")))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "g"))
    out: dict[str, dict[str, float]] = {}
    for r in grams.withColumn("p", share).withColumn("nth", nth).filter(F.col("nth") <= top).collect():  # top rows a language
        out.setdefault(r["lang"], {})[r["g"]] = r["p"]
    return out


class Detector:
    """Mean log share of a text's trigrams under each profile; what words weigh is remembered."""

    def __init__(self, known: dict[str, dict[str, float]], floor: float = -12.0, most: int = 200_000):
        self.langs, self.floor, self.most = sorted(known), floor, most
        self.tables = [known[x] for x in self.langs]
        self.seen: dict[str, int] = {}  # word -> row of weights, whose first number is how many trigrams it has
        self.weights = np.zeros((1 << 10, len(self.langs) + 1))

    def word(self, w: str) -> int:
        at = self.seen.get(w)
        if at is None:
            at = self.seen[w] = len(self.seen)
            if at == len(self.weights):
                self.weights = np.concatenate([self.weights, np.zeros_like(self.weights)])
            g = trigrams(w)
            self.weights[at] = [len(g), *(sum(t.get(x, self.floor) for x in g) for t in self.tables)]
        return at

    def __call__(self, text: str | None) -> tuple[str, float]:
        """Language and how sure; unknown without letters."""
        found = words(text or "")
        if not found or not self.langs:
            return "unknown", 0.0
        if len(self.seen) >= self.most:
            self.seen.clear()
        at = [self.word(w) for w in found]
        # one word after the other, as a loop would add them up
        n, *fit = np.cumsum(self.weights[at] * np.fromiter(found.values(), float, len(found))[:, None], axis=0)[-1].tolist()
        best = max(range(len(fit)), key=fit.__getitem__)
        return self.langs[best], 1 / sum(math.exp(max(-700.0, (f - fit[best]) / n * min(n, 50))) for f in fit)


def detected(text: Column, known: dict[str, dict[str, float]], threshold: float = 0.2, least_letters: int = 20) -> Column:
    """Array of one code; unknown for texts with few letters or an unsure answer."""

    def make():
        detect = Detector(known)

        def run(x):
            found, sure = detect(x)
            return found if sure >= threshold else "unknown"

        return run

    return F.array(F.when(letter_count(F.coalesce(text, F.lit(""))) < least_letters, "unknown").otherwise(by_row(make, "string", text)))
