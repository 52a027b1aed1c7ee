"""The boundary to embedding models: distinct texts go through a provider once, in Arrow batches."""

from __future__ import annotations

import math
import time
from abc import ABC, abstractmethod
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Provider(ABC):
    dimensions: int
    model: str

    @abstractmethod
    def embed(self, text: str) -> list[float]: ...

    def embed_all(self, texts: list[str]) -> list[list[float]]:
        """All at once, or one by one if that fails; a text that fails on its own has no vector."""
        try:
            return self.batch(texts)
        except Exception:  # whatever the remote side does
            out = []
            for t in texts:
                try:
                    out.append(self.embed(t))
                except Exception:
                    out.append([])
            return out

    def batch(self, texts: list[str]) -> list[list[float]]:
        return [self.embed(t) for t in texts]


class Sine(Provider):
    """Deterministic vectors for tests: a seed from the text's characters."""

    model = "sine"

    def __init__(self, dimensions: int = 384):
        self.dimensions = dimensions

    def embed(self, text: str) -> list[float]:
        seed = sum(ord(c) * (i + 1) for i, c in enumerate(text))
        i = np.arange(self.dimensions)
        v = np.sin(seed * i * 0.1) * np.cos(seed * i * 0.05)
        norm = float(np.sqrt(v @ v))
        return (v / norm if norm else v).tolist()


class Http(Provider):
    """post: (url, headers, json) -> answer with data: a list of index and embedding."""

    def __init__(self, post: Callable, url: str, model: str, key: str, dimensions: int, size: int = 100):
        self.post, self.url, self.model, self.key, self.dimensions, self.size = post, url, model, key, dimensions, size

    def batch(self, texts: list[str]) -> list[list[float]]:
        out: list[list[float]] = []
        for at in range(0, len(texts), self.size):
            part = texts[at : at + self.size]
            answer = self.post(f"{self.url}/embeddings", {"Authorization": f"Bearer {self.key}"}, {"model": self.model, "input": part})
            rows = sorted(answer["data"], key=lambda r: r["index"])
            if len(rows) != len(part) or not all(isinstance(x, int | float) for r in rows for x in r["embedding"]):
                raise ValueError("not an embedding for each text")
            out += [list(map(float, r["embedding"])) for r in rows]
        return out

    def embed(self, text: str) -> list[float]:
        return self.batch([text])[0]


class Failover(Provider):
    """The last good provider first; three failures rest one for five minutes. Vectors of another length are an error."""

    def __init__(self, providers: list[Provider], rest_s: float = 300, failures: int = 3):
        self.all, self.at, self.rest_s, self.failures = providers, 0, rest_s, failures
        self.dimensions, self.model = providers[0].dimensions, providers[0].model
        self.bad, self.until = [0] * len(providers), [0.0] * len(providers)

    def _try(self, call: Callable):
        problem: Exception | None = None
        for step in range(len(self.all)):
            i = (self.at + step) % len(self.all)
            if self.until[i] > time.time():
                continue
            try:
                out = call(self.all[i])
            except Exception as e:
                problem, self.bad[i] = e, self.bad[i] + 1
                if self.bad[i] >= self.failures:
                    self.until[i], self.bad[i] = time.time() + self.rest_s, 0
                continue
            self.at, self.bad[i] = i, 0
            return out
        raise RuntimeError("no provider answers") from problem

    def batch(self, texts: list[str]) -> list[list[float]]:
        out = self._try(lambda p: p.batch(texts))
        if any(len(v) != self.dimensions for v in out):
            raise ValueError("a vector of another length")
        return out

    def embed(self, text: str) -> list[float]:
        return self.batch([text])[0]


_providers: dict[tuple, Provider] = {}


def shared(make: Callable[[], Provider], *config) -> Provider:
    """One provider for each configuration and process, made when it is first needed."""
    if config not in _providers:
        _providers[config] = make()
    return _providers[config]


class Remembering(Provider):
    """Asks the provider behind it only for texts that the cache (put, get and key) doesn't hold."""

    def __init__(self, behind: Provider, cache):
        self.behind, self.cache, self.dimensions, self.model = behind, cache, behind.dimensions, behind.model

    def batch(self, texts: list[str]) -> list[list[float]]:
        keys = [self.cache.key(self.model, t) for t in texts]
        found = {k: v for k in dict.fromkeys(keys) if (v := self.cache.get(k)) is not None}
        todo = {k: t for k, t in zip(keys, texts, strict=True) if k not in found}
        for k, v in zip(todo, self.behind.batch(list(todo.values())) if todo else [], strict=True):
            self.cache.put(k, v)
            found[k] = v
        return [found[k] for k in keys]

    def embed(self, text: str) -> list[float]:
        return self.batch([text])[0]


def cache_key(model: str, text: Column) -> Column:
    """Case and outer blanks don't matter: such texts share a vector."""
    return F.substring(F.sha2(F.concat(F.lit(f"{model}:"), F.trim(F.lower(text))), 256), 1, 16)


def embedded(rows: DataFrame, text_col: str, make: Callable[[], Provider], model: str, known: DataFrame | None = None) -> DataFrame:
    """rows with embedding. Each distinct text is embedded once; known (key, embedding) spares those met before."""
    keyed = rows.withColumn("key", cache_key(model, F.col(text_col)))
    texts = keyed.filter(F.col(text_col).isNotNull()).groupBy("key").agg(F.min(text_col).alias("text"))
    if known is not None:
        asked, known = texts.select("key"), known.select("key", F.col("embedding").cast("array<float>").alias("embedding"))
        texts = texts.join(known.select("key"), "key", "left_anti")
        known = known.join(asked, "key", "left_semi")  # the rest of the cache stays where it is

    @F.pandas_udf("array<float>")
    def run(parts: pd.Series) -> pd.Series:
        return pd.Series(provider().embed_all(list(parts)))

    state: dict = {}

    def provider() -> Provider:
        if "p" not in state:
            state["p"] = make()
        return state["p"]

    vectors = texts.select("key", run("text").alias("embedding"))
    if known is not None:
        vectors = vectors.unionByName(known)
    return keyed.join(vectors, "key", "left").drop("key")


def unit(v: list[float]) -> list[float]:
    n = math.sqrt(sum(x * x for x in v))
    return [x / n for x in v] if n else v
