"""Rerankers: word overlap as columns; remote ones as calls on few collected rows."""

from __future__ import annotations

from abc import ABC, abstractmethod
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def words(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), "\\s+"), lambda w: w != ""))


def jaccard(query: str, text: Column) -> Column:
    """Shared over all distinct lower-case words; 0 if there are none."""
    asked = list(dict.fromkeys(query.lower().split()))
    own = words(text)
    both = F.size(F.array_intersect(own, F.array(*map(F.lit, asked)).cast("array<string>")))
    every = F.size(own) + len(asked) - both
    return F.when(every == 0, 0.0).otherwise(both / every)


def rerank(candidates: DataFrame, query: str, text_col: str, k: int, id_col: str = "document_id", most: int = 50) -> DataFrame:
    """The best `most` candidates by score, reordered by word overlap, k of them. Joined on the id, never on positions."""
    first = candidates.orderBy(F.desc("score"), id_col).limit(most)
    return first.withColumn("rerank_score", jaccard(query, F.col(text_col))).orderBy(F.desc("rerank_score"), F.desc("score"), id_col).limit(k)


class Reranker(ABC):
    """A model outside: (query, texts) to (index, score), best first."""

    @abstractmethod
    def rerank(self, query: str, texts: list[str], top_k: int) -> list[tuple[int, float]]: ...


class Remote(Reranker):
    """post: (url, headers, json) -> answer. The answer's list of results has index and a score by one of the usual names."""

    def __init__(self, post, url: str, model: str, key: str, most: int = 50):
        self.post, self.url, self.model, self.key, self.most = post, url, model, key, most

    def rerank(self, query: str, texts: list[str], top_k: int) -> list[tuple[int, float]]:
        if not texts:
            return []
        texts = texts[: self.most]
        answer = self.post(self.url, {"Authorization": f"Bearer {self.key}"}, {"model": self.model, "query": query, "documents": texts, "top_n": min(top_k, len(texts))})
        found = [(int(r["index"]), float(r.get("relevance_score", r.get("score", 0.0)))) for r in answer.get("results", answer.get("data", []))]
        return sorted((x for x in found if 0 <= x[0] < len(texts)), key=lambda x: (-x[1], x[0]))[:top_k]


class Chat(Reranker):
    """ask: prompt -> text with a JSON list of {index, score}. Texts are shown up to 500 characters; those not named score 0."""

    def __init__(self, ask, most: int = 50):
        self.ask, self.most = ask, most

    def rerank(self, query: str, texts: list[str], top_k: int) -> list[tuple[int, float]]:
        import json
        import re

        if not texts:
            return []
        texts = texts[: self.most]
        shown = "\n".join(f"[{i}] {t[:500]}" for i, t in enumerate(texts))
        found = re.search(r"\[.*\]", self.ask(f"Query: {query}\n\nDocuments:\n{shown}\n\nAnswer with a JSON list of objects with index and score from 0 to 1."), re.S)
        try:
            named = {int(x["index"]): float(x["score"]) for x in json.loads(found[0])} if found else {}
        except (ValueError, KeyError, TypeError):
            named = {}
        return sorted(((i, named.get(i, 0.0)) for i in range(len(texts))), key=lambda x: (-x[1], x[0]))[:top_k]


class Process(Reranker):
    """A program of this machine: called with the query and the texts as JSON on its input, answers with JSON: results (index, score) or an error."""

    def __init__(self, command: list[str], timeout_s: float = 30.0, most: int = 50):
        self.command, self.timeout_s, self.most = command, timeout_s, most

    def rerank(self, query: str, texts: list[str], top_k: int) -> list[tuple[int, float]]:
        import json
        import subprocess

        if not texts:
            return []
        texts = texts[: self.most]
        asked = json.dumps({"query": query, "documents": texts, "top_k": top_k})
        done = subprocess.run(self.command, input=asked, capture_output=True, text=True, timeout=self.timeout_s, check=False)
        if done.returncode:
            raise RuntimeError(f"the reranker ended with {done.returncode}: {done.stderr[-500:]}")
        answer = json.loads(done.stdout)
        if answer.get("error"):
            raise RuntimeError(answer["error"])
        found = [(int(r["index"]), float(r["score"])) for r in answer["results"] if 0 <= int(r["index"]) < len(texts)]
        return sorted(found, key=lambda x: (-x[1], x[0]))[:top_k]


def local_scores(query: str, texts: list[str], top_k: int) -> list[tuple[int, float]]:
    """What such a program does without a model: shared over all distinct lower-case words."""
    asked = set(query.lower().split())
    scores = [len(asked & own) / len(asked | own) if asked | own else 0.0 for own in (set(t.lower().split()) for t in texts)]
    return sorted(enumerate(scores), key=lambda x: (-x[1], x[0]))[:top_k]


def main() -> None:
    """The program: reads a request from its input."""
    import json
    import sys

    try:
        asked = json.load(sys.stdin)
        answer = {"results": [{"index": i, "score": s} for i, s in local_scores(asked["query"], asked["documents"], int(asked.get("top_k", 10)))]}
    except Exception as e:  # the caller reads the error
        answer = {"error": str(e)}
    print(json.dumps(answer))


@dataclass
class Settings:
    provider: str | None = None
    key: str | None = None
    model_path: str | None = None
    candidates: int = 50
    top_k: int = 10
    timeout_ms: int = 30_000

    @property
    def enabled(self) -> bool:
        return bool(self.key) or self.provider == "local" and bool(self.model_path)

    def errors(self) -> list[str]:
        return [f"{k} must be positive" for k in ("candidates", "top_k", "timeout_ms") if getattr(self, k) <= 0]


def with_model(candidates: DataFrame, query: str, text_col: str, model: Reranker, k: int, most: int = 50, id_col: str = "document_id") -> DataFrame:
    """At most `most` candidates go to the driver and the model; if it fails, their order stays."""
    spark = candidates.sparkSession
    first = candidates.orderBy(F.desc("score"), id_col).limit(most)
    rows = first.collect()
    try:
        order = model.rerank(query, [r[text_col] or "" for r in rows], k)
    except Exception:  # whatever the remote side does, a query has an answer
        order = [(i, float(r["score"])) for i, r in enumerate(rows)][:k]
    kind = candidates.schema[id_col].dataType.simpleString()
    ranked = spark.createDataFrame([(rows[i][id_col], s) for i, s in order], f"`{id_col}` {kind}, rerank_score double")
    return first.join(F.broadcast(ranked), id_col)


if __name__ == "__main__":
    main()
