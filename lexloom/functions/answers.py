"""Prompts for chat models, and what is read from their answers."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SECTION = "struct<chunk_index:int,title:string,content:string,relevance:double>"


def tags(answer: Column) -> Column:
    """A JSON array, else the first [...] in the text, else parts between commas and line ends of under 50 characters."""
    parse = lambda x: F.from_json(x, "array<string>")
    parts = F.filter(F.split(answer, "[,\\n]"), lambda t: (F.length(F.trim(t)) > 0) & (F.length(F.trim(t)) < 50))
    found = F.coalesce(F.when(F.trim(answer).startswith("["), parse(F.trim(answer))), parse(F.nullif(F.regexp_extract(answer, "(?s)(\\[.*?\\])", 1), F.lit(""))), parts)
    return F.array_distinct(F.filter(F.transform(found, lambda t: F.lower(F.trim(t))), lambda t: t != ""))


def sections(answer: Column) -> Column:
    """The relevant sections of a JSON object, sections without content left out."""
    body = F.regexp_extract(answer, "(?s)(\\{.*\\})", 1)
    found = F.from_json(body, f"struct<relevant_sections:array<{SECTION}>>").getField("relevant_sections")
    return F.coalesce(F.filter(found, lambda s: F.coalesce(F.trim(s["content"]) != "", F.lit(False))), F.from_json(F.lit("[]"), f"array<{SECTION}>"))


def prompt(hits: DataFrame, query: str) -> DataFrame:
    """One row: the query and the numbered chunks with their scores. hits: chunk_index, score, content of one document's best chunks."""
    line = F.printf(F.lit("[%d] (score %.4f) %s"), F.col("chunk_index"), F.col("score"), F.col("content"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "chunk_index", line.alias("line")))), lambda x: x["line"])
    return hits.agg(F.concat(F.lit(f"Query: {query}\n\n"), F.concat_ws("\n", lines)).alias("prompt"))


@dataclass(frozen=True)
class Chat:
    """Where a chat model answers."""

    url: str
    model: str
    key: str | None = None
    max_chunks: int = 12


def chats(values: dict[str, str]) -> tuple[list[Chat], str | None]:
    """The chat models that settings name, the first one preferred; and why there is none.

    LEXLOOM_AI_PROVIDERS: a JSON list of objects with url, model, and perhaps key, max_chunks and priority (lower first). Without
    it LEXLOOM_AI_URL, _MODEL, _KEY and _MAX_CHUNKS name one."""
    most = lambda x: int(x) if str(x or "").strip().isdigit() and int(x) > 0 else 12
    if listed := (values.get("LEXLOOM_AI_PROVIDERS") or "").strip():
        try:
            rows = json.loads(listed)
            found = [Chat(r["url"].rstrip("/"), r["model"], r.get("key"), most(r.get("max_chunks"))) for r in sorted(rows, key=lambda r: r.get("priority", 0))]
        except (ValueError, KeyError, TypeError, AttributeError) as e:
            return [], f"LEXLOOM_AI_PROVIDERS is not a list of providers: {e}"
        return found, None if found else "LEXLOOM_AI_PROVIDERS is empty"
    kind, url, model = ((values.get(f"LEXLOOM_AI_{k}") or "").strip() for k in ("PROVIDER", "URL", "MODEL"))
    if kind and kind.lower() != "openai":
        return [], f"unknown provider: {kind}"
    if not url:
        return [], "LEXLOOM_AI_URL is not set"
    if not model:
        return [], "LEXLOOM_AI_MODEL is not set"
    return [Chat(url.rstrip("/"), model, values.get("LEXLOOM_AI_KEY"), most(values.get("LEXLOOM_AI_MAX_CHUNKS")))], None


class Asker:
    """Asks the last model that answered, then the next ones; three failures rest one for five minutes. post: (url, headers, json) -> answer."""

    def __init__(self, models: list[Chat], post: Callable, rest_s: float = 300, failures: int = 3, clock: Callable[[], float] = time.time):
        if not models:
            raise ValueError("no chat model")
        self.models, self.post, self.rest_s, self.failures, self.clock = models, post, rest_s, failures, clock
        self.at, self.bad, self.until = 0, [0] * len(models), [0.0] * len(models)

    def __call__(self, prompt: str) -> str:
        problem: Exception | None = None
        for i in [(self.at + k) % len(self.models) for k in range(len(self.models))]:
            if self.until[i] > self.clock():
                continue
            m = self.models[i]
            try:
                headers = {"Authorization": f"Bearer {m.key}"} if m.key else {}
                answer = self.post(f"{m.url}/chat/completions", headers, {"model": m.model, "messages": [{"role": "user", "content": prompt}]})
                text = answer["choices"][0]["message"]["content"]
            except Exception as e:  # whatever the remote side does
                problem, self.bad[i] = e, self.bad[i] + 1
                if self.bad[i] >= self.failures:
                    self.until[i], self.bad[i] = self.clock() + self.rest_s, 0
                continue
            self.at, self.bad[i] = i, 0
            return text
        raise RuntimeError("no chat model answers") from problem
