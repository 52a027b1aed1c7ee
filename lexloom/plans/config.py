"""Settings: environment over file over defaults."""

from __future__ import annotations

import os
import re
import tomllib
from dataclasses import dataclass
from pathlib import Path

from lexloom.functions.langtag import parse_languages


def flatten(values: dict, prefix: str = "") -> dict[str, object]:
    out: dict[str, object] = {}
    for k, v in values.items():
        key = f"{prefix}{k}".upper()
        out |= flatten(v, f"{key}_") if isinstance(v, dict) else {key: v}
    return out


def load(path: str | None = None, env: dict[str, str] | None = None) -> dict[str, str]:
    """A TOML file's values by the name of their setting, under those of the environment."""
    env = dict(os.environ if env is None else env)
    values = flatten(tomllib.loads(Path(path).read_text())) if path else {}
    text = {k: ",".join(map(str, v)) if isinstance(v, list) else str(v).lower() if isinstance(v, bool) else str(v) for k, v in values.items()}
    return text | env


def number(value: str | None, default: int, low: int, high: int) -> int:
    """A whole number within limits; the default if it is none."""
    if value is None or not re.fullmatch(r"\s*[+-]?\d+\s*", value):
        return default
    return min(max(int(value), low), high)


def share(value: str | None, default: float) -> float:
    try:
        return min(max(float(value), 0.0), 1.0) if value is not None else default
    except ValueError:
        return default


def timeout_ms(values: dict[str, str], own: str, general: str = "REQUEST_TIMEOUT_MS", default: int = 30_000) -> int:
    """The operation's own, else the general one; only whole numbers over 0 count."""
    for name in (own, general):
        text = (values.get(name) or "").strip()
        if re.fullmatch(r"\d+", text) and int(text) > 0:
            return int(text)
    return default


@dataclass(frozen=True)
class Settings:
    similarity_threshold: float = 0.5
    max_results: int = 10
    accepted_languages: tuple[str, ...] = ("en", "no")
    query_languages: tuple[str, ...] = ("en", "no")
    language_threshold: float = 0.2
    chunk_size: int | None = None
    chunk_overlap: int | None = None
    indexing: bool = True
    generated_tags_in_query: bool = False
    dimension: int = 2048
    batch_size: int = 100

    @classmethod
    def of(cls, values: dict[str, str]) -> Settings:
        get = lambda k: values.get(f"LEXLOOM_{k}")
        accepted = tuple(parse_languages(get("ACCEPTED_LANGUAGES")) or cls.accepted_languages)
        return cls(
            similarity_threshold=share(get("SIMILARITY_THRESHOLD"), 0.5),
            max_results=number(get("MAX_RESULTS"), 10, 1, 10_000),
            accepted_languages=accepted,
            query_languages=tuple(parse_languages(get("QUERY_LANGUAGES")) or accepted),
            language_threshold=share(get("LANGUAGE_THRESHOLD"), 0.2),
            chunk_size=number(get("CHUNK_SIZE"), 0, 0, 1_000_000) or None,
            chunk_overlap=None if get("CHUNK_OVERLAP") is None else number(get("CHUNK_OVERLAP"), 0, 0, 1_000_000),
            indexing=(get("INDEXING") or "true").lower() != "false",
            generated_tags_in_query=(get("GENERATED_TAGS_IN_QUERY") or "false").lower() == "true",
            dimension=number(get("DIMENSION"), 2048, 64, 8192),
            batch_size=number(get("BATCH_SIZE"), 100, 1, 4096),
        )
