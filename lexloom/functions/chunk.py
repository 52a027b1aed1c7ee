"""Recursive splitting of texts into overlapping chunks."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions.batches import by_row
from lexloom.functions.text import content_kind

#: Size and overlap for each kind of content; separators of plain text and of code.
SIZES = {"code": (500, 100), "markdown": (800, 160), "html": (600, 120), "text": (1000, 200), "mixed": (600, 120)}
PLAIN = ["\n\n", "\n", " ", ""]
CODE = ["\nfunction ", "\nconst ", "\nlet ", "\nvar ", "\nclass ", "\nif ", "\nfor ", "\nwhile ", "\nswitch ", "\ncase ", "\ndefault ", "\n\n", "\n", " ", ""]


def merge(pieces: list[str], size: int, overlap: int) -> list[str]:
    """Neighbouring pieces up to size; each next chunk starts with the last pieces that fit the overlap."""
    out, held, total = [], [], 0
    for p in pieces:
        if held and total + len(p) > size:
            out.append("".join(held).strip())
            while held and (total > overlap or total + len(p) > size):
                total -= len(held.pop(0))
        held.append(p)
        total += len(p)
    if held:
        out.append("".join(held).strip())
    return [x for x in out if x]


def split(text: str, size: int, overlap: int, marks: list[str]) -> list[str]:
    mark = next((m for m in marks if not m or m in text), "")
    rest = marks[marks.index(mark) + 1 :] if mark else []
    pieces = [p for p in re.split(f"(?={re.escape(mark)})", text) if p] if mark else list(text)
    out, small = [], []
    for p in pieces:
        if len(p) < size:
            small.append(p)
            continue
        out += merge(small, size, overlap)
        small = []
        out += split(p, size, overlap, rest) if rest else [p]
    return out + merge(small, size, overlap)


def chunks(text: str | None, kind: str, size: int | None = None, overlap: int | None = None) -> list[dict]:
    """Chunks with their places; a chunk that isn't found after the last one is looked for from the beginning."""
    base = SIZES[kind]
    size, overlap = size or base[0], base[1] if overlap is None else overlap
    out, at = [], 0
    for i, c in enumerate(split(text or "", size, min(overlap, size), CODE if kind == "code" else PLAIN)):
        start = (text or "").find(c, at)
        start = start if start >= 0 else max((text or "").find(c), -1)
        start = start if start >= 0 else at
        at = start + len(c)
        out.append({"chunk_index": i, "start_position": start, "end_position": at, "content": c})
    return out


CHUNKS = "array<struct<chunk_index:int,start_position:int,end_position:int,content:string>>"


def chunked(text: Column, size: int | None = None, overlap: int | None = None) -> Column:
    """Array of chunks of a text, sized by its kind."""
    return by_row(lambda: lambda t, kind: chunks(t, kind, size, overlap), CHUNKS, text, content_kind(F.coalesce(text, F.lit(""))))


def exploded(docs: DataFrame, id_col: str, text_col: str, size: int | None = None, overlap: int | None = None) -> DataFrame:
    return docs.select(F.col(id_col).alias("document_id"), F.explode(chunked(F.col(text_col), size, overlap)).alias("c")).select("document_id", "c.*", F.length("c.content").alias("content_length"))
