"""Filters of documents: semi joins on the bridge tables, and the metadata predicate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions.langtag import matches


def equal(column: str, value) -> Column:
    return F.col(column) == F.lit(value)


def among(column: str, values: list) -> Column:
    return F.col(column).isin(values) if values else F.lit(False)


def by_ids(docs: DataFrame, ids: list, id_col: str = "id") -> DataFrame:
    return docs.filter(among(id_col, ids))


def tags_any(rows: DataFrame, tags: DataFrame, wanted: list[str], key: str = "document_id") -> DataFrame:
    """Rows whose document has any of the tags."""
    ids = tags.filter(among("tag", [t.lower() for t in wanted])).select(F.col("document_id").alias(key))
    return rows.join(ids, key, "left_semi")


def tags_all(rows: DataFrame, tags: DataFrame, wanted: list[str], key: str = "document_id", generated: bool = False) -> DataFrame:
    """Rows whose document has all of the tags; generated tags count only if told so."""
    names = sorted({t.lower() for t in wanted})
    own = tags.filter(among("tag", names))
    if not generated:
        own = own.filter(~F.col("is_generated"))
    ids = own.groupBy(F.col("document_id").alias(key)).agg(F.countDistinct("tag").alias("n")).filter(F.col("n") == len(names)).select(key)
    return rows.join(ids, key, "left_semi") if names else rows


def languages_any(rows: DataFrame, languages: DataFrame, wanted: list[str], key: str = "document_id") -> DataFrame:
    ids = languages.filter(among("language_code", [x.lower() for x in wanted])).select(F.col("document_id").alias(key))
    return rows.join(ids, key, "left_semi")


def documents_with(rows: DataFrame, docs: DataFrame, condition: Column, key: str = "document_id") -> DataFrame:
    """Rows whose document meets a condition: source, crawl_id, status and the like."""
    return rows.join(docs.filter(condition).select(F.col("id").alias(key)), key, "left_semi")


def storage_filter(rows: DataFrame, docs: DataFrame, tags: DataFrame, languages: DataFrame, wanted: dict, key: str = "document_id") -> DataFrame:
    """All of: tags (any), languages (any), source, crawl_id, status, author, content_type, created and updated ranges."""
    if wanted.get("tags"):
        rows = tags_any(rows, tags, wanted["tags"], key)
    if wanted.get("languages"):
        rows = languages_any(rows, languages, wanted["languages"], key)
    for name in ("source", "crawl_id", "status", "author", "content_type"):
        if wanted.get(name) is not None:
            rows = documents_with(rows, docs, equal(name, wanted[name]), key)
    for name, column in (("created", "created_at"), ("updated", "updated_at")):
        if wanted.get(f"{name}_after") is not None:
            rows = documents_with(rows, docs, F.col(column) >= F.lit(wanted[f"{name}_after"]), key)
        if wanted.get(f"{name}_before") is not None:
            rows = documents_with(rows, docs, F.col(column) <= F.lit(wanted[f"{name}_before"]), key)
    return rows


def metadata(wanted: dict, generated_count: bool = False) -> Column:
    """The predicate of a query on joined documents (columns source, crawl_id, author, content_type, tags, tags_generated, languages)."""
    keep = F.lit(True)
    if wanted.get("tags"):
        have = F.array_union(F.col("tags"), F.col("tags_generated")) if generated_count else F.col("tags")
        for tag in wanted["tags"]:
            keep = keep & F.array_contains(have, tag.lower())
    for name in ("source", "crawl_id", "author"):
        if wanted.get(name):
            keep = keep & F.coalesce(equal(name, wanted[name]), F.lit(False))
    kind = wanted.get("contentType") or wanted.get("content_type")
    if kind:
        keep = keep & F.coalesce(equal("content_type", kind), F.lit(False))
    if wanted.get("languages"):
        keep = keep & matches(F.col("languages"), wanted["languages"])
    return keep


def parsed(text: str, columns: list[str], nested: str | None = None) -> Column:
    """Conditions key = 'value' in a text, joined by and; values become booleans or numbers where they look like it. A key that is no column
    is looked for in the map column `nested`. A text without a condition lets all through."""
    import re

    keep = F.lit(True)
    for key, quoted, plain in re.findall(r"(\w+)\s*=\s*(?:'([^']*)'|([\w.+-]+))", text or ""):
        value = quoted or plain
        own = F.col(key) if key in columns else F.col(nested)[key] if nested else F.lit(None)
        if value in ("true", "false"):
            test = own.cast("boolean") == F.lit(value == "true")
        elif re.fullmatch(r"[+-]?\d+(\.\d+)?", value):
            test = own.cast("double") == F.lit(float(value))
        else:
            test = own.cast("string") == F.lit(value)
        keep = keep & F.coalesce(test, F.lit(False))
    return keep
