"""Documents with their children, listings and lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions.text import preview


def with_metadata(docs: DataFrame, tags: DataFrame, languages: DataFrame) -> DataFrame:
    """docs with sorted arrays: tags (manual), tags_generated, languages. Each child is summed up once, then joined."""
    t = tags.groupBy(F.col("document_id").alias("id")).agg(
        F.array_sort(F.collect_set(F.when(~F.col("is_generated"), F.col("tag")))).alias("tags"), F.array_sort(F.collect_set(F.when(F.col("is_generated"), F.col("tag")))).alias("tags_generated")
    )
    g = languages.groupBy(F.col("document_id").alias("id")).agg(F.array_sort(F.collect_set("language_code")).alias("languages"))
    none = F.array().cast("array<string>")
    out = docs.join(t, "id", "left").join(g, "id", "left")
    return out.withColumns({c: F.coalesce(c, none) for c in ("tags", "tags_generated", "languages")})


def with_chunks(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """docs with an array of their chunks in order."""
    fields = F.struct("chunk_index", "id", "content", "start_position", "end_position")
    c = chunks.groupBy(F.col("document_id").alias("id")).agg(F.array_sort(F.collect_list(fields)).alias("chunks"))
    return docs.join(c, "id", "left")


def by_id(docs: DataFrame, key, id_col: str = "id") -> DataFrame:
    return docs.filter(F.col(id_col) == F.lit(key)).limit(1)


def by_hash(docs: DataFrame, content_hash: str) -> DataFrame:
    return docs.filter(F.col("content_hash") == F.lit(content_hash)).limit(1)


def by_title(docs: DataFrame, title: str) -> DataFrame:
    return docs.filter(F.col("title") == F.lit(title))


def children(rows: DataFrame, document_id, order: str) -> DataFrame:
    """Chunks (chunk_index) or code blocks (block_index) of one document in order."""
    return rows.filter(F.col("document_id") == F.lit(document_id)).orderBy(order)


def listing(docs: DataFrame, offset: int = 0, limit: int = 50, preview_length: int | None = None) -> DataFrame:
    """By last change, newest first, then id."""
    cols: list[Column] = [F.col(c) for c in ("id", "title", "source", "content_length", "chunks_count", "updated_at")]
    if preview_length is not None:
        cols.append(preview(F.col("content"), preview_length).alias("preview"))
    ordered = docs.select(*cols).orderBy(F.desc("updated_at"), "id")
    return ordered.offset(max(offset, 0)).limit(max(limit, 0))


def sorted_ids(docs: DataFrame) -> DataFrame:
    return docs.select("id").orderBy("id")


def duplicates(docs: DataFrame, hash_col: str = "content_hash", id_col: str = "id") -> DataFrame:
    """Hashes of more than one document: how many, and the first."""
    return docs.groupBy(hash_col).agg(F.count("*").alias("n"), F.min(id_col).alias("first_id")).filter("n > 1")


def code_variants(blocks: DataFrame) -> DataFrame:
    """Code blocks by block_id, with their variants in order."""
    variant = F.struct("block_index", "language", "content")
    return blocks.groupBy("document_id", "block_id").agg(F.min("block_index").alias("block_index"), F.count("*").cast("int").alias("variant_count"), F.array_sort(F.collect_list(variant)).alias("variants"))
