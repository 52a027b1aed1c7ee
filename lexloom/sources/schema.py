"""The seven tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

VERSION = "1.0.0"

TABLES = {
    "documents": "id string, title string, content string, content_hash string, content_length int, source string, original_filename string, file_extension string, crawl_id string, crawl_url string, author string, description string, content_type string, created_at string, updated_at string, processed_at string, chunks_count int, code_blocks_count int, status string",
    "document_tags": "id string, document_id string, tag string, is_generated boolean, created_at string",
    "document_languages": "id string, document_id string, language_code string, created_at string",
    "chunks": "id string, document_id string, chunk_index int, start_position int, end_position int, content string, content_length int, embedding array<float>, surrounding_context string, semantic_topic string, created_at string",
    "code_blocks": "id string, document_id string, block_id string, block_index int, language string, content string, content_length int, embedding array<float>, source_url string, created_at string",
    "keywords": "id string, keyword string, document_id string, source string, frequency int, created_at string",
    "schema_version": "id long, version string, applied_at string, description string",
}
CHILDREN = ("document_tags", "document_languages", "chunks", "code_blocks", "keywords")


def schema(name: str) -> StructType:
    return StructType.fromDDL(TABLES[name])


def missing(name: str, df: DataFrame) -> list[str]:
    """Required columns that df lacks; further ones are fine."""
    return sorted(set(schema(name).names) - set(df.columns))


def checked(name: str, df: DataFrame) -> DataFrame:
    if lacks := missing(name, df):
        raise ValueError(f"table {name} lacks {', '.join(lacks)}")
    return df


def latest_version(versions: DataFrame) -> str | None:
    """By time applied, then id."""
    return versions.agg(F.max_by("version", F.struct(F.coalesce("applied_at", F.lit("")), "id"))).first()[0]


def conform(name: str, df: DataFrame) -> DataFrame:
    """df's columns cast to the table's, columns it lacks null, others dropped."""
    return df.select(*((F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema(name)))
