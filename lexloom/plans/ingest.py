"""From raw documents to rows of all tables.

What costs (pages, languages, vectors) is written once, to the store's staging folder; the tables' rows are derived from there,
so a model sees each text once and counts agree with rows.

Defined results: a document's id is a hash of its title, content, source and URL, so rows that agree in these are one document (that with
the least other values), and one that is stored already is not added again; rows without a title or content have an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.functions import chunk, html, langtag, markdown, text
from lexloom.functions.embed import Provider, cache_key, embedded
from lexloom.functions.language import detected
from lexloom.operators import keyword
from lexloom.sources.store import MARKS, VECTORS, Store, now

OPTIONAL = ["original_filename", "file_extension", "crawl_id", "crawl_url", "author", "description", "content_type", "programming_language"]


def prepared(raw: DataFrame) -> DataFrame:
    """raw (title, content, and what there is of source, tags and the optional columns) with all of them; HTML becomes its text and title."""
    for c in [*OPTIONAL, "source"]:
        raw = raw if c in raw.columns else raw.withColumn(c, F.lit(None).cast("string"))
    raw = raw if "tags" in raw.columns else raw.withColumn("tags", F.array().cast("array<string>"))
    for c in OPTIONAL:
        raw = raw.withColumn(c, text.nullable(F.col(c)))
    is_html = (text.content_type(F.col("content_type")) == "text/html") | text.looks_like_html(F.coalesce("content", F.lit("")))
    page = F.when(is_html, html.extracted(F.when(is_html, F.col("content")), F.col("crawl_url")))
    raw = raw.withColumn("page", page).withColumns({"title": F.coalesce(F.nullif(F.col("page.title"), F.lit("")), "title", F.lit("")), "content": F.coalesce(F.col("page.text"), F.col("content"), F.lit(""))})
    raw = raw.withColumn("source", text.normalize_source(F.coalesce("source", F.lit("api")))).withColumn("tags", text.normalize_tags(F.coalesce("tags", F.array().cast("array<string>"))))
    return raw.withColumn("id", text.uuid_of(F.col("title"), F.col("content"), F.col("source"), F.coalesce("crawl_url", F.lit(""))))


def rows(raw: DataFrame, make: Callable[[], Provider], model: str, languages: dict | None = None, accepted: list[str] | None = None, size: int | None = None, overlap: int | None = None, stamp: str | None = None, keep: Callable[[DataFrame], DataFrame] = lambda df: df, known: DataFrame | None = None) -> dict[str, DataFrame]:
    """Table -> new rows. known (key, embedding): vectors of texts that the model has seen. languages: profiles to detect with; without them every document is 'unknown'. accepted: documents in other languages are left out.

    keep: called with what is read more than once; gives the same rows, written."""
    at = F.lit(stamp or now())
    docs = prepared(raw)
    docs = docs.withColumn("languages", detected(F.col("content"), languages) if languages else F.array(F.lit("unknown")))
    docs = docs.filter(langtag.allowed(F.col("languages"), accepted))
    rest = [c for c in docs.columns if c != "id"]
    docs = keep(docs.groupBy("id").agg(F.min(F.struct(*rest)).alias("r")).select("id", "r.*"))
    chunks = chunk.exploded(docs, "id", "content", size, overlap)
    chunks = keep(embedded(chunks.withColumn("id", text.uuid_of(F.lit("chunk"), F.col("document_id"), F.col("chunk_index"))), "content", make, model, known).filter(F.size("embedding") > 0).withColumn("created_at", at))
    blocks = code_rows(docs, chunks).withColumn("id", text.uuid_of(F.lit("block"), *(F.col(c) for c in ("document_id", "block_id", "block_index", "language", "content")))).withColumn("content_length", F.length("content"))
    seen = vectors(chunks, model).select("key", "embedding")
    seen = seen if known is None else seen.join(known.select("key"), "key", "left_anti").unionByName(known)
    blocks = keep(embedded(blocks, "content", make, model, seen).filter(F.size("embedding") > 0).withColumn("created_at", at))
    count = lambda df, name: df.groupBy(F.col("document_id").alias("id")).agg(F.count("*").cast("int").alias(name))
    documents = docs.join(count(chunks, "chunks_count"), "id", "left").join(count(blocks, "code_blocks_count"), "id", "left").fillna(0, ["chunks_count", "code_blocks_count"])
    documents = documents.withColumns({"content_hash": text.content_hash(F.col("content")), "content_length": F.length("content"), "status": F.lit("active"), "created_at": at, "updated_at": at, "processed_at": at})
    tags = docs.select(F.col("id").alias("document_id"), F.explode("tags").alias("tag")).withColumns({"id": text.uuid_of(F.lit("tag"), F.col("document_id"), F.col("tag")), "is_generated": F.lit(False), "created_at": at})
    codes = docs.select(F.col("id").alias("document_id"), F.explode("languages").alias("language_code")).withColumns({"id": text.uuid_of(F.lit("lang"), F.col("document_id"), F.col("language_code")), "created_at": at})
    words = keyword.index(docs).withColumns({"id": text.uuid_of(F.lit("keyword"), F.col("document_id"), F.col("source"), F.col("keyword")), "created_at": at})
    return {"documents": documents, "document_tags": tags, "document_languages": codes, "chunks": chunks, "code_blocks": blocks, "keywords": words}


def vectors(rows: DataFrame, model: str) -> DataFrame:
    """key, model, embedding of each text of rows (content, embedding), once."""
    keyed = rows.filter(F.size("embedding") > 0).groupBy(cache_key(model, F.col("content")).alias("key")).agg(F.any_value(F.col("embedding").cast("array<float>")).alias("embedding"))
    return keyed.select("key", F.lit(model).alias("model"), "embedding")


def code_rows(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """document_id, source_url, block_id, block_index, language, content: blocks of pages, fences of Markdown, and every chunk of a text without fences that is code by its name."""
    cols = ["document_id", "source_url", "b.block_id", "b.block_index", "b.language", "b.content"]
    key = [F.col("id").alias("document_id"), F.col("crawl_url").alias("source_url")]
    own = docs.select(*key, F.explode(F.coalesce(F.col("page.code_blocks"), F.array().cast(f"array<{html.BLOCK}>"))).alias("b")).select(*cols)
    fenced = docs.withColumn("fences", markdown.code_blocks(F.col("content")))
    inside = fenced.select(*key, F.explode("fences").alias("b")).select(*cols)
    language = langtag.code_language(F.col("programming_language"), F.col("file_extension"), F.col("original_filename"))
    files = fenced.filter(F.size("fences") == 0).withColumn("language", language).filter("language IS NOT NULL").select(*key, "language")
    part = chunks.select("document_id", F.concat(F.lit("block-"), F.col("chunk_index").cast("string")).alias("block_id"), F.col("chunk_index").alias("block_index"), "content")
    return own.unionByName(inside).unionByName(files.join(part, "document_id").select("document_id", "source_url", "block_id", "block_index", "language", "content"))


def ingest(store: Store, raw: DataFrame, make: Callable[[], Provider], model: str, replace_titles: bool = False, **options) -> int:
    """Adds documents in one new version. replace_titles: stored documents of the same titles go in the same version."""
    with store.staging() as keep:
        known = store.vectors(model)
        new = {n: keep(df) for n, df in rows(raw, make, model, keep=keep, known=known, **options).items()}
        both = vectors(new["chunks"].select("content", "embedding").unionByName(new["code_blocks"].select("content", "embedding")), model)
        fresh = keep(both if known is None else both.join(known.select("key"), "key", "left_anti"))
        learnt = {} if fresh.isEmpty() else {VECTORS: fresh}  # in the same version as the rows
        ids = new["documents"].select(F.col("id").alias("document_id"))

        def change():
            stored = store.table("documents")
            if replace_titles:
                gone = stored.join(new["documents"].select("title"), "title", "left_semi").select(F.col("id").alias("document_id"))
                return {}, store.accepted(new) | learnt | ({} if gone.isEmpty() else {MARKS: store.markers(keep(gone))})
            there = ids.join(stored.select(F.col("id").alias("document_id")), "document_id", "left_semi")
            if there.isEmpty():
                return {}, store.accepted(new) | learnt
            there = keep(there)
            left = {n: df.join(there, "document_id", "left_anti") for n, df in new.items() if n != "documents"}
            left["documents"] = new["documents"].join(there.withColumnRenamed("document_id", "id"), "id", "left_anti")
            return {}, store.accepted(left) | learnt

        return store.commit(change)
