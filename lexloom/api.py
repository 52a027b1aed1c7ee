"""The tools of a document server over a store."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.functions import answers
from lexloom.functions.embed import Provider
from lexloom.functions.langtag import tag_of
from lexloom.operators import documents, fusion, hybrid, stats, validate, vector
from lexloom.plans import ingest
from lexloom.plans.config import Settings
from lexloom.sources import http, uploads
from lexloom.sources.crawl import Crawl
from lexloom.sources.store import Store
from lexloom.sources.vector_index import VectorIndex


class Tools:
    def __init__(self, store: Store, make: Callable[[], Provider], settings: Settings | None = None, languages: dict | None = None):
        self.store, self.make, self.settings, self.languages = store, make, settings or Settings(), languages
        self.provider = make()

    def _tables(self) -> dict[str, DataFrame]:
        t = self.store.tables()
        return {"documents": t["documents"], "tags": t["document_tags"], "languages": t["document_languages"], "chunks": t["chunks"], "keywords": t["keywords"], "code_blocks": t["code_blocks"]}

    def _index(self) -> VectorIndex | None:
        """The vector index beside the store, if one was built."""
        index = VectorIndex(self.store.spark, f"{self.store.path}-index")
        return index if index.exists() else None

    def build_index(self, kind: str = "graph", **options) -> int:
        """A vector index over all chunks; from then on queries take their candidates from it, and ingests add to it."""
        return VectorIndex(self.store.spark, f"{self.store.path}-index").fit(self.store.table("chunks"), kind, **options)

    def sync_index(self, **options) -> bool:
        """Adds the chunks that the index lacks, or fits it anew where the rows have drifted; whether there was something to do. Chunks that went are passed over when queries read."""
        index = self._index()
        if index is None:
            return False
        chunks = self.store.table("chunks")
        new = chunks.select("id", "embedding").join(index.rows().select(F.explode("ids").alias("id")), "id", "left_anti")
        if new.isEmpty():
            return False
        index.append(new)
        if index.needs_fit():
            index.fit(chunks, index.model()["kind"], **options)
        return True

    def _ingest(self, rows: list[dict], names: str, **options) -> int:
        raw = self.store.spark.createDataFrame(rows, names)
        version = self._ingested(raw, **options)
        self.sync_index()
        return version

    def _ingested(self, raw: DataFrame, **options) -> int:
        accepted = list(self.settings.accepted_languages) if self.languages else None
        return ingest.ingest(self.store, raw, self.make, self.provider.model, languages=self.languages, accepted=accepted, size=self.settings.chunk_size, overlap=self.settings.chunk_overlap, **options)

    def add_document(self, title: str, content: str, metadata: dict | None = None, source: str = "api") -> str | int:
        """The new version, or what is wrong as a text."""
        if not (title or "").strip() or not (content or "").strip():
            return "title and content must not be empty"
        m = metadata or {}
        row = {"title": title, "content": content, "source": source, "tags": list(m.get("tags") or [])} | {c: m.get(c) for c in ingest.OPTIONAL}
        return self._ingest([row], ", ".join(["title string, content string, source string, tags array<string>", *(f"{c} string" for c in ingest.OPTIONAL)]))

    def crawl_documentation(self, seed_url: str, fetch: Callable = http.fetch, max_pages: int = 100, max_depth: int = 5, same_domain_only: bool = True, crawl_id: str = "crawl") -> dict:
        crawl = Crawl(fetch, max_pages, max_depth, same_domain_only)
        pages = crawl.run(seed_url)
        if pages:
            self._ingest([{"title": p["title"], "content": p["text"], "source": "crawl", "crawl_id": crawl_id, "crawl_url": p["url"]} for p in pages], "title string, content string, source string, crawl_id string, crawl_url string")
        return {"crawl_id": crawl_id, "pages": len(pages), "errors": crawl.errors}

    def process_uploads(self, folder: str, pdf: Callable | None = None) -> dict:
        """All supported files; a stored document of the same title gives way."""
        return self._uploaded(uploads.read(self.store.spark, folder, pdf))

    def process_upload(self, folder: str, path: str, title: str | None = None, pdf: Callable | None = None) -> dict:
        """One file within the folder, perhaps under another title."""
        found = uploads.read_one(self.store.spark, folder, path, pdf)
        return self._uploaded(found.withColumn("title", F.lit(title)) if title else found)

    def _uploaded(self, found: DataFrame) -> dict:
        good = found.filter("error IS NULL").select("title", "content", F.lit("upload").alias("source"), F.element_at(F.split("path", "/"), -1).alias("original_filename"), F.col("extension").alias("file_extension"))
        n = good.count()
        if n:
            ingest.ingest(self.store, good, self.make, self.provider.model, replace_titles=True, languages=self.languages)
            self.sync_index()
        return {"processed": n, "errors": [f"{r['title']}: {r['error']}" for r in found.filter("error IS NOT NULL").collect()]}

    def list_uploads_files(self, folder: str) -> DataFrame:
        return uploads.listed(self.store.spark, folder)

    def statistics(self) -> DataFrame:
        """Rows of each table."""
        return stats.table_stats(self.store.tables())

    def validate(self) -> DataFrame:
        """Issues in the store."""
        return validate.validate(self.store.tables())

    def get_document(self, document_id: str, chunk_window: int | None = None, before: int = 1, after: int = 1) -> DataFrame:
        """With all its chunks, or those around the place chunk_window in their order."""
        t = self._tables()
        if chunk_window is not None:
            docs = documents.with_metadata(documents.by_id(t["documents"], document_id), t["tags"], t["languages"]).drop("content")
            return documents.with_chunks(docs, fusion.context_window(t["chunks"], document_id, chunk_window, before, after))
        return documents.with_chunks(documents.with_metadata(documents.by_id(t["documents"], document_id), t["tags"], t["languages"]), t["chunks"].filter(F.col("document_id") == document_id))

    def list_documents(self, offset: int = 0, limit: int = 50, preview_length: int | None = None, include_metadata: bool = False) -> DataFrame:
        t = self._tables()
        rows = documents.listing(t["documents"], offset, min(max(limit, 1), 200), preview_length)
        return documents.with_metadata(rows, t["tags"], t["languages"]).orderBy(F.desc("updated_at"), "id") if include_metadata else rows

    def get_tags(self, document_id: str) -> DataFrame:
        return documents.children(self.store.table("document_tags"), document_id, "tag")

    def get_languages(self, document_id: str) -> DataFrame:
        return documents.children(self.store.table("document_languages"), document_id, "language_code")

    def get_chunk(self, chunk_id: str) -> DataFrame:
        return documents.by_id(self.store.table("chunks"), chunk_id)

    def hits(self, text: str, limit: int = 10, offset: int = 0, filters: dict | None = None) -> tuple[DataFrame, DataFrame]:
        """The best chunks with the metadata of their documents, and their page."""
        return vector.hits(self._tables(), self.provider.embed(text), limit, offset, filters)

    def features(self) -> dict:
        """What is switched on, where the store lies, and what the cache of vectors did."""
        s = self.settings
        out = {"features": {"indexing": s.indexing, "languages": bool(self.languages), "generated_tags_in_query": s.generated_tags_in_query}, "store": {"path": self.store.path, "version": self.store.version}}
        cache = getattr(self.provider, "cache", None)
        return out | ({"vectors": cache.stats()} if cache is not None else {})

    def delete_document(self, document_id: str) -> int:
        return self.store.delete_document(document_id)

    def delete_crawl_session(self, crawl_id: str) -> int:
        return self.store.delete_crawl(crawl_id)[1]

    def search_documents(self, document_id: str, query: str, limit: int | None = None) -> DataFrame:
        return vector.in_document(self.store.table("chunks"), self.provider.embed(query), document_id, limit or self.settings.max_results)

    def get_context_window(self, document_id: str, chunk_index: int, before: int = 1, after: int = 1) -> DataFrame:
        return fusion.context_window(self.store.table("chunks"), document_id, chunk_index, before, after).drop("embedding")

    def query(self, text: str, limit: int = 10, offset: int = 0, include_metadata: bool = True, document_id: str | None = None, filters: dict | None = None, options: hybrid.Options | None = None) -> tuple[DataFrame, DataFrame | None]:
        if document_id:
            return self.search_documents(document_id, text, limit), None
        s = self.settings
        o = options or hybrid.Options(threshold=s.similarity_threshold, default_languages=s.query_languages, generated_tags_count=s.generated_tags_in_query)
        tables = self._tables() | ({"index": index} if (index := self._index()) else {})
        return hybrid.query(tables, text, self.provider.embed(text), replace(o, limit=limit, offset=offset, include_metadata=include_metadata, filters=filters or {}))

    def search_code_blocks(self, query: str, limit: int | None = None, language: str | None = None) -> DataFrame:
        blocks = self.store.table("code_blocks")
        if language:
            blocks = blocks.filter(F.col("language") == tag_of(language))
        return vector.topk(blocks, self.provider.embed(query), limit or self.settings.max_results)

    def get_code_blocks(self, document_id: str) -> DataFrame:
        return documents.code_variants(self.store.table("code_blocks").filter(F.col("document_id") == document_id)).orderBy("block_index")

    def search_documents_with_ai(self, document_id: str, query: str, ask: Callable[[str], str], k: int = 12) -> DataFrame:
        """The sections that a chat model finds relevant among the best chunks."""
        text = answers.prompt(self.search_documents(document_id, query, k), query).first()["prompt"]
        answer = self.store.spark.createDataFrame([(ask(text),)], "answer string")
        return answer.select(F.explode(answers.sections(F.col("answer"))).alias("s")).select("s.*")

    def generate_tags(self, document_id: str, ask: Callable[[str], str]) -> int:
        """Adds the tags that a chat model gives for the first 2000 characters."""
        row = documents.by_id(self.store.table("documents"), document_id).first()
        answer = ask(f"Give 5 to 10 tags as a JSON array for:\n\n{row['title']}\n\n{row['content'][:2000]}")
        found = self.store.spark.createDataFrame([(document_id, answer)], "document_id string, answer string").select("document_id", F.explode(answers.tags(F.col("answer"))).alias("tag"))
        from lexloom.functions.text import uuid_of
        from lexloom.sources.store import now

        return self.store.append({"document_tags": found.withColumns({"id": uuid_of(F.lit("generated"), F.col("document_id"), F.col("tag")), "is_generated": F.lit(True), "created_at": F.lit(now())})})
