"""The store, ingest and the tools as queries: a store is made in the shared folder, changed, and read."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.api import Tools
from lexloom.functions.embed import Sine
from lexloom.functions.text import content_hash
from lexloom.operators import documents, filters, vector
from lexloom.plans.config import Settings
from lexloom.plans.ingest import ingest
from lexloom.queries import first_vector, query, rounded, table
from lexloom.session import shared_folder
from lexloom.sources import uploads
from lexloom.sources.crawl import page_links, reachable
from lexloom.sources.schema import schema
from lexloom.sources.store import Store, open_store
from lexloom.sources.vectors import Chunks, StoredChunks, legacy_score


def sine() -> Sine:
    return Sine(8)


def rows_of(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """Documents, and what belongs to them, as rows of the store: the id, source and language of documents, vectors as chunks and as code blocks."""
    x = table(spark, d, "documents")
    key = F.col("doc_id").cast("string")
    docs = x.select(key.alias("id"), F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("content"), content_hash(F.col("text")).alias("content_hash"), F.lit("api").alias("source"), F.col("source").alias("author"), F.when(F.col("doc_id") % 5 == 0, "s1").alias("crawl_id"), F.lit("active").alias("status"), F.lpad(key, 9, "0").alias("updated_at"), F.lpad(key, 9, "0").alias("created_at"))
    tags = x.select(F.concat(F.lit("t"), key).alias("id"), key.alias("document_id"), F.upper("source").alias("tag"), (F.col("doc_id") % 2 == 0).alias("is_generated"))
    codes = x.select(F.concat(F.lit("l"), key).alias("id"), key.alias("document_id"), F.upper("lang").alias("language_code"))
    v = table(spark, d, "embeddings")
    vec, index = F.col("vec_id"), (F.col("vec_id") % 5).cast("int")
    part = v.select(vec.cast("string").alias("id"), F.floor(vec / 5).cast("string").alias("document_id"), index.alias("chunk_index"), F.concat(F.lit("chunk "), vec.cast("string")).alias("content"), F.when(vec % 7 == 0, F.array().cast("array<float>")).otherwise(F.col("embedding")).alias("embedding"), index.alias("block_index"), F.concat(F.lit("b"), (index / 2).cast("int").cast("string")).alias("block_id"), F.when(F.col("label") % 2 == 0, "go").otherwise("rust").alias("language"))
    return {"documents": docs, "document_tags": tags, "document_languages": codes, "chunks": part, "code_blocks": part.filter("block_index > 1")}


def filled(spark: SparkSession, d: str) -> Store:
    """Two appends: the even documents, then the odd ones with all the rest."""
    store, rows = open_store(spark, shared_folder(spark)), rows_of(spark, d)
    even = F.col("id").cast("long") % 2 == 0
    store.append({"documents": rows["documents"].filter(even)})
    store.append({"documents": rows["documents"].filter(~even)} | {n: df for n, df in rows.items() if n != "documents"})
    return store


VECTORS = "(SELECT vec_id, vec_id // 5 AS document_id, CAST(vec_id % 5 AS INTEGER) AS i, embedding, label FROM embeddings WHERE vec_id % 7 <> 0)"
COUNTS = f"(SELECT doc_id, source, lang, (SELECT count(*) FROM {VECTORS} v WHERE v.document_id = doc_id) AS chunks, (SELECT count(*) FROM {VECTORS} v WHERE v.document_id = doc_id AND i > 1) AS blocks FROM documents)"


@query(f"SELECT CAST(doc_id AS VARCHAR) AS id, CAST(CASE WHEN doc_id = 4 THEN 0 ELSE chunks END AS INTEGER) AS chunks_count, CAST(blocks AS INTEGER) AS code_blocks_count, lower(source) AS tag, lower(lang) AS language FROM {COUNTS} WHERE lang IS DISTINCT FROM 'de' AND doc_id % 5 <> 0 AND doc_id <> 3")
def store_changes(spark, d):
    """Appends, the deletion of documents by a condition, of one, and of a crawl, of one's chunks, and new counts."""
    store, x = filled(spark, d), table(spark, d, "documents")
    store.discard(x.filter("lang = 'de'").select(F.col("doc_id").cast("string").alias("document_id")))
    store.delete_document("3")
    store.delete_crawl("s1")
    store.remove_chunks("4")
    store.update_counts()
    t = store.tables()
    out = t["documents"].select("id", "chunks_count", "code_blocks_count")
    return out.join(t["document_tags"].select(F.col("document_id").alias("id"), "tag"), "id").join(t["document_languages"].select(F.col("document_id").alias("id"), F.col("language_code").alias("language")), "id")


@query("SELECT 'filled' AS state, count(*) AS documents FROM documents UNION ALL SELECT 'changed', count(*) FILTER (doc_id % 5 <> 0) FROM documents UNION ALL SELECT 'restored', count(*) FROM documents UNION ALL SELECT 'lost and restored', count(*) FROM documents UNION ALL SELECT 'copies', 1")
def store_backups(spark, d):
    """A copy outside the store brings it back after a change, and after it was dropped."""
    store = filled(spark, d)
    copy = store.backup()
    state = [("filled", store.table("documents").count())]
    store.delete_crawl("s1")
    state.append(("changed", store.table("documents").count()))
    store.restore(copy["id"])
    store.compact()
    store.vacuum()
    state.append(("restored", store.table("documents").count()))
    store.drop(confirm=True)
    store.restore(copy["id"])
    state += [("lost and restored", store.table("documents").count()), ("copies", len(store.backups()))]
    return spark.createDataFrame(state, "state string, documents long")


@query("SELECT * FROM (SELECT 'document' AS kind, CAST(doc_id AS VARCHAR) AS id FROM documents WHERE doc_id = 5 UNION ALL SELECT 'hash', min(CAST(doc_id AS VARCHAR)) FROM documents WHERE substring(sha256(trim(text, ' ' || chr(9) || chr(10) || chr(13))), 1, 16) = (SELECT substring(sha256(trim(text, ' ' || chr(9) || chr(10) || chr(13))), 1, 16) FROM documents WHERE doc_id = 6) HAVING count(*) = 1 UNION ALL SELECT 'several', CAST(doc_id AS VARCHAR) FROM documents WHERE doc_id IN (1, 2) "
       + f"UNION ALL SELECT 'chunk', CAST(vec_id AS VARCHAR) FROM {VECTORS} WHERE vec_id = 8 UNION ALL SELECT 'chunks', string_agg(CAST(vec_id AS VARCHAR), ',' ORDER BY i) FROM {VECTORS} WHERE document_id = 9 UNION ALL SELECT 'blocks', string_agg(CAST(vec_id AS VARCHAR), ',' ORDER BY i) FROM {VECTORS} WHERE document_id = 9 AND i > 1 UNION ALL SELECT 'tags', lower(source) FROM documents WHERE doc_id = 9 UNION ALL SELECT 'languages', lower(lang) FROM documents WHERE doc_id = 9 UNION ALL SELECT 'first ids', string_agg(id, ',' ORDER BY id) FROM (SELECT CAST(doc_id AS VARCHAR) AS id FROM documents ORDER BY 1 LIMIT 5)) WHERE id IS NOT NULL")
def store_lookups(spark, d):
    """A document by its id and by its hash, several by their ids, a chunk by its id; one's chunks, code blocks, tags and languages; ids in order."""
    store = filled(spark, d)
    docs, tools = store.table("documents"), Tools(store, sine)
    one = documents.by_id(docs, "6").first()["content_hash"]
    same = docs.filter(F.col("content_hash") == one).count() == 1
    listed = lambda df, c, order: df.select(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, c))), lambda r: r[c]), ",").alias("id")) if order != c else df.select(F.array_join(F.array_sort(F.collect_list(c)), ",").alias("id"))
    parts = {
        "document": documents.by_id(docs, "5").select("id"), "hash": documents.by_hash(docs, one).select("id").filter(F.lit(same)), "several": filters.by_ids(docs, ["1", "2", "none"]).select("id"),
        "chunk": tools.get_chunk("8").select("id"), "chunks": listed(documents.children(store.table("chunks"), "9", "chunk_index"), "id", "chunk_index"), "blocks": listed(documents.children(store.table("code_blocks"), "9", "block_index"), "id", "block_index"),
        "tags": tools.get_tags("9").select(F.col("tag").alias("id")), "languages": tools.get_languages("9").select(F.col("language_code").alias("id")), "first ids": listed(documents.sorted_ids(docs).limit(5), "id", "id"),
    }
    out = None
    for kind, df in parts.items():
        df = df.select(F.lit(kind).alias("kind"), "id")
        out = df if out is None else out.unionByName(df)
    return out.filter("id <> ''")


@query(f"SELECT CAST(vec_id AS VARCHAR) AS id FROM {VECTORS} v JOIN documents d ON d.doc_id = v.document_id WHERE lower(source) IN ('src1', 'src2', 'src3', 'src4', 'src5', 'src0') AND lower(lang) IN ('en', 'fr') AND doc_id % 5 = 0 AND doc_id BETWEEN 10 AND 390")
def storage_filters(spark, d):
    """All of: any of the tags, any of the languages, source, crawl, status, and ranges of times."""
    t = filled(spark, d).tables()
    wanted = {"tags": ["SRC1", "src2", "src3", "src4", "SRC5", "src0"], "languages": ["EN", "fr"], "source": "api", "crawl_id": "s1", "status": "active", "created_after": "000000010", "updated_before": "000000390"}
    return filters.storage_filter(t["chunks"], t["documents"], t["document_tags"], t["document_languages"], wanted).select("id")


@query(f"SELECT CAST(vec_id AS VARCHAR) AS id, round((1 + list_cosine_similarity(v.embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0))) / 2, 6) AS score, doc.source AS author, CASE WHEN doc_id % 2 <> 0 THEN lower(doc.source) ELSE '' END AS tags, lower(lang) AS languages, (SELECT count(*) FROM {VECTORS}) AS total FROM {VECTORS} v JOIN documents doc ON doc.doc_id = v.document_id WHERE lower(lang) = 'en' ORDER BY score DESC, id LIMIT 5 OFFSET 3")
def hits_with_metadata(spark, d):
    """The best chunks after an offset, with their documents' metadata, and how many chunks there are."""
    t = filled(spark, d).tables()
    tables = {"chunks": t["chunks"], "documents": t["documents"], "tags": t["document_tags"], "languages": t["document_languages"]}
    rows, page = vector.hits(tables, first_vector(spark, d), 5, 3, {"languages": ["en"]})
    rows = rows.select("id", F.round("score", 6).alias("score"), "author", F.array_join("tags", ",").alias("tags"), F.array_join("languages", ",").alias("languages"))
    return rows.crossJoin(F.broadcast(page.select(F.col("total_documents").alias("total"))))  # a single row


@query("SELECT CAST(vec_id AS VARCHAR) AS id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 5) AS score, round(1 - (1 - list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0))), 5) AS legacy FROM embeddings WHERE vec_id // 5 <> 3 AND (CASE WHEN vec_id % 2 = 0 THEN label ELSE -1 END) = 3 ORDER BY score DESC, id LIMIT 6")
def chunk_tables(spark, d):
    """Chunks without documents, in a plan and in a folder: the last row of an id counts, a document's go, and a filter looks at metadata first."""
    x = table(spark, d, "embeddings")
    key, even = F.col("vec_id").cast("string"), F.col("vec_id") % 2 == 0
    rows = x.select(key.alias("id"), F.floor(F.col("vec_id") / 5).cast("string").alias("document_id"), F.lit("c").alias("content"), "embedding", F.create_map(F.lit("label"), F.col("label").cast("string")).alias("metadata"))
    lost = x.filter(~even).select(key.alias("id"), F.floor(F.col("vec_id") / 5).cast("string").alias("document_id"), F.lit("c").alias("content"), "embedding", F.create_map(F.lit("label"), F.lit("-1")).alias("metadata"))
    held, path = Chunks(spark), shared_folder(spark)
    for own in (held, StoredChunks(spark, path)):
        own.add(rows)
        own.add(lost)
        own.remove_document("3")
    found = StoredChunks(spark, path)
    q, wanted = first_vector(spark, d), "label = 3"
    a, b = (c.search(q, 6, wanted).select("id", F.round("score", 5).alias("score")) for c in (held, found))
    out = a.join(b, ["id", "score"]).join(found.get("2").select(F.col("id").alias("two")), F.lit(True), "left").drop("two")
    return out.withColumn("legacy", F.round(legacy_score(1 - F.col("score")), 5))


@query("SELECT vec_id // 10 AS id, string_agg(CAST(vec_id AS VARCHAR), ',' ORDER BY vec_id DESC) AS chunks FROM embeddings GROUP BY 1")
def chunk_arrays(spark, d):
    """Documents with their chunks as an array in order."""
    x = table(spark, d, "embeddings")
    rows = x.select(F.floor(F.col("vec_id") / 10).alias("document_id"), (-F.col("vec_id")).alias("chunk_index"), F.col("vec_id").alias("id"), F.lit("c").alias("content"), F.lit(0).alias("start_position"), F.lit(1).alias("end_position"))
    found = documents.with_chunks(rows.select(F.col("document_id").alias("id")).distinct(), rows)
    return found.select("id", F.array_join(F.transform("chunks", lambda c: c["id"].cast("string")), ",").alias("chunks"))


@query("SELECT CAST(count(*) AS BIGINT) AS documents, count(DISTINCT substring(sha256(trim(text, ' ' || chr(9) || chr(10) || chr(13))), 1, 16)) AS hashes, count(*) AS chunked, 0 AS issues, 0 AS not_active FROM (SELECT DISTINCT text FROM benchmark WHERE trim(text) <> '')")
def ingested(spark, d):
    """Benchmark texts taken in, each row twice, and once more: one document a text, with chunks, counts that agree, and no issue."""
    from lexloom.operators.validate import validate

    store = open_store(spark, shared_folder(spark))
    raw = table(spark, d, "benchmark").filter(F.trim("text") != "").select(F.lit("Item").alias("title"), F.col("text").alias("content"))
    ingest(store, raw.unionByName(raw), sine, "sine", stamp="2024-01-01T00:00:00.000Z")
    ingest(store, raw, sine, "sine", stamp="2024-01-01T00:00:00.000Z")
    t = store.tables()
    issues = validate({n: t[n] for n in ("documents", "chunks", "code_blocks")}).agg(F.count("*").cast("int").alias("issues"))
    found = t["documents"].agg(F.count("*").alias("documents"), F.countDistinct("content_hash").alias("hashes"), F.sum((F.col("chunks_count") > 0).cast("long")).alias("chunked"), F.sum((F.col("status") != "active").cast("int")).cast("int").alias("not_active"))
    return found.crossJoin(F.broadcast(issues))  # single rows


@query("SELECT name, supported, CASE WHEN supported THEN 'words of ' || name END AS content FROM (VALUES ('a.txt', true), ('b.md', true), ('c.bin', false), ('d.TXT', true)) t(name, supported) UNION ALL SELECT 'one', true, 'words of b.md' UNION ALL SELECT 'stored', true, '3'")
def uploads_read(spark, d):
    """A folder with a folder in it and a link back: listed, read, one of its files under another title, and taken in."""
    top = shared_folder(spark)  # four small files where every executor sees them
    for name in ("a.txt", "sub/b.md", "c.bin", "sub/d.TXT"):
        uploads.put(spark, f"{top}/{name}", f"words of {name.split('/')[-1]}".encode())
    if own := uploads.local(top):  # a link back, where the file system has links
        os.symlink(own, f"{own}/sub/back")
    listed = uploads.listed(spark, top).select("name", "supported").join(uploads.read(spark, top).select(F.col("title").alias("name"), "content"), "name", "left")
    store = open_store(spark, shared_folder(spark))
    tools = Tools(store, sine, Settings())
    tools.process_uploads(top)
    tools.process_uploads(top)
    one = uploads.read_one(spark, top, "sub/b.md").select(F.lit("one").alias("name"), F.lit(True).alias("supported"), "content")
    stored = store.table("documents").select(F.lit("stored").alias("name"), F.lit(True).alias("supported")).groupBy("name", "supported").agg(F.count("*").cast("string").alias("content"))
    return listed.unionByName(one).unionByName(stored)


@query(f"WITH RECURSIVE l AS (SELECT DISTINCT regexp_replace(regexp_replace(url, '#.*$', ''), '([^/:])/$', '\\1') AS url, regexp_extract(url, '^(https?://[^/?#]+)', 1) || '/' || CAST((page_id * 7) % 50 AS VARCHAR) AS target, page_id FROM pages), p AS (SELECT 'https://e.com/' || CAST(page_id AS VARCHAR) AS url, 'https://e.com/' || CAST((page_id * 2 + 1) % (SELECT count(*) FROM pages) AS VARCHAR) AS a, 'https://e.com/' || CAST((page_id * 3) % (SELECT count(*) FROM pages) AS VARCHAR) AS b FROM pages), e AS (SELECT url, a AS target FROM p UNION SELECT url, b FROM p), r AS (SELECT 'https://e.com/1' AS url, 0 AS depth UNION SELECT e.target, r.depth + 1 FROM r JOIN e ON e.url = r.url WHERE r.depth < 5) SELECT url, CAST(min(depth) AS INTEGER) AS depth FROM r GROUP BY url")
def crawl_levels(spark, d):
    """Pages within five links of a seed, each at its least depth; the pages' links follow from their numbers."""
    x = table(spark, d, "pages")
    most = x.count()
    at = lambda n: F.concat(F.lit("https://e.com/"), n.cast("string"))
    n = F.col("page_id")
    page = F.concat(F.lit("<html><body><a href='/"), ((n * 2 + 1) % most).cast("string"), F.lit("'>a</a><a href='"), at((n * 3) % most), F.lit("#x'>b</a><a href='mailto:x'>c</a></body></html>"))
    links = page_links(x.select(at(n).alias("url"), page.alias("html")))
    return reachable(links, spark.createDataFrame([("https://e.com/1",)], "url string"))


@query("SELECT 'listed' AS tool, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY item_id) AS found FROM (SELECT item_id FROM benchmark WHERE item_id < 6) UNION ALL SELECT 'after deletion', string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY item_id) FROM (SELECT item_id FROM benchmark WHERE item_id < 6 AND item_id <> 2) UNION ALL SELECT 'document', '1' UNION ALL SELECT 'in document', '1' UNION ALL SELECT 'window', '1' UNION ALL SELECT 'blocks', 'python' UNION ALL SELECT 'answer', 'yes' UNION ALL SELECT 'generated', 'new' UNION ALL SELECT 'refused', 'title and content must not be empty'")
def tools_used(spark, d):
    """The document server's tools one after the other."""
    store = open_store(spark, shared_folder(spark))
    tools = Tools(store, sine, Settings(query_languages=("unknown",), similarity_threshold=0.0))
    items = [(r["item_id"], " ".join(r["text"].split()[:20])) for r in table(spark, d, "benchmark").filter("item_id < 6").orderBy("item_id").collect()]
    for i, t in items:
        tools.add_document(str(i), t + ("\n\n```py\nx = 1\n```" if i == 1 else ""), {"tags": ["Item"]})
    ids = {r["title"]: r["id"] for r in tools.list_documents(include_metadata=True).collect()}
    said = [("listed", ",".join(sorted(ids))), ("document", tools.get_document(ids["1"], chunk_window=0).first()["title"])]
    said.append(("in document", str(tools.search_documents(ids["1"], "x", 1).count())))
    said.append(("window", str(tools.get_context_window(ids["1"], 0, 0, 0).count())))
    said.append(("blocks", tools.search_code_blocks("x", language="PY").first()["language"] if tools.get_code_blocks(ids["1"]).count() == 1 else ""))
    said.append(("answer", tools.search_documents_with_ai(ids["1"], "x", lambda p: '{"relevant_sections": [{"chunk_index": 0, "content": "yes"}]}').first()["content"]))
    tools.generate_tags(ids["1"], lambda p: '["New"]')
    said.append(("generated", ",".join(tools.get_document(ids["1"]).first()["tags_generated"])))
    tools.delete_document(ids["2"])
    said.append(("after deletion", ",".join(sorted(r["title"] for r in tools.list_documents().collect()))))
    said.append(("refused", tools.add_document(" ", "x")))
    return spark.createDataFrame(said, "tool string, found string")
