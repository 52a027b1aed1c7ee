"""The hybrid query: vectors, keywords, metadata, lexical gating and order, as one lazy plan."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.functions.text import haystack, match_ratio, phrase_match, query_keywords
from lexloom.operators import filters, fusion, keyword, rerank, vector
from lexloom.operators.documents import with_metadata


@dataclass
class Options:
    limit: int = 10
    offset: int = 0
    threshold: float = 0.5
    candidates: int = 1000
    include_metadata: bool = True
    filters: dict = field(default_factory=dict)
    default_languages: tuple[str, ...] = ("en", "no")
    generated_tags_count: bool = False
    prefilter: bool = False
    rerank: bool = False
    metric: str = "cosine"


def ranked(tables: dict[str, DataFrame], text: str, query_vector, o: Options | None = None) -> DataFrame:
    """All results in order: id, title, score, ratio, order (three keys). tables: documents, tags, languages, chunks, keywords; and perhaps an index (VectorIndex), which then gives the candidates."""
    o = o or Options()
    wanted = dict(o.filters)
    wanted.setdefault("languages", list(o.default_languages))
    low = text.strip().lower()
    said = F.coalesce(F.lower("title").contains(low) | F.lower("content").contains(low), F.lit(False)) if low else F.lit(True)
    # the text goes where it is read: joins carry whether it holds the query
    docs = with_metadata(tables["documents"].withColumn("said", said).drop("content"), tables["tags"], tables["languages"])
    passing = docs.filter(filters.metadata(wanted, o.generated_tags_count))
    chunks = tables["chunks"]
    if o.prefilter:
        chunks = chunks.join(passing.select(F.col("id").alias("document_id")), "document_id", "left_semi")
    n = (o.limit + o.offset) * 5 if o.rerank else o.candidates
    if tables.get("index") is not None and not o.prefilter and o.metric == "cosine":
        # of the index's rows those that are still there
        hits = chunks.select("id", "document_id").join(tables["index"].topk(query_vector, n).select("id", "score"), "id")
    else:
        hits = vector.topk(chunks.select("id", "document_id", "embedding"), query_vector, n, metric=o.metric)
    found = fusion.by_document(hits, o.threshold).select("document_id", "score")
    words = query_keywords(text)
    if words:
        found = keyword.merged(found, tables["keywords"], text, o.threshold)
    if o.rerank:
        texts = found.join(tables["documents"].select(F.col("id").alias("document_id"), "content"), "document_id")
        found = rerank.rerank(texts, text, "content", o.limit + o.offset, most=n).select("document_id", F.col("rerank_score").alias("score"))
    # found has as many rows as there are candidates, so Spark may broadcast it by its size
    results = passing.join(found.withColumnRenamed("document_id", "id"), "id")
    none = results.agg((F.count("*") == 0).alias("none")).filter("none")  # a single row, or none: then the fallback is not run
    fallback = passing.filter("said").withColumn("score", F.lit(1.0)).crossJoin(F.broadcast(none)).drop("none")
    results = results.unionByName(fallback)
    blank, empty = F.lit(None).cast("string"), F.array().cast("array<string>")
    if o.include_metadata:
        hay = haystack(*(F.col(c) for c in ("title", "original_filename", "crawl_url", "description", "author", "tags", "tags_generated")))
    else:
        hay = haystack(F.col("title"), blank, blank, blank, blank, empty, empty)
    results = results.withColumn("ratio", match_ratio(hay, words)).withColumn("phrase", phrase_match(hay, text))
    results = fusion.gated(results, len(words))
    return results.orderBy(*fusion.final_order(F.col("ratio"), F.col("score")), "id")


def query(tables: dict[str, DataFrame], text: str, query_vector, o: Options | None = None) -> tuple[DataFrame, DataFrame]:
    """A page of results, and its pagination as one row."""
    o = o or Options()
    every = ranked(tables, text, query_vector, o)
    cols = ["id", "title", "score", "ratio"] + (["source", "author", "content_type", "crawl_id", "tags", "tags_generated", "languages"] if o.include_metadata else [])
    rows = every.select(*cols).offset(max(o.offset, 0)).limit(max(o.limit, 0))
    return rows, vector.page(rows, every, max(o.offset, 0), max(o.limit, 0))
