"""The keyword index, keyword search, and the merge of its results with those of vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.functions.text import is_keyword, keywords, query_keywords, words


def occurrences(docs: DataFrame, id_col: str = "id", fields: dict[str, str] | None = None, only: list[str] | None = None) -> DataFrame:
    """document_id, source, keyword: a row for each time that a keyword occurs."""
    found = None
    for source, column in (fields or {"title": "title", "content": "content"}).items():
        one = docs.select(F.col(id_col).alias("document_id"), F.lit(source).alias("source"), F.explode(keywords(F.col(column), only) if only is not None else words(F.col(column))).alias("keyword"))
        if only is None:  # as rows, which Spark compiles, unlike a function of an array
            one = one.filter(is_keyword(F.col("keyword")))
        found = one if found is None else found.unionByName(one)
    return found


def index(docs: DataFrame, id_col: str = "id", fields: dict[str, str] | None = None, only: list[str] | None = None) -> DataFrame:
    """document_id, source, keyword, frequency. fields: source -> column. only: the rows of these keywords, from a scan of the texts that carries no others."""
    return occurrences(docs, id_col, fields, only).groupBy("document_id", "source", "keyword").agg(F.count("*").cast("int").alias("frequency"))


def search(keyword_rows: DataFrame, words: list[str]) -> DataFrame:
    """document_id, score (sum of frequencies), matched (distinct keywords)."""
    hits = keyword_rows.filter(F.col("keyword").isin(sorted({w.lower() for w in words})) if words else F.lit(False))
    return hits.groupBy("document_id").agg(F.sum("frequency").cast("double").alias("score"), F.countDistinct("keyword").cast("int").alias("matched"))


def need(n: int) -> int:
    """How many of n query keywords, repeats counted, must match."""
    return n if n <= 2 else -(-n // 2)


def eligible(keyword_rows: DataFrame, query: str, threshold: float = 0.0, without: DataFrame | None = None, distinct: bool = False) -> DataFrame:
    """document_id, score in 0..1, matched: documents with enough of the keywords, less those of `without`, scores over the best one's."""
    words = query_keywords(query)
    if distinct:
        words = list(dict.fromkeys(words))
    found = search(keyword_rows, words).filter(F.col("matched") >= need(len(words)))
    if without is not None:
        found = found.join(without.select("document_id"), "document_id", "left_anti")
    best = found.agg(F.greatest(F.max("score"), F.lit(1.0)).alias("best"))  # a single row
    return found.crossJoin(F.broadcast(best)).select("document_id", (F.col("score") / F.col("best")).alias("score"), "matched").filter(F.col("score") >= threshold)


def merged(candidates: DataFrame, keyword_rows: DataFrame, query: str, threshold: float) -> DataFrame:
    """candidates (document_id, score) and the keyword results that are not among them."""
    found = eligible(keyword_rows, query, threshold, candidates)
    return candidates.select("document_id", "score").unionByName(found.select("document_id", "score"))


def keep_best(a: DataFrame, b: DataFrame) -> DataFrame:
    """Union by document_id with the higher score."""
    return a.select("document_id", "score").unionByName(b.select("document_id", "score")).groupBy("document_id").agg(F.max("score").alias("score"))


def intersected(hits: DataFrame, keyword_rows: DataFrame, query: str, key: str = "document_id") -> DataFrame:
    """Hits of documents that have any of the query's keywords; all of them for a query without keywords."""
    words = query_keywords(query)
    return hits.join(search(keyword_rows, words).select(F.col("document_id").alias(key)), key, "left_semi") if words else hits
