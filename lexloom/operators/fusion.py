"""From scores of chunks to scores and orders of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_document(hits: DataFrame, threshold: float | None = None) -> DataFrame:
    """0.8 times the mean of a document's three best scores, plus 0.2 times its best one (0 at least).

    hits: document_id and score, already cut to the candidates, so a document's chunks are few."""
    best = F.slice(F.sort_array(F.collect_list("score"), False), 1, 3)
    out = hits.groupBy("document_id").agg(best.alias("best"), F.count("*").cast("int").alias("hits"))
    mean = F.aggregate("best", F.lit(0.0), lambda s, x: s + x) / F.size("best")
    out = out.select("document_id", (0.8 * mean + 0.2 * F.greatest(F.element_at("best", 1), F.lit(0.0))).alias("score"), "hits")
    return out if threshold is None else out.filter(F.col("score") >= threshold)


def final_order(ratio: Column, score: Column) -> list[Column]:
    return [F.desc(score + 0.4 * ratio), F.desc(ratio), F.desc(score)]


def gated(results: DataFrame, n_keywords: int) -> DataFrame:
    """results with columns ratio and phrase. For up to three keywords: only phrase matches, if there is one; then for up to two
    only those with a ratio over 0, if there is one. Two flags over all results, as one row, so the plan stays lazy."""
    if not n_keywords:
        return results
    flags = results.agg(F.coalesce(F.max("phrase"), F.lit(False)).alias("any_phrase"))
    if n_keywords <= 3:
        results = results.crossJoin(F.broadcast(flags)).filter(~F.col("any_phrase") | F.col("phrase")).drop("any_phrase")
    if n_keywords <= 2:
        flags = results.agg(F.coalesce(F.max(F.col("ratio") > 0), F.lit(False)).alias("any_ratio"))
        results = results.crossJoin(F.broadcast(flags)).filter(~F.col("any_ratio") | (F.col("ratio") > 0)).drop("any_ratio")
    return results


def context_window(chunks: DataFrame, document_id, center: int, before: int = 1, after: int = 1, document_col: str = "document_id", index_col: str = "chunk_index") -> DataFrame:
    """Chunks of one document around a place in its order, with position and total_chunks. A centre outside gives none."""
    own = Window.partitionBy(document_col)
    rows = chunks.filter(F.col(document_col) == F.lit(document_id))
    rows = rows.withColumn("position", F.row_number().over(own.orderBy(index_col)) - 1).withColumn("total_chunks", F.count("*").over(own).cast("int"))
    inside = (F.lit(center) >= 0) & (F.lit(center) < F.col("total_chunks"))
    return rows.filter(inside & F.col("position").between(center - before, center + after))
