"""Exact vector search, and an inverted file over k-means cells for large tables."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for vectors of other lengths or without length."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (norm == 0), 0.0).otherwise(dot(a, b) / norm)


def literal(vector) -> Column:
    return F.array(*(F.lit(float(x)) for x in vector))


def score(vector: Column, query, metric: str = "cosine") -> Column:
    """cosine: (1 + cos) / 2; l2: (2 - squared distance) / 2, which may fall under 0. Null for a vector of another length.

    Batches of vectors times the query in numpy."""
    q = np.asarray(list(query), float)
    length = float(np.sqrt(q @ q))

    @F.pandas_udf("double")
    def run(v: pd.Series) -> pd.Series:
        out = np.full(len(v), np.nan)
        fits = np.array([x is not None and len(x) == len(q) for x in v], bool)
        if fits.any():
            m = np.stack(v[fits].to_numpy()).astype(float)
            if metric == "l2":
                out[fits] = (2 - ((m - q) ** 2).sum(axis=1)) / 2
            else:
                norm = np.sqrt((m * m).sum(axis=1)) * length
                out[fits] = (1 + np.where(norm == 0, 0.0, (m @ q) / np.where(norm == 0, 1.0, norm))) / 2
        return pd.Series(out).astype(object).where(~np.isnan(out), None)

    return run(vector)


def scored(chunks: DataFrame, query, embedding: str = "embedding", metric: str = "cosine") -> DataFrame:
    """Rows with an embedding, with their score; rows without one never match."""
    return chunks.filter(F.size(embedding) > 0).withColumn("score", score(F.col(embedding), query, metric)).filter("score IS NOT NULL")


def topk(chunks: DataFrame, query, k: int, id_col: str = "id", offset: int = 0, embedding: str = "embedding", metric: str = "cosine") -> DataFrame:
    """The k best rows after offset, by score, then id. Filter chunks before: the cut comes after the filter."""
    out = scored(chunks, query, embedding, metric).drop(embedding).orderBy(F.desc("score"), id_col)
    return out.limit(k + offset).offset(offset) if offset else out.limit(k)


def in_document(chunks: DataFrame, query, document_id, k: int, id_col: str = "id", **options) -> DataFrame:
    return topk(chunks.filter(F.col("document_id") == F.lit(document_id)), query, k, id_col, **options)


def page(ranked: DataFrame, total: DataFrame, offset: int, limit: int) -> DataFrame:
    """One row: total_documents, returned, has_more, next_offset."""
    n = total.agg(F.count("*").alias("total_documents"))
    returned = F.least(F.greatest(F.col("total_documents") - offset, F.lit(0)), F.lit(limit))
    more = F.lit(offset + limit) < F.col("total_documents")
    return n.select("total_documents", returned.cast("int").alias("returned"), more.alias("has_more"), F.when(more, F.lit(offset + limit)).alias("next_offset"))


# --- plans for an index -------------------------------------------------------------------------------------------


def ivf_parameters(rows: int, dimension: int) -> tuple[int, int]:
    """Cells and sub-vectors."""
    return min(2048, max(16, math.isqrt(rows))), min(256, max(4, dimension // 16))


def hnsw_parameters(rows: int, m: int = 16, ef_construction: int = 200, ef: int = 50) -> dict[str, int]:
    if rows > 10_000_000:
        m, ef_construction, ef = 64, 800, 200
    elif rows > 1_000_000:
        m, ef_construction, ef = 32, 400, 100
    return {"m": m, "ef_construction": ef_construction, "ef": ef}


def hnsw_memory(rows: int, dimension: int, m: int) -> int:
    """Bytes."""
    return math.ceil((rows * dimension * 4 + m * 2 * rows * 8) * 2.5)


def hnsw_errors(m: int, ef_construction: int, ef: int) -> list[str]:
    limits = {"m": (m, 4, 128), "ef_construction": (ef_construction, 50, 1000), "ef": (ef, 10, 1000)}
    return [f"{k} must be between {a} and {b}" for k, (v, a, b) in limits.items() if not a <= v <= b]


def index_choice(rows: int, dimension: int, prefer_hnsw: bool = True, hnsw_enabled: bool = True) -> dict:
    if prefer_hnsw and hnsw_enabled:
        return {"type": "hnsw", "label": "HNSW"} | hnsw_parameters(rows)
    cells, parts = ivf_parameters(rows, dimension)
    return {"type": "ivf_pq", "label": "IVF_PQ", "cells": cells, "sub_vectors": parts}


def matrix(column) -> np.ndarray:
    """An Arrow column of vectors of one length, as rows."""
    import pyarrow as pa

    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.sqrt((m * m).sum(axis=1, keepdims=True)), 1e-12)


NUMBERS = 1 << 24  # of a sample of vectors


def ivf_sample(chunks: DataFrame, embedding: str = "embedding", sample: int = 50_000) -> np.ndarray:
    """At most `sample` vectors, and NUMBERS numbers, of the length that most have, as unit rows: those of rows whose hash is under a threshold that leaves so many."""
    sizes = chunks.filter(F.size(embedding) > 0).groupBy(F.size(embedding).alias("d")).count().collect()  # a row for each length
    if not sizes:
        return np.zeros((0, 1))
    n, d = max((r["count"], r["d"]) for r in sizes)
    most = min(sample, max(1, NUMBERS // d))
    rows = chunks.filter(F.size(embedding) == d)
    if n > most:
        share = (most - 4 * math.sqrt(most)) / n  # beyond it once in 30,000 times, and then the last are left out
        mark = F.xxhash64(*[c for c, t in chunks.dtypes if not t.startswith("map")])
        rows = rows.filter(F.pmod(mark, F.lit(1 << 30)) < int(share * (1 << 30))).limit(most)
    found = rows.select(F.col(embedding).cast("array<float>").alias("v")).toArrow().column("v").combine_chunks()
    x = unit(matrix(found)) if len(found) else np.zeros((0, d))
    return x[np.lexsort(x.T[::-1])]  # in an order that doesn't hang on the partitions


def ivf_centroids(x: np.ndarray, cells: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """k-means of unit rows; none without rows."""
    if not len(x):
        return x
    c = x[np.random.default_rng(seed).choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(rounds):
        near = (x @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c = unit(np.where(np.bincount(near, minlength=len(c))[:, None] > 0, sums, c))
    return c


def ivf_fit(chunks: DataFrame, cells: int, embedding: str = "embedding", sample: int = 50_000, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Centroids by k-means on a bounded sample (ivf_sample); none without vectors."""
    return ivf_centroids(ivf_sample(chunks, embedding, sample), cells, rounds, seed)


def ivf_needed(x: np.ndarray, centroids: np.ndarray, k: int, recall: float = 0.95, queries: int = 200) -> int:
    """How many cells a search must probe for this share of the true neighbours, and for nine tenths of them in nine of ten searches: measured on a sample, where 1 in len / queries is held against every other row."""
    if len(x) <= k or len(centroids) < 2:
        return max(1, len(centroids))
    of = np.arange(0, len(x), max(1, len(x) // queries))
    q = x[of]
    cell = (x @ centroids.T).argmax(axis=1)
    rank = np.empty((len(q), len(centroids)), int)  # of each cell for each query
    np.put_along_axis(rank, np.argsort(-(q @ centroids.T), axis=1, kind="stable"), np.arange(len(centroids))[None], axis=1)
    best = []
    for at in range(0, len(q), 50):
        s = q[at : at + 50] @ x.T
        s[np.arange(len(s)), of[at : at + 50]] = -np.inf  # a row finds itself in any case
        best.append(np.argpartition(-s, k - 1, axis=1)[:, :k])
    met = np.sort(np.take_along_axis(rank, cell[np.concatenate(best)], axis=1), axis=1)
    last = lambda x, share: int(np.sort(x.ravel())[math.ceil(share * x.size) - 1]) + 1
    return max(last(met, recall), last(met[:, math.ceil(0.9 * k) - 1], 0.9))


def ivf_probes(chunks: DataFrame, centroids: np.ndarray, k: int, recall: float = 0.975, queries: int = 200, embedding: str = "embedding", sample: int = 50_000) -> int:
    """ivf_needed of the bounded sample."""
    return ivf_needed(ivf_sample(chunks, embedding, sample), centroids, k, recall, queries)


def against(v: pd.Series, centroids: np.ndarray, most: int = 1 << 20):
    """Products of the vectors with the centroids, so many numbers at a time, however many centroids there are."""
    step = max(1, most // max(1, len(centroids)))
    for at in range(0, len(v), step):
        yield np.stack(v.iloc[at : at + step].to_numpy()).astype(float) @ centroids.T


def nearest_cells(v: pd.Series, centroids: np.ndarray, probes: int) -> pd.Series:
    """The cells of the nearest centroids of each vector."""
    return pd.Series([row for s in against(v, centroids) for row in np.argsort(-s, axis=1, kind="stable")[:, :probes].astype(np.int32)], dtype=object)


def ivf_assign(chunks: DataFrame, centroids: np.ndarray, embedding: str = "embedding") -> DataFrame:
    """Every row that has a vector of the centroids' length with its cell; written partitioned by cell, a search reads only the cells it probes."""

    @F.pandas_udf("int")
    def cell(v: pd.Series) -> pd.Series:
        return pd.Series(np.concatenate([s.argmax(axis=1) for s in against(v, centroids)])) if len(v) else pd.Series([], dtype=int)

    if not len(centroids):
        return chunks.withColumn("cell", F.lit(0)).limit(0)
    return chunks.filter(F.size(embedding) == centroids.shape[1]).withColumn("cell", cell(embedding))


def ivf_topk(indexed: DataFrame, centroids: np.ndarray, query, k: int, probes: int = 8, id_col: str = "id", embedding: str = "embedding") -> DataFrame:
    """The k best rows of the probed cells, scored exactly."""
    q = np.asarray(list(query), float)
    near = np.argsort(-(centroids @ q), kind="stable")[:probes] if len(centroids) and centroids.shape[1] == len(q) else []
    return topk(indexed.filter(F.col("cell").isin([int(x) for x in near]) if len(near) else F.lit(False)), query, k, id_col, embedding=embedding)


def search(chunks: DataFrame, queries: DataFrame, k: int, id_col: str = "id", embedding: str = "embedding", centroids: np.ndarray | None = None, probes: int = 8, rows_block: int = 1 << 22, query_block: int = 1 << 17) -> DataFrame:
    """query, id, score, nth: for each row of queries (id, embedding) its k best chunks by cosine, then id.

    Rows and queries meet in blocks of so many numbers (rows_block, query_block), each pair of blocks in a task of its own, which hands on k rows a query. With
    centroids, chunks must have their cell (ivf_assign), and a query only meets the rows of the cells it probes. A query without a vector
    has no result; rows without one, or with one of another length, are in none."""
    own = queries.filter(F.size(embedding) > 0).select(F.col(id_col).alias("query"), F.col(embedding).cast("array<double>").alias("v"))
    rows = chunks.filter(F.size(embedding) > 0).select(F.col(id_col).alias("id"), F.col(embedding).cast("array<double>").alias("v"), "cell" if centroids is not None else F.size(embedding).alias("cell"))
    if centroids is None:
        own = own.withColumn("cell", F.size("v"))
    else:

        @F.pandas_udf("array<int>")
        def probed(v: pd.Series) -> pd.Series:
            return nearest_cells(v, centroids, probes)

        own = own.filter(F.size("v") == (centroids.shape[1] if len(centroids) else -1)).withColumn("cell", F.explode(probed("v")))
    # how many blocks of rows and of queries each cell has: a number a cell
    size = F.sum(F.size("v"))
    parts = rows.groupBy("cell").agg(F.ceil(size / rows_block).alias("rows")).join(own.groupBy("cell").agg(F.ceil(size / query_block).alias("queries")), "cell")
    to = lambda n: F.explode(F.sequence(F.lit(0), F.col(n).cast("int") - 1))
    a = rows.join(F.broadcast(parts), "cell").withColumn("a", F.pmod(F.xxhash64("id"), F.col("rows"))).withColumn("b", to("queries")).select("cell", "a", "b", "id", "v")
    b = own.join(F.broadcast(parts), "cell").withColumn("b", F.pmod(F.xxhash64("query"), F.col("queries"))).withColumn("a", to("rows")).select("cell", "a", "b", "query", "v")
    kinds = f"query {queries.schema[id_col].dataType.simpleString()}, id {chunks.schema[id_col].dataType.simpleString()}, score double"
    found = b.groupBy("cell", "a", "b").cogroup(a.groupBy("cell", "a", "b")).applyInArrow(_nearest(k), kinds)
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return found.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= k)


def _nearest(k: int, step: int = 64):
    """The k best rows of a block for each query of a block: cut to k before anything is gathered."""

    def run(own, rows):
        import pyarrow as pa

        asked, at, scores = [], [], []
        if own.num_rows and rows.num_rows:
            m, q = unit(matrix(rows.column("v"))), unit(matrix(own.column("v")))
            ids = rows.column("id").combine_chunks()
            place = np.argsort(np.asarray(ids.to_numpy(zero_copy_only=False)), kind="stable")
            m = m[place]  # by id, so that the first of equal scores is the one with the least id
            few = min(k, len(m))
            for start in range(0, len(q), step):
                s = np.round((1 + q[start : start + step] @ m.T) / 2, 12)
                least = -np.partition(-s, few - 1, axis=1)[:, few - 1]
                for i, row in enumerate(s):
                    near = np.flatnonzero(row >= least[i])
                    near = near[np.argsort(-row[near], kind="stable")][:k]
                    asked.append(np.full(len(near), start + i))
                    at.append(place[near])
                    scores.append(row[near])
        none = np.zeros(0, np.int64)
        asked, at = np.concatenate([none, *asked]), np.concatenate([none, *at])
        return pa.table({"query": own.column("query").take(pa.array(asked)), "id": rows.column("id").take(pa.array(at)), "score": pa.array(np.concatenate([np.zeros(0), *scores]))})

    return run


def hits(tables: dict[str, DataFrame], query, limit: int = 10, offset: int = 0, wanted: dict | None = None, metric: str = "cosine") -> tuple[DataFrame, DataFrame]:
    """The best chunks of documents that meet storage filters (wanted), with the document's title, source and metadata; and their page as one row.

    tables: chunks, documents, tags, languages. A limit of 0 is the default one."""
    from lexloom.operators.documents import with_metadata
    from lexloom.operators.filters import storage_filter

    limit, offset = limit or 10, max(offset, 0)
    rows = storage_filter(tables["chunks"], tables["documents"], tables["tags"], tables["languages"], wanted or {})
    found = topk(rows, query, limit, offset=offset, metric=metric)
    cols = [c for c in ("title", "source", "author", "content_type", "crawl_id") if c in tables["documents"].columns]
    ids = F.broadcast(found.select(F.col("document_id").alias("id")).distinct())  # `limit` rows at most
    docs = tables["documents"].select("id", *cols).join(ids, "id", "left_semi")
    own = with_metadata(docs, *(tables[n].join(ids.withColumnRenamed("id", "document_id"), "document_id", "left_semi") for n in ("tags", "languages")))
    out = found.join(own.withColumnRenamed("id", "document_id"), "document_id", "left").orderBy(F.desc("score"), "id")
    return out, page(out, tables["chunks"], offset, limit)
