"""Posting blocks: the keyword rows of a table, stored by keyword and cut into blocks, so that a query reads its own words and a top-k skips blocks that can't enter.

A block is a keyword's documents of one bucket (a hash of the document, the same for all keywords), with the greatest frequency in it. So the blocks of several
keywords that may hold one document have one bucket, and the sum of their greatest frequencies bounds the score of every document in the bucket: a plain sum by bucket,
no walk through lists. `topk` takes the k-th best score of the buckets with the highest bounds, and then reads those buckets only whose bound is not less.
Rows move once: to the tasks that make the blocks of a keyword and SPAN buckets, which bounds what a common keyword brings a task. A file's blocks lie sorted
by keyword and bucket, so a filter on keywords reaches its statistics.

Defined results: a document's frequency in a keyword is the sum over its sources; rows without a keyword or document are left out; ties end in the document;
a query without keywords finds nothing; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKET = 1024  # documents of a bucket, about
SPAN = 64  # buckets whose blocks of one keyword are made in one task


def blocks(keyword_rows: DataFrame, buckets: int | None = None) -> DataFrame:
    """keyword, bucket, most, n, entries (document_id, frequency), in each partition in the order of keyword and bucket. buckets: by default one for each BUCKET documents,
    which takes a pass over the rows; whoever knows the documents says it (buckets_for). Rows needn't be summed up."""
    rows = keyword_rows.filter("keyword IS NOT NULL AND document_id IS NOT NULL")
    buckets = buckets or buckets_for(rows, "document_id")
    placed = rows.select("keyword", F.pmod(F.xxhash64("document_id"), F.lit(buckets)).cast("int").alias("bucket"), "document_id", "frequency")
    placed = placed.withColumn("span", F.floor(F.col("bucket") / SPAN)).repartition("keyword", "span")
    summed = placed.groupBy("keyword", "span", "bucket", "document_id").agg(F.sum("frequency").cast("long").alias("frequency"))
    # of one bucket: a bounded number of documents, however common the keyword
    made = summed.groupBy("keyword", "span", "bucket").agg(F.max("frequency").alias("most"), F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("document_id", "frequency"))).alias("entries"))
    return made.drop("span").sortWithinPartitions("keyword", "bucket")


def buckets_for(docs: DataFrame, id_col: str = "id") -> int:
    """One for each BUCKET documents, about."""
    return max(1, docs.agg(F.approx_count_distinct(id_col)).first()[0] // BUCKET)


def store(keyword_rows: DataFrame, path: str, buckets: int | None = None) -> DataFrame:
    """The blocks as files; small row groups, so that their statistics tell keywords apart."""
    blocks(keyword_rows, buckets).write.option("parquet.block.size", 1 << 20).mode("overwrite").parquet(path)
    return opened(keyword_rows.sparkSession, path)


def opened(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def of_words(posted: DataFrame, words: list[str]) -> DataFrame:
    """The blocks of these words: a filter that the scan takes."""
    own = sorted({w.lower() for w in words})
    return posted.filter(F.col("keyword").isin(own) if own else F.lit(False))


def entries(posted: DataFrame) -> DataFrame:
    """Keyword rows again: document_id, keyword, frequency."""
    return posted.select("keyword", F.explode("entries").alias("e")).select("e.document_id", "keyword", F.col("e.frequency").alias("frequency"))


def _scores(posted: DataFrame, *keys: str) -> DataFrame:
    rows = posted.select("keyword", *keys, F.explode("entries").alias("e")).select("keyword", *keys, "e.document_id", "e.frequency")
    return rows.groupBy(*keys, "document_id").agg(F.sum("frequency").cast("double").alias("score"), F.count("*").cast("int").alias("matched"))


def search(posted: DataFrame, words: list[str]) -> DataFrame:
    """document_id, score (sum of frequencies), matched (distinct keywords), as keyword.search of the rows."""
    return _scores(of_words(posted, words))


def topk(posted: DataFrame, words: list[str], k: int, least: int = 1, seeds: int = 8) -> DataFrame:
    """The k best documents that match `least` words, by score, then document. seeds: how many buckets, those with the highest bounds, give the score to beat."""
    own = of_words(posted, words)
    bounds = own.groupBy("bucket").agg(F.sum("most").alias("bound"), F.count("*").alias("words")).filter(F.col("words") >= least)
    first = bounds.orderBy(F.desc("bound"), "bucket").limit(seeds).select("bucket")  # a few rows, which Spark broadcasts
    seen = _scores(own.join(first, "bucket", "left_semi")).filter(F.col("matched") >= least).orderBy(F.desc("score")).limit(k)
    beat = seen.agg(F.when(F.count("*") >= k, F.min("score")).otherwise(0.0).alias("beat"))  # a single row
    left = bounds.crossJoin(F.broadcast(beat)).filter(F.col("bound") >= F.col("beat")).select("bucket")
    found = _scores(own.join(left, "bucket", "left_semi")).filter(F.col("matched") >= least)
    return found.orderBy(F.desc("score"), "document_id").limit(k)


def skipped(posted: DataFrame, words: list[str], k: int, least: int = 1, seeds: int = 8) -> DataFrame:
    """One row: blocks of the words, and how many of these topk reads to the end."""
    own = of_words(posted, words)
    bounds = own.groupBy("bucket").agg(F.sum("most").alias("bound"), F.count("*").alias("words"))
    best = topk(posted, words, k, least, seeds).agg(F.when(F.count("*") >= k, F.min("score")).otherwise(0.0).alias("beat"))
    return bounds.crossJoin(F.broadcast(best)).agg(F.sum("words").alias("blocks"), F.sum(F.when(F.col("bound") >= F.col("beat"), F.col("words")).otherwise(0)).alias("read"))
