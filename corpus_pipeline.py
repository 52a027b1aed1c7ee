"""From raw documents to packed sequences: quality rules, toxicity, line dedup, near-duplicates, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm import linededup, packing, rules, simhash, toxicity
from lexloom.llm.common import forget, fresh, held_out, small_batches, table, written
from lexloom.llm.queries import byte_coder


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, of hosts that pass. Null and empty texts have no words and go; documents without a host are of one host; rows that repeat a document count each, and stay or go together."""
    small_batches(spark)
    return rules.passing(docs)


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored under one half; learned from the labels of those whose id leaves a remainder other than 0. Null and empty texts score 0 and stay; equal texts score alike; without both kinds of label all stay."""
    small_batches(spark)
    model = toxicity.trained(docs, table(spark, sf_dir, "labels"), ~held_out(F.col("doc_id"), 5, 0))
    return toxicity.clean(docs, *model)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of runs of 50 words or more; those of which nothing is left go. Null and empty texts stay as they are; of equal lines the first by id, then place, stays; rows with the same id and text count as one and all get its text."""
    small_batches(spark)
    n = fresh(docs, "n_deleted")
    found = linededup.without_copies(docs, count_col=n)
    lost = F.col(n) > 0
    found = found.filter(~lost | F.col("text").rlike(linededup.WORD))
    return found.withColumn("n_chars", F.when(lost, F.length("text").cast("long")).otherwise(F.col("n_chars"))).drop(n)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group: linked fingerprints, or texts that share 0.8 of their five-word shingles; of rows that share an id all stay or go. Null texts are empty, and texts without a word alike; rows without an id stay."""
    small_batches(spark)
    other = fresh(docs, "other")
    others = written(simhash.groups(docs).filter("id <> component").select(F.col("id").alias(other)).distinct())
    side = F.broadcast(others) if others.count() <= simhash.MOST_BROADCAST else others.hint("merge")
    return docs.join(side, F.col("doc_id") == F.col(other), "left_anti")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their place in sequences of 2048 tokens. A null or empty text is the closing id alone; rows that repeat a document are packed each; which of equally long pieces stands where follows the tables' order."""
    small_batches(spark)
    return packing.best_fit(docs, byte_coder())


STAGES = [("quality_rules", quality), ("toxicity", not_toxic), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("packing", pack)]

#: The learned scores and the tokens are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
        if before is not None:
            forget(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
