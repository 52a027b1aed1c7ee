"""One query for each operator, with production parameters over whole tables; and SQL for those that it can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm import bpe, divergence, fingerprint, langid, licenses, linededup, packing, quality, resample, rules, simhash, toxicity, warc
from lexloom.llm.common import held_out, table

def byte_coder(path: str | None = None):
    """Makes the coder for byte_bpe_50k (path: its ranks), whose ids are those of byte_bpe_50k.json."""

    def make():
        import public_tokenizers

        return packing.byte_bpe(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)

    return make


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The path of a document: its source, a directory for each thousand ids, and its id."""
    path = F.concat_ws("/", F.col("source"), F.floor(F.col("doc_id") / 1000).cast("string"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return licenses.scanned(table(spark, sf_dir, "documents"), path)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, out = table(spark, sf_dir, "documents"), held_out(F.col("doc_id"), 5, 0)
    weights, bias = toxicity.trained(docs, table(spark, sf_dir, "labels"), ~out)
    found = toxicity.scored(docs, weights, bias)
    return found.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "offending")


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, out = table(spark, sf_dir, "documents"), held_out(F.col("doc_id"), 5, 0)
    return langid.predicted(docs, langid.trained(docs, ~out)).select("doc_id", out.alias("held_out"), "lang_pred", "score")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.coded(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit(table(spark, sf_dir, "documents"), byte_coder())


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.without_copies(table(spark, sf_dir, "documents")).select("doc_id", "n_deleted", "text")


def op8_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.neighbours(table(spark, sf_dir, "documents"))


def op9_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.host_quality(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, out = table(spark, sf_dir, "documents"), held_out(F.col("doc_id"), 4, 2)
    trees = quality.trained(docs, table(spark, sf_dir, "labels"), ~out)
    return quality.scored(docs, trees).select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audited(table(spark, sf_dir, "documents"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resample.drawn(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


SQL: dict[str, str] = {"op7_line_dedup": linededup.SQL, "op9_host_rules": rules.SQL, "op11_source_divergence": divergence.SQL, "op12_importance_resampling": resample.SQL, "op13_warc": warc.SQL}

QUERIES = {f.__name__: f for f in (op1_license_scan, op2_toxicity, op3_language, op4_bpe, op5_best_fit_packing, op6_simhash, op7_line_dedup, op8_fingerprint, op9_host_rules, op10_quality, op11_source_divergence, op12_importance_resampling, op13_warc)}
