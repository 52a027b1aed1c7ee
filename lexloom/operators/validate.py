"""Integrity rules over the seven tables: what is broken in each row, and between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions.text import is_content_hash, is_uuid
from lexloom.operators import ranks

SOURCES, STATUSES = ["upload", "crawl", "api"], ["active", "archived", "deleted"]


def broken(rules: list[tuple[str, str, Column]], category: str) -> Column:
    """Of (severity, rule, whether it is broken) those that are, as an array; a rule that can't be told isn't broken."""
    one = lambda s, n: F.struct(F.lit(s).alias("severity"), F.lit(category).alias("category"), F.lit(n).alias("rule"))
    return F.array_compact(F.array(*(F.when(F.coalesce(bad, F.lit(False)), one(s, n)) for s, n, bad in rules)))


def document_rules() -> list[tuple[str, str, Column]]:
    created, updated = F.try_to_timestamp(F.col("created_at").cast("string")), F.try_to_timestamp(F.col("updated_at").cast("string"))
    return [
        ("error", "bad_uuid", ~is_uuid(F.col("id"))),
        ("warning", "bad_hash", ~is_content_hash(F.col("content_hash"))),
        ("error", "bad_created_at", created.isNull()),
        ("error", "bad_updated_at", updated.isNull()),
        ("warning", "updated_before_created", updated < created),
        ("error", "negative_chunks_count", F.col("chunks_count") < 0),
        ("error", "negative_code_blocks_count", F.col("code_blocks_count") < 0),
        ("warning", "unknown_source", ~F.coalesce(F.col("source").isin(SOURCES), F.lit(False))),
        ("warning", "unknown_status", ~F.coalesce(F.col("status").isin(STATUSES), F.lit(False))),
    ]


def child_rules(category: str) -> list[tuple[str, str, Column]]:
    rules = [("error", "bad_uuid", ~is_uuid(F.col("id"))), ("warning", "missing_embedding", F.coalesce(F.size("embedding") <= 0, F.lit(True)))]
    if category == "chunk":
        rules += [("error", "negative_position", (F.col("start_position") < 0) | (F.col("end_position") < 0)), ("error", "empty_range", F.col("start_position") >= F.col("end_position"))]
    else:
        rules += [("warning", "missing_language", F.coalesce(F.trim("language") == "", F.lit(True)))]
    return [*rules, ("warning", "length_mismatch", F.length("content") != F.col("content_length"))]


KINDS = ("document", "chunk", "codeblock")


def judged(tables: dict[str, DataFrame]) -> DataFrame:
    """A narrow row for each document, chunk and code block: key (the document's id), kind, record_id, the counts that a document states, found (its broken rules). One scan of each table."""
    docs, chunks, blocks = tables["documents"], tables["chunks"], tables["code_blocks"]
    none = F.lit(None).cast("long")
    row = lambda df, key, kind, rules, a=none, b=none: df.select(F.col(key).cast("string").alias("key"), F.lit(kind).alias("kind"), F.col("id").cast("string").alias("record_id"), a.alias("chunks"), b.alias("blocks"), broken(rules, kind).alias("found"))
    out = row(docs, "id", "document", document_rules(), F.col("chunks_count").cast("long"), F.col("code_blocks_count").cast("long"))
    return out.unionByName(row(chunks, "document_id", "chunk", child_rules("chunk"))).unionByName(row(blocks, "document_id", "codeblock", child_rules("codeblock")))


def orphans(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.join(docs.select(F.col("id").alias("document_id")), "document_id", "left_anti")


def issue(rows: DataFrame, bad: Column, severity: str, category: str, rule: str, id_col: str = "id") -> DataFrame:
    """One rule's issues by itself."""
    return rows.filter(bad).select(F.lit(severity).alias("severity"), F.lit(category).alias("category"), F.lit(rule).alias("rule"), F.col(id_col).cast("string").alias("record_id"))


def count_rule(docs: DataFrame, rows: DataFrame, column: str) -> DataFrame:
    """Documents whose stored count differs from the number of their rows."""
    n = rows.groupBy(F.col("document_id").alias("id")).agg(F.count("*").alias("n"))
    return issue(docs.join(n, "id", "left"), F.coalesce("n", F.lit(0)) != F.col(column), "warning", "relationship", f"{column}_mismatch")


def validate(tables: dict[str, DataFrame], most: int = 1000) -> DataFrame:
    """All issues, errors first, cut after a deterministic order. An orphan is reported as a child and as an orphan.

    Row rules are told in the scan; what relates tables (counts, orphans) from one sum by document id over the narrow rows, joined back to them."""
    rows = ranks.kept(judged(tables))
    n = [F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{k}") for k in KINDS]
    sums = rows.groupBy(F.col("key").alias("_key")).agg(*n)
    both = rows.join(sums, F.col("key").eqNullSafe(F.col("_key")))
    doc, child = F.col("kind") == "document", F.col("kind") != "document"
    lost = child & (F.col("key").isNull() | (F.col("n_document") == 0))
    counts = broken([("warning", "chunks_count_mismatch", doc & (F.col("n_chunk") != F.col("chunks"))), ("warning", "code_blocks_count_mismatch", doc & (F.col("n_codeblock") != F.col("blocks")))], "relationship")
    missing = F.array_union(broken([("error", "missing_document", lost & (F.col("kind") == "chunk"))], "chunk"), broken([("error", "missing_document", lost & (F.col("kind") == "codeblock"))], "codeblock"))
    alone = broken([("error", "orphan_chunk", lost & (F.col("kind") == "chunk")), ("error", "orphan_code_block", lost & (F.col("kind") == "codeblock"))], "orphan")
    found = both.select("record_id", F.explode(F.concat("found", counts, missing, alone)).alias("r")).select("r.severity", "r.category", "r.rule", "record_id")
    return found.orderBy("severity", "category", "rule", "record_id").limit(most)


def summary(issues: DataFrame) -> DataFrame:
    """One row: errors, warnings, total, valid (no errors)."""
    n = lambda s: F.coalesce(F.sum((F.col("severity") == s).cast("int")), F.lit(0)).cast("int")
    return issues.agg(n("error").alias("errors"), n("warning").alias("warnings"), F.count("*").cast("int").alias("total")).withColumn("valid", F.col("errors") == 0)


def validate_document(docs: DataFrame, document_id: str) -> DataFrame:
    """One row: the document's issues, and valid: there are none at all."""
    own = docs.filter(F.col("id") == F.lit(document_id)).select(F.explode(broken(document_rules(), "document")).alias("r"))
    return own.agg(F.array_sort(F.collect_list("r.rule")).alias("issues")).withColumn("valid", F.size("issues") == 0)
