"""Quality rules at the level of hosts: rule failures by host, shrunk with an empirical beta prior, joined back to documents.

Defined results: a null text has no words and fails the base rule; a null host is a host of its own; repeated rows count
as often as they occur; an empty table gives an empty table; only the id, host and text columns are read, so other
columns of any name don't matter.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import fresh, per_row, written

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WIDE = 2_000_000  # distinct words up to which three word numbers fit 63 bits


def repeat_words(words: list[bytes], width: int = 3) -> int:
    """Words inside windows of width words that occur twice or more, the first occurrence included."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    a = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    key = a[:n]
    for i in range(1, width):
        if i > 1 and len(seen) >= WIDE:
            key = np.unique(key, return_inverse=True)[1].astype(np.int64)
        key = key * len(seen) + a[i : n + i]
    _, which, times = np.unique(key, return_inverse=True, return_counts=True)
    twice = times[which] > 1
    covered = np.zeros(len(words), bool)
    for i in range(width):
        covered[i : n + i] |= twice
    return int(covered.sum())


def statistics(text: str | None) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines (with a word)."""
    if not text:
        return 0, 0, 0, 0, 0, 0
    words = text.encode("utf-8", "surrogatepass").split()  # bytes.split() knows these six spaces and no others
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeat_words(words), len(lines)


STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"


def text_statistics(docs: DataFrame, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text") -> DataFrame:
    return per_row(docs, [text_col], [id_col, host_col], STATS, lambda: statistics)


def failures():
    """The rules. base: the contract's. The others are lenient; they are what a host's rate counts too."""
    n, lines = F.col("n_words"), F.col("n_lines")
    base = (n < 50) | (100 * F.col("n_repeat_words") > 50 * n)
    soft = (10 * F.col("n_symbols") > 3 * n) | (2 * F.col("n_dup_lines") > lines) | (F.col("word_chars") > 20 * n) | (F.col("word_chars") < 2 * n)
    return base, soft


def host_rates(stats: DataFrame, host_col: str) -> DataFrame:
    """A row for each host: documents, failures, the failure rate shrunk toward the prior.

    The prior's two counts come from the mean and variance of the hosts' own rates (method of moments, less the variance
    that sampling alone explains); hosts are summed map-side first, so a host with a third of all rows is no hot key."""
    rates = stats.groupBy(F.col(host_col).alias("host")).agg(F.count("*").alias("n"), F.sum(F.col("failed").cast("long")).alias("k"))
    rates = written(rates)
    p = F.col("k") / F.col("n")
    prior = rates.agg(F.avg(p).alias("m"), F.coalesce(F.var_samp(p), F.lit(0.0)).alias("v"), F.avg(1 / F.col("n")).alias("w"))
    m = F.least(F.greatest(F.col("m"), F.lit(1e-6)), F.lit(1 - 1e-6))
    between = F.greatest(F.col("v") - m * (1 - m) * F.col("w"), F.lit(1e-9))
    weight = F.least(F.greatest(m * (1 - m) / between - 1, F.lit(2.0)), F.lit(1e6))
    prior = prior.select((m * weight).alias("alpha"), ((1 - m) * weight).alias("beta"))
    # one row against all hosts: the prior is a single row whatever the input
    return rates.join(F.broadcast(prior)).select("host", "n", "k", ((F.col("k") + F.col("alpha")) / (F.col("n") + F.col("alpha") + F.col("beta"))).alias("rate"))


def host_quality(docs: DataFrame, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text", max_rate: float = 0.5) -> DataFrame:
    """Statistics of each document, its host's shrunk failure rate, and whether it is kept.

    kept: the document fails no rule, and its host's shrunk rate is at most max_rate."""
    base, soft = failures()
    stats = text_statistics(docs, id_col, host_col, text_col).withColumns({"base_failed": base, "failed": base | soft})
    stats = written(stats)
    key = fresh(stats, "of_host")
    hosts = host_rates(stats, host_col).select(F.col("host").alias(key), F.col("rate").alias("host_rate"))
    joined = stats.join(hosts, F.col(host_col).eqNullSafe(F.col(key))).drop(key)
    return joined.withColumn("kept", ~F.col("failed") & (F.col("host_rate") <= max_rate))


def passing(docs: DataFrame, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text", max_rate: float = 0.5) -> DataFrame:
    """The rows of docs that host_quality keeps, with docs' columns. Texts are read twice rather than dealt out by id."""
    base, soft = failures()
    hosts = host_rates(written(text_statistics(docs, id_col, host_col, text_col).select(host_col, (base | soft).alias("failed"))), host_col)
    flag = fresh(docs, "failed")

    def judge():
        def failed(text):
            n, chars, symbols, dup, repeats, lines = statistics(text)
            return (n < 50 or 100 * repeats > 50 * n or 10 * symbols > 3 * n or 2 * dup > lines or chars > 20 * n or chars < 2 * n,)

        return failed

    good = per_row(docs, [text_col], docs.columns, f"`{flag}` boolean", judge).filter(~F.col(flag)).drop(flag)
    key = fresh(docs, "host")
    bad = hosts.filter(F.col("rate") > max_rate).select(F.col("host").alias(key))
    return good.join(bad, F.col(host_col).eqNullSafe(F.col(key)), "left_anti")


SQL = """
WITH w AS (
  SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents
), places AS (
  SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) > 2
), windows AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, words[i], words[i + 1], words[i + 2]) AS times FROM places
), covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM windows, (SELECT unnest([0, 1, 2]) AS k) WHERE times > 1 GROUP BY doc_id
), s AS (
  SELECT w.doc_id, w.source, len(words) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines,
    coalesce(c.n_repeat_words, 0) AS n_repeat_words
  FROM w LEFT JOIN covered c ON w.doc_id = c.doc_id
), f AS (
  SELECT *, len(lines) - len(list_distinct(lines)) AS n_dup_lines, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s
), g AS (
  SELECT *, base_failed OR 10 * n_symbols > 3 * n_words OR 2 * n_dup_lines > len(lines) OR word_chars > 20 * n_words OR word_chars < 2 * n_words AS failed FROM f
), hosts AS (
  SELECT source, count(*) AS n, sum(CAST(failed AS BIGINT)) AS k FROM g GROUP BY source
), moments AS (
  SELECT least(greatest(avg(k / n), 1e-6), 1 - 1e-6) AS m, coalesce(var_samp(k / n), 0) AS v, avg(1 / n) AS per FROM hosts
), prior AS (
  SELECT m, least(greatest(m * (1 - m) / greatest(v - m * (1 - m) * per, 1e-9) - 1, 2), 1e6) AS weight FROM moments
), rates AS (
  SELECT source, (k + m * weight) / (n + weight) AS rate FROM hosts, prior
)
SELECT g.doc_id, CAST(n_words AS BIGINT) AS n_words, word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, NOT failed AND rate <= 0.5 AS kept
FROM g JOIN rates r ON g.source IS NOT DISTINCT FROM r.source
"""
