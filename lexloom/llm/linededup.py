"""Repeated runs of lines, found in a suffix array over line numbers, with their later copies deleted. DataFrame functions only.

Lines with a word are numbered by a hash of 128 bits. Prefix doubling ranks the suffixes of all documents by their first 1, 2,
4, ... lines: each round pairs a suffix's rank with the rank of the suffix that many lines on, sorts the distinct pairs by
range and numbers them in that order. Suffixes whose block of lines occurs once leave the rounds, so only repeated lines are
carried, and rounds end where a block must hold min_words words, which is at most log2(min_words) of them.

A run counts from min_words words on. At each line the shortest such run that starts there, and the shortest that ends
there, are blocks whose interval of common prefixes in the suffix array is named by two overlapping ranks. In each interval
the first occurrence (by id, then line) stays and every other one is deleted; their union is exactly the union of the
maximal repeated runs of min_words words or more, as a longer run is covered by the blocks at its lines.

Defined results: null texts stay null, and empty ones empty; rows with the same id and text count as one document and all
get its result; null ids come first; a run that overlaps its own copy (a line over and over) shrinks to its first period; lines
without a word are kept and never part of a run; a document that is a whole copy is left with an empty text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.llm.common import written

WORD = r"[^\x20\x09-\x0D]+"
AT = ["doc", "th", "i"]


def lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc, th (the text's hash), i (number among its lines with a word), no (among all its lines), w (words), h1, h2."""
    parts = F.filter(F.transform(F.split(text_col, "\n"), lambda x, j: F.struct(j.alias("no"), F.regexp_count(x, F.lit(WORD)).alias("w"), F.xxhash64(x).alias("h1"), F.xxhash64(F.lit(7), x).alias("h2"))), lambda s: s["w"] > 0)
    found = docs.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("th"), F.posexplode(parts).alias("i", "s"))
    return found.select(*AT, "s.no", "s.w", "s.h1", "s.h2")


def ranked(keys: DataFrame, by: list[str]) -> DataFrame:
    """Distinct keys that occur twice or more, numbered in their order: range partitions, each sorted, in sequence."""
    many = keys.groupBy(*by).agg(F.count("*").alias("n")).filter("n > 1").select(*by)
    return many.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("rank", F.monotonically_increasing_id())


def suffix_ranks(found: DataFrame, depth: int) -> tuple[DataFrame, DataFrame]:
    """Repeated lines, and the ranks of the suffixes at each level: level, doc, th, i, rank (by the first 2**level lines)."""
    names = written(ranked(found, ["h1", "h2"]))
    repeated = written(found.join(names, ["h1", "h2"]).select(*AT, "no", "w", "rank").distinct())  # once for rows with the same id and text
    level, out = repeated.select(*AT, "rank"), None
    for k in range(depth + 1):
        out = level.withColumn("level", F.lit(k)) if out is None else out.unionByName(level.withColumn("level", F.lit(k)))
        if k == depth:
            break
        a, b = level.alias("a"), level.select(F.col("doc").alias("d2"), F.col("th").alias("t2"), (F.col("i") - 2**k).alias("i2"), F.col("rank").alias("rank2"))
        pairs = written(a.join(b, F.col("doc").eqNullSafe(F.col("d2")) & (F.col("th") == F.col("t2")) & (F.col("i") == F.col("i2"))).select(*AT, F.col("rank").alias("r1"), "rank2"))
        names = written(ranked(pairs, ["r1", "rank2"]))
        level = written(pairs.join(names, ["r1", "rank2"]).select(*AT, "rank"))
        if level.isEmpty():
            break
    return repeated, out


def blocks(repeated: DataFrame, min_words: int) -> DataFrame:
    """doc, th, i, size: the shortest blocks of repeated lines with min_words words that start or end at each line."""
    own = Window.partitionBy("doc", "th")
    rows = repeated.withColumn("run", F.col("i") - F.row_number().over(own.orderBy("i")))
    run = Window.partitionBy("doc", "th", "run")
    rows = rows.withColumn("end", F.sum("w").over(run.orderBy("i"))).withColumn("begin", F.col("end") - F.col("w"))
    ahead, behind = run.orderBy("begin").rangeBetween(0, min_words - 1), run.orderBy("end").rangeBetween(-(min_words - 1), 0)
    rows = rows.select(*AT, F.count("*").over(ahead).alias("f"), F.sum("w").over(ahead).alias("fw"), F.count("*").over(behind).alias("g"), F.sum("w").over(behind).alias("gw"))
    ends = F.array(F.struct("i", F.col("f").cast("int").alias("size"), F.col("fw").alias("words")), F.struct((F.col("i") - F.col("g") + 1).cast("int").alias("i"), F.col("g").cast("int").alias("size"), F.col("gw").alias("words")))
    out = rows.select("doc", "th", F.explode(F.array_distinct(ends)).alias("b")).filter(F.col("b.words") >= min_words)
    return out.select("doc", "th", "b.i", "b.size").distinct()


def later_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50) -> DataFrame:
    """doc, th, gone: for each document that loses lines, their numbers among all its lines, sorted."""
    depth = max(0, min_words.bit_length() - 1)  # a block has min_words lines at most
    repeated, ranks = suffix_ranks(written(lines(docs, id_col, text_col)), depth)
    found = blocks(repeated, min_words).withColumn("level", F.floor(F.log2("size")).cast("int"))
    found = found.withColumn("last", (F.col("i") + F.col("size") - F.call_function("shiftleft", F.lit(1), F.col("level"))).cast("int"))
    for at, name in (("i", "ra"), ("last", "rb")):
        r = ranks.select(F.col("doc").alias("d2"), F.col("th").alias("t2"), F.col("i").alias("i2"), F.col("level").alias("l2"), F.col("rank").alias(name))
        found = found.join(r, F.col("doc").eqNullSafe(F.col("d2")) & (F.col("th") == F.col("t2")) & (F.col(at) == F.col("i2")) & (F.col("level") == F.col("l2"))).drop("d2", "t2", "i2", "l2")
    found = written(found.select(*AT, "size", "ra", "rb"))
    first = written(found.groupBy("size", "ra", "rb").agg(F.min(F.struct(*AT)).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n"))  # apart from the join, which then may split a hot group
    copies = found.join(first, ["size", "ra", "rb"]).filter(~F.struct(*AT).eqNullSafe(F.col("first")))
    gone = copies.select("doc", "th", F.explode(F.sequence("i", F.col("i") + F.col("size") - 1)).alias("i")).distinct()
    numbers = repeated.select(F.col("doc").alias("d2"), F.col("th").alias("t2"), F.col("i").alias("i2"), "no")
    gone = gone.join(numbers, F.col("doc").eqNullSafe(F.col("d2")) & (F.col("th") == F.col("t2")) & (F.col("i") == F.col("i2")))
    return gone.groupBy("doc", "th").agg(F.sort_array(F.collect_list("no")).alias("gone"))


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50, count_col: str = "n_deleted") -> DataFrame:
    """docs with the text less the later copies, and the number of lines that went (in place of a column of that name)."""
    gone = written(later_copies(docs, id_col, text_col, min_words))
    names = [c for c in docs.columns if c.lower() != count_col.lower()]
    # lines travel instead of texts: below the join they are a column, which each line's look-up can refer to
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names if c != text_col]).alias("row"), F.col(id_col).alias("key"), F.xxhash64(text_col).alias("hash"), F.split(text_col, "\n").alias("parts"))
    # whether the smaller side would fit a broadcast or not: one plan at every size
    joined = rows.join(gone.hint("merge"), F.col("key").eqNullSafe(F.col("doc")) & (F.col("hash") == F.col("th")), "left")
    left = F.array_except(F.sequence(F.lit(0), F.size("parts") - 1), F.col("gone"))
    text = F.when(F.col("gone").isNull(), F.array_join("parts", "\n")).otherwise(F.array_join(F.transform(left, lambda j: F.get("parts", j)), "\n"))
    return joined.select(*(text.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in names), F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).alias(count_col))


SQL = """
WITH parts AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM documents
), worded AS (
  SELECT *, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS w FROM parts
), lines AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY no) AS i FROM worded WHERE w > 0
), pairs AS (
  SELECT a.doc_id AS d, b.doc_id AS e, a.i AS i, a.i - b.i AS diagonal, a.w AS w
  FROM lines a JOIN lines b ON a.line = b.line AND (b.doc_id < a.doc_id OR (b.doc_id = a.doc_id AND b.i < a.i))
), islands AS (
  SELECT *, i - row_number() OVER (PARTITION BY d, e, diagonal ORDER BY i) AS run FROM pairs
), runs AS (
  SELECT d, min(i) AS a, max(i) AS b FROM islands GROUP BY d, e, diagonal, run HAVING sum(w) >= 50
), gone AS (
  SELECT DISTINCT l.doc_id, l.no FROM lines l JOIN runs r ON l.doc_id = r.d AND l.i BETWEEN r.a AND r.b
), kept AS (
  SELECT p.doc_id, string_agg(p.line, chr(10) ORDER BY p.no) AS text FROM parts p LEFT JOIN gone g ON p.doc_id = g.doc_id AND p.no = g.no WHERE g.no IS NULL GROUP BY p.doc_id
), lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(l.n, 0) AS INTEGER) AS n_deleted, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id LEFT JOIN lost l ON d.doc_id = l.doc_id
"""
