"""Importance resampling towards a target: word n-grams hashed to buckets by CRC, weighed by the log ratio of two corpora, drawn with Gumbel noise.

The CRC of an n-gram is composed, not computed: crc(a b) = shift(crc(a), len(b) + 1) ^ shift(crc(" "), len(b)) ^ crc(b), where shift by a length
is a 32 x 32 matrix over GF(2), kept as four tables of 256 sums of its columns. So each word's CRC is computed once, and no n-gram is ever a string.

Bucket counts are summed in each task and then over tasks: a fixed number of buckets, whatever the input. Ranks come from a table dealt out by
range of (score, id) and the sizes of its parts, so no task sees more than its part.

Defined results: a null text is empty; no words give no features and weight 0; a null id counts as the text '' for its noise and comes
before others in ties; repeated rows are documents of their own and are ranked one after the other; an empty table gives an empty table, an
empty target counts 0 in each bucket; other columns are not read, whatever their names. A text is taken in stretches cut between words.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lexloom.llm.common import forget, released, ship, written

BUCKETS = 10_000
POLY = 0xEDB88320
STRETCH = 1 << 20

#: bytes of words once A-Z are lower-cased: 0-9, a-z and all beyond ASCII
LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)
IN_WORD = np.array([0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 for b in LOWER])
OUT = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")


def byte_table() -> np.ndarray:
    """What one further byte makes of each low byte of a CRC."""
    v = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        v = np.where(v & 1, (v >> 1) ^ np.uint32(POLY), v >> 1)
    return v


BYTE = byte_table()


class Shifts:
    """shift(crc, length): the CRC of a string followed by so many zero bytes, but for that of the zeros alone; of arrays."""

    NEAR = 64  # lengths with a matrix of their own; longer ones are products of powers of two

    def __init__(self):
        unit = (np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]).astype(np.uint32)
        near = [unit]
        for _ in range(self.NEAR):
            near.append(BYTE[near[-1] & 255] ^ (near[-1] >> 8))
        self.near = np.stack(near[: self.NEAR])
        self.powers = [near[self.NEAR]]

    @staticmethod
    def by(m: np.ndarray, crc: np.ndarray) -> np.ndarray:
        return m[0][crc & 255] ^ m[1][(crc >> 8) & 255] ^ m[2][(crc >> 16) & 255] ^ m[3][crc >> 24]

    def __call__(self, crc: np.ndarray, length: np.ndarray) -> np.ndarray:
        low = length % self.NEAR
        out = self.near[low, 0, crc & 255] ^ self.near[low, 1, (crc >> 8) & 255] ^ self.near[low, 2, (crc >> 16) & 255] ^ self.near[low, 3, crc >> 24]
        rest = length // self.NEAR
        k, at = 0, np.flatnonzero(rest)
        while len(at):
            if k == len(self.powers):
                self.powers.append(self.by(self.powers[-1], self.powers[-1]))
            odd = at[(rest[at] >> k) & 1 == 1]
            out[odd] = self.by(self.powers[k], out[odd])
            k += 1
            at = at[rest[at] >> k > 0]
        return out


SHORT = 32


def word_crcs(text: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-32 of each word of text (lower-cased bytes): a byte of all words at a time, longer ones by themselves."""
    order = np.argsort(np.minimum(lengths, SHORT + 1).astype(np.uint8), kind="stable")[::-1]
    size, at = lengths[order], starts[order]
    first = int(np.searchsorted(-size, -SHORT, "left"))  # those before are longer
    crc = np.full(len(size), 0xFFFFFFFF, np.uint32)
    for j in range(int(size[first]) if first < len(size) else 0):
        n = int(np.searchsorted(-size, -j, "left"))
        part = crc[first:n]
        crc[first:n] = BYTE[(part ^ text[at[first:n] + j]) & 255] ^ (part >> 8)
    out = np.empty_like(crc)
    out[order] = ~crc
    for i in order[:first].tolist():
        out[i] = zlib.crc32(text[starts[i] : starts[i] + lengths[i]])
    return out


def stretches(texts: list[bytes]) -> Iterator[tuple[bytes, np.ndarray, np.ndarray]]:
    """Rows joined, or a long row's parts, cut between words: bytes, where rows start in them, and which rows these are."""
    held, rows, size = [], [], 0

    def joined():
        starts = np.cumsum([0, *(len(t) + 1 for t in held[:-1])])
        return b"\n".join(held), starts, np.array(rows)

    for i, t in enumerate(texts):
        at = 0
        while len(t) - at > STRETCH:
            found = OUT.search(t, at + STRETCH)
            if not found:
                break
            if held:
                yield joined()
                held, rows, size = [], [], 0
            yield t[at : found.end()], np.array([0]), np.array([i])
            at = found.end()
        if size + len(t) - at > STRETCH and held:
            yield joined()
            held, rows, size = [], [], 0
        held.append(t[at:] if at else t)
        rows.append(i)
        size += len(t) - at
    if held:
        yield joined()


def features(texts: list[bytes], longest: int, shifts: Shifts) -> Iterator[tuple[list[np.ndarray], list[np.ndarray]]]:
    """For each stretch: by n-gram length from 1 to longest, the rows of the n-grams that end in it, and their CRCs."""
    kept = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)  # the words before, which n-grams may begin with
    space = np.uint32(zlib.crc32(b" "))
    for data, row_starts, rows in stretches(texts):
        text = LOWER[np.frombuffer(data, np.uint8)]
        inside = IN_WORD[text]
        edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]])))
        starts, lengths = edges[::2], edges[1::2] - edges[::2]
        crc = word_crcs(text, starts, lengths)
        row = rows[np.searchsorted(row_starts, starts, "right") - 1]
        new, before = len(crc), len(kept[0])
        crc, lengths, row = (np.concatenate(x) for x in zip(kept, (crc, lengths, row), strict=True))
        spaced = shifts(np.full(len(crc), space), lengths) ^ crc  # of " " and the word
        of, out, gram = [row[before:]], [crc[before:]], crc
        for n in range(2, longest + 1):
            gram = shifts(gram[:-1], lengths[n - 1 :] + 1) ^ spaced[n - 1 :] if len(gram) else gram  # gram[i]: n words from word i on
            ends = np.arange(n - 1, n - 1 + len(gram))
            whole = (ends >= before) & (row[ends] == row[ends - n + 1])
            of.append(row[ends[whole]])
            out.append(gram[whole])
        keep = max(0, len(crc) - longest + 1)
        kept = crc[keep:], lengths[keep:], row[keep:]
        if new:
            yield of, out


def texts_of(batch: pa.RecordBatch, name: str) -> list[bytes]:
    return [t or b"" for t in batch.column(name).cast(pa.large_binary()).to_pylist()]


def bucket_counts(docs: DataFrame, text_col: str = "text", longest: int = 3, buckets: int = BUCKETS) -> DataFrame:
    """bucket, n: how many features fall in each bucket that has one; summed up in tasks first."""

    def run(batches):
        shifts, total = Shifts(), np.zeros(buckets, np.int64)
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                for _, crcs in features(texts_of(b.slice(at, 1000), "text"), longest, shifts):
                    for c in crcs:
                        total += np.bincount(c % np.uint32(buckets), minlength=buckets)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array(total[there])], names=["bucket", "n"])

    ship(docs.sparkSession)
    return docs.select(F.col(text_col).alias("text")).mapInArrow(released(run), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, source_col: str = "text", target_col: str = "text", longest: int = 3, buckets: int = BUCKETS) -> np.ndarray:
    """floor(1000 * ln) of each bucket's smoothed share in the target over that in the source. Only the buckets' counts come to the driver."""

    def counts(df, col):
        out = np.zeros(buckets, np.int64)
        for bucket, n in bucket_counts(df, col, longest, buckets).collect():  # at most `buckets` rows
            out[bucket] = n
        return out

    s, t = counts(source, source_col), counts(target, target_col)
    own, other = float(int(s.sum()) + buckets), float(int(t.sum()) + buckets)
    return np.array([math.floor(1000 * math.log((float(x + 1) * own) / (float(y + 1) * other))) for x, y in zip(t.tolist(), s.tolist(), strict=True)], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, keep: list[str], text_col: str = "text", longest: int = 3) -> DataFrame:
    """keep (columns) and n_words, n_features, weight (the sum of the features' gains)."""
    buckets = len(gain)
    schema = StructType([docs.schema[c] for c in keep]).add("n_words", "long").add("n_features", "long").add("weight", "long")
    inner = StructType([type(f)(f"c{i}", f.dataType) for i, f in enumerate(schema.fields)])
    score = gain.astype(np.float64)  # sums of integers, exact under 2**53

    def run(batches):
        shifts = Shifts()
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                n = part.num_rows
                words, count, weight = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
                for rows, crcs in features(texts_of(part, "text"), longest, shifts):
                    words += np.bincount(rows[0], minlength=n)
                    for r, c in zip(rows, crcs, strict=True):
                        count += np.bincount(r, minlength=n)
                        weight += np.bincount(r, weights=score[c % np.uint32(buckets)], minlength=n).astype(np.int64)
                yield pa.RecordBatch.from_arrays([*(part.column(f"c{i}") for i in range(len(keep))), pa.array(words), pa.array(count), pa.array(weight)], names=inner.names)

    ship(docs.sparkSession)
    rows = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)), F.col(text_col).alias("text"))
    return rows.mapInArrow(released(run), inner).toDF(*schema.names)


def noise(doc_id: Column, seed: int = 42) -> Column:
    """floor(1000 times a Gumbel number) from a hash of the id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def ranked(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """rows with their rank (long, from 1) in this order, rows alike in it one after the other: dealt out by range, then counted by part."""
    rows = written(rows.withColumn("_row", F.monotonically_increasing_id()))
    order = [*order, F.col("_row").asc()]
    at = F.monotonically_increasing_id()
    parts = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.shiftright(at, 33)).withColumn("_place", at.bitwiseAND((1 << 33) - 1)))
    sizes = sorted(map(tuple, parts.groupBy("_part").count().collect()))  # a row for each partition
    before, starts = 0, []
    for part, n in sizes:
        starts.append((part, before))
        before += n
    offsets = rows.sparkSession.createDataFrame(starts, "_of long, _before long")
    forget(rows)
    return parts.join(F.broadcast(offsets), F.col("_part") == F.col("_of")).withColumn(name, F.col("_before") + F.col("_place") + 1).drop("_row", "_part", "_place", "_of", "_before")


def drawn(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", percent: int = 5, least_words: int = 20, longest: int = 3, buckets: int = BUCKETS, seed: int = 42) -> DataFrame:
    """id, n_words, n_features, weight, score and rank: the place among the floor(percent * N / 100) documents drawn of the N with least_words words, else null."""
    rows = weighed(docs, gains(docs, target, text_col, target_col, longest, buckets), [id_col], text_col, longest)
    rows = written(rows.withColumn("score", F.col("weight") + noise(F.col(f"`{id_col}`"), seed)))
    able = F.col("n_words") >= least_words
    most = percent * rows.filter(able).count() // 100
    ranks = ranked(rows.filter(able), [F.col("score").desc(), F.col(f"`{id_col}`").asc_nulls_first()], "rank")
    return ranks.withColumn("rank", F.when(F.col("rank") <= most, F.col("rank"))).unionByName(rows.filter(~able).withColumn("rank", F.lit(None).cast("long")))


SQL = r"""
WITH RECURSIVE bits(k, i, v) AS (
  SELECT 0, i, i FROM (SELECT unnest(range(256))::BIGINT AS i)
  UNION ALL
  SELECT k + 1, i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bits WHERE k < 8
), byte AS (SELECT list(v ORDER BY i) AS made FROM bits WHERE k = 8
), texts AS (
  SELECT 'd' AS of, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w, doc_id FROM documents
  UNION ALL
  SELECT 't', row_number() OVER (), regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), NULL FROM benchmark
), words AS (
  SELECT of, r, w, unnest(range(1, len(w) + 1)) AS i FROM texts
), grams AS (
  SELECT of, r, w[i] AS g FROM words
  UNION ALL SELECT of, r, w[i] || ' ' || w[i + 1] FROM words WHERE i + 1 <= len(w)
  UNION ALL SELECT of, r, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FROM words WHERE i + 2 <= len(w)
), counted AS (SELECT of, r, g, count(*) AS n FROM grams GROUP BY ALL
), named AS (SELECT g, hex(encode(g)) AS x FROM (SELECT DISTINCT g FROM counted)
), hashed AS (
  SELECT g, xor(list_reduce(list_transform(range(0, len(x) // 2), lambda j: ('0x' || substr(x, 2 * j + 1, 2))::BIGINT), lambda c, b: xor(made[xor(c & 255, b) + 1], c >> 8), 4294967295::BIGINT), 4294967295) % 10000 AS bucket
  FROM named, byte
), falls AS (SELECT of, r, bucket, n FROM counted JOIN hashed USING (g)
), s AS (SELECT bucket, sum(n) AS n FROM falls WHERE of = 'd' GROUP BY bucket
), t AS (SELECT bucket, sum(n) AS n FROM falls WHERE of = 't' GROUP BY bucket
), whole AS (SELECT coalesce((SELECT sum(n) FROM s), 0) AS ss, coalesce((SELECT sum(n) FROM t), 0) AS tt
), gain AS (
  SELECT s.bucket, floor(1000 * ln(((coalesce(t.n, 0) + 1)::DOUBLE * (ss + 10000)::DOUBLE) / ((s.n + 1)::DOUBLE * (tt + 10000)::DOUBLE)))::BIGINT AS gain
  FROM whole, s LEFT JOIN t ON s.bucket = t.bucket
), weights AS (
  SELECT r, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM falls JOIN gain USING (bucket) WHERE of = 'd' GROUP BY r
), docs AS (
  SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM texts LEFT JOIN weights ON texts.r = weights.r WHERE of = 'd'
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS FIRST) AS place, 5 * (SELECT count(*) FROM docs WHERE n_words >= 20) // 100 AS most FROM docs
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= most THEN place END AS rank FROM placed
"""
