"""Document fingerprints: threshold-scaled sketches.

A sketch keeps every shingle hash up to a threshold. The threshold is a fixed fraction of all hash values, or higher where that
would keep fewer than `least` hashes, and stands in the sketch. Two sketches compare under the lower of their thresholds,
below which both are complete, so a short document can be looked for in a very long one, and the union of two sketches is
the sketch of both texts.

Defined results: a null text is empty and has a sketch without hashes; equal texts have equal sketches and likeness 1; a sketch
without hashes under the common threshold has likeness 0 to any other; fewer words than a shingle holds are one shingle.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.llm.common import shingle_hashes

TOP = (1 << 40) - 1  # hashes are cut to 40 bits


def sketch(text: str | None, scale: int = 8, least: int = 16, width: int = 5) -> tuple[int, np.ndarray]:
    """Threshold, and the sorted distinct hashes up to it."""
    limit, kept = TOP // scale, []
    for h in shingle_hashes(text, width):
        h = np.unique(h >> np.uint64(24))
        kept.append(h[: max(least + 1, int(np.searchsorted(h, limit, "right")))])  # the threshold may rise to one of the smallest of all
        if len(kept) > 16:
            kept = [np.unique(np.concatenate(kept))]
    every = np.unique(np.concatenate(kept)) if kept else np.zeros(0, np.uint64)
    if len(every) <= least:
        return TOP, every
    limit = max(limit, int(every[least - 1]))
    return limit, every[every <= limit]


def packed(s: tuple[int, np.ndarray]) -> str:
    data = np.concatenate([[s[0]], s[1]]).astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:]
    return base64.urlsafe_b64encode(data.tobytes()).decode()


def unpacked(text: str) -> tuple[int, np.ndarray]:
    data = np.frombuffer(base64.urlsafe_b64decode(text), np.uint8).reshape(-1, 5)
    values = np.concatenate([np.zeros((len(data), 3), np.uint8), data], axis=1).copy().view(">u8").ravel().astype(np.uint64)
    return int(values[0]), values[1:]


def merged(a: tuple[int, np.ndarray], b: tuple[int, np.ndarray]) -> tuple[int, np.ndarray]:
    limit = min(a[0], b[0])
    both = np.union1d(a[1], b[1])
    return limit, both[both <= limit]


def likeness(a: tuple[int, np.ndarray], b: tuple[int, np.ndarray]) -> float:
    """Estimated share of the smaller text's shingles that the other has too."""
    if a[0] == b[0] and np.array_equal(a[1], b[1]):
        return 1.0
    limit = min(a[0], b[0])
    x, y = a[1][: np.searchsorted(a[1], limit, "right")], b[1][: np.searchsorted(b[1], limit, "right")]
    few = min(len(x), len(y))
    return float(len(np.intersect1d(x, y, assume_unique=True)) / few) if few else 0.0


def edited(text: str, following: str) -> str:
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


COLUMNS = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compared(text: str, own: tuple, following: str, its: tuple) -> tuple:
    other = edited(text, following)
    new = sketch(other)
    return len(text), hashlib.sha256(other.encode("utf-8", "surrogatepass")).hexdigest(), packed(own), packed(new), likeness(own, new), likeness(own, its)


def neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document against its text edited with the next one's beginning, and against the next one, by ascending id.

    Rows are dealt out by ranges of the id and move once. The last row of a range meets the first one of the next range in
    a table of two rows a range."""
    spark = docs.sparkSession
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    kinds = [pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64()]
    ranged = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text")).repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "id").sortWithinPartitions("id", "text")

    def batch(ids, rows, kind):
        return pa.RecordBatch.from_arrays([pa.array([x.as_py() for x in ids], kind), *(pa.array(x, k) for x, k in zip(list(zip(*rows, strict=True)) or [()] * len(names), kinds, strict=True))], names=["id", *names])

    def inside(batches):
        held = None
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part, ids, rows = b.slice(at, 1000), [], []
                for i, text in zip(part.column(0), part.column(1).to_pylist(), strict=True):
                    own = sketch(text)
                    if held:
                        ids.append(held[0])
                        rows.append(compared(held[1], held[2], text, own))
                    held = (i, text, own)
                yield batch(ids, rows, part.schema.field(0).type)

    def across(batches):
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                rows = [compared(x, sketch(x), y, sketch(y)) for x, y in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)]
                yield batch(part.column(0), rows, part.schema.field(0).type)

    kind = docs.schema[id_col].dataType.simpleString()
    row = F.struct("id", "text")
    ends = ranged.groupBy(F.spark_partition_id().alias("part")).agg(F.min(row).alias("first"), F.max(row).alias("last"))
    after = F.coalesce(F.lead("first.text").over(Window.orderBy("part")), F.first("first.text").over(Window.orderBy("part")))  # a row for each range
    ends = ends.select(F.col("last.id").alias("id"), F.col("last.text").alias("text"), after.alias("following"))
    out = ranged.mapInArrow(inside, f"id {kind}, {COLUMNS}").unionByName(ends.mapInArrow(across, f"id {kind}, {COLUMNS}"))
    return out.withColumnRenamed("id", id_col)
