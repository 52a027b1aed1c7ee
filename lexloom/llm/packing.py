"""Best-fit packing of tokenised documents into sequences.

Lengths are whole numbers up to the capacity, so the packing is decided on their histogram, never on documents: the plan
holds groups of equal bins, its size depends on the capacity and not on the rows. Items over a third of the capacity stand
at most two to a bin and are matched greedily, the longest with the longest that still fits beside it; the others, longest
first, go to the fullest bin that has room. Each piece then finds its place from its length and its rank among the pieces
of that length, which comes from counts by partition, so no key gathers in a task.

Defined results: a null text is empty and gives the closing id alone; a null id is kept as it is; equal rows are packed each on
their own; an empty table gives an empty table; a document longer than the capacity is cut into pieces of full capacity
and a first piece that holds the remainder.
"""

from __future__ import annotations

import base64
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.llm.common import written

CAPACITY = 2048
STRETCH = 1 << 16  # code points encoded at a time
GAP = re.compile(r"(?<=[0-9A-Za-z.,;])(?= [0-9A-Za-z])")


def stretches(text: str) -> Iterator[str]:
    """Cuts a long text where the byte-level pattern ends a word in any case: before one space between ASCII word marks."""
    at = 0
    while len(text) - at > STRETCH:
        cut = GAP.search(text, at + STRETCH)
        if not cut:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


@lru_cache(maxsize=1)
def byte_bpe(ranks_path: str, pattern: str) -> Callable[[str], np.ndarray]:
    """Text -> ids by a byte-level vocabulary of (base64 bytes, rank) lines. Made once a worker: it holds a pattern for each thread it may meet."""
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    coder = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return lambda text: np.concatenate([coder.encode_to_numpy(x) if x else np.zeros(0, np.uint32) for x in stretches(text)])


def cut(docs: DataFrame, encoder: Callable[[], Callable[[str], np.ndarray]], id_col: str, text_col: str, capacity: int, closing: int) -> DataFrame:
    """Pieces, with the task that made them (part) and their number among its pieces of that length (nth)."""

    def run(batches):
        from pyspark import TaskContext

        encode, part = encoder(), TaskContext.get().partitionId()
        met = np.zeros(capacity + 1, np.int64)
        for b in batches:
            for s in range(0, b.num_rows, 1000):
                x = b.slice(s, 1000)
                out: list[tuple] = []
                for doc, text in zip(x.column(0), x.column(1).to_pylist(), strict=True):
                    ids = np.append(encode(text or ""), np.uint32(closing)).astype("<u4")
                    start, piece = 0, 0
                    while start < len(ids):
                        length = (len(ids) - start) % capacity or capacity
                        out.append((doc, piece, start, length, zlib.crc32(ids[start : start + length].tobytes()), part, int(met[length])))
                        met[length] += 1
                        start, piece = start + length, piece + 1
                cols = list(zip(*out, strict=True)) or [()] * 7
                yield pa.RecordBatch.from_arrays([pa.array([v.as_py() for v in cols[0]], x.column(0).type), *(pa.array(c, k) for c, k in zip(cols[1:], (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True))], names=[id_col, "piece", "start", "length", "ids_crc32", "part", "nth"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long, part int, nth long")


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Histogram of lengths -> rows (length, from this rank, bins, first bin's number, offset in the bin)."""
    left, groups = {k: v for k, v in counts.items() if v}, []  # groups: [bins, free, items]

    def take(length: int, n: int) -> None:
        left[length] -= n
        if not left[length]:
            del left[length]

    large = sorted(k for k in left if 3 * k > capacity)
    while large:
        a = large[-1]
        at = bisect_left(large, capacity - a + 1) - 1
        b = large[at] if at >= 0 else None
        if b is None:
            n, items = left[a], (a,)
        elif a == b:
            n, items = left[a] // 2, (a, a)
            if not n:  # a single one is left
                at -= 1
                b = large[at] if at >= 0 else None
                n, items = (min(1, left[b]), (a, b)) if b is not None else (1, (a,))
        else:
            n, items = min(left[a], left[b]), (a, b)
        for x in items:
            take(x, n)
        large = [x for x in large if x in left]
        groups.append([n, capacity - sum(items), items])
    by_free: dict[int, list] = {}
    for g in groups:
        by_free.setdefault(g[1], []).append(g)
    frees = sorted(by_free)

    def put(g: list) -> None:
        if g[1] not in by_free:
            by_free[g[1]] = []
            insort(frees, g[1])
        by_free[g[1]].append(g)

    for x in sorted(left, reverse=True):
        n = left[x]
        while n:
            at = bisect_left(frees, x)
            if at == len(frees):  # new bins, as many of this length in each as fit
                each = min(capacity // x, n)
                bins = n // each
                put([bins, capacity - each * x, (x,) * each])
                n -= bins * each
                continue
            free = frees[at]
            g = by_free[free].pop()
            if not by_free[free]:
                del by_free[free]
                frees.pop(at)
            each = min(free // x, n)  # the same bin stays the fullest with room until x no longer fits
            bins = min(g[0], n // each)
            if bins < g[0]:
                put([g[0] - bins, free, g[2]])
            put([bins, free - each * x, g[2] + (x,) * each])
            n -= bins * each
    rows, rank, first = [], {}, 0
    for free in frees:
        for bins, _, items in by_free[free]:
            offset = 0
            for x in items:
                rows.append((x, rank.get(x, 0), bins, first, offset))
                rank[x] = rank.get(x, 0) + bins
                offset += x
            first += bins
    return rows


def best_fit(docs: DataFrame, encoder: Callable[[], Callable[[str], np.ndarray]], id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, closing: int = 0) -> DataFrame:
    """A row for each piece: id, piece, start, length, ids_crc32, sequence_id, offset. encoder: makes the coder, once a task."""
    spark = docs.sparkSession
    pieces = written(cut(docs, encoder, id_col, text_col, capacity, closing))
    parts = written(pieces.groupBy("length", "part").agg(F.count("*").alias("n")))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = written(parts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")))  # a row for each length and task: never broadcast, as it grows with the tasks
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    steps = np.array(sorted(plan(counts, capacity)), np.int64).reshape(-1, 5)
    cuts = np.searchsorted(steps[:, 0], np.arange(capacity + 2))
    shared = spark.sparkContext.broadcast((steps, cuts))  # its size follows the capacity's histogram, not the rows

    def place(batches):
        steps, cuts = shared.value
        key = steps[:, 0] * (1 << 40) + steps[:, 1]
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            at = np.searchsorted(key, length * (1 << 40) + rank, side="right") - 1
            seq, offset = steps[at, 3] + rank - steps[at, 1], steps[at, 4]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(seq), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    names = [id_col, "piece", "start", "length", "ids_crc32"]
    ranked = pieces.join(base.hint("merge"), ["length", "part"]).select(*names, (F.col("base") + F.col("nth")).alias("rank"))
    return ranked.mapInArrow(place, ", ".join([*(f"`{c}` {ranked.schema[c].dataType.simpleString()}" for c in names), "sequence_id long, offset long"]))
