"""SimHash fingerprints, linked by a binary trie joined with itself.

A pair within the error budget agrees on some of the blocks that the 64 bits are cut into. So the trie is built once for
each choice of blocks, with these bits first: there the budget is zero and both nodes of a pair are the same node, and
below it pairs of nodes are walked together, adding up the bits in which they differ. The number of blocks follows the
number of distinct fingerprints, so that these first levels stay short of a few rows each; equal fingerprints are one
node from the start, so copies never multiply. A subtree that still holds too many fingerprints for one task is split by
its next bits into pairs of subtrees. Components come from local spanning stars, joined by alternating stars.

Defined results: null and empty texts have fingerprint zero; a null id takes part but is never the smallest; repeated rows
come out as often as they go in; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import forget, per_row, released, shingle_hashes, written

BITS = 64
PAIRS = 1 << 20  # pairs of nodes walked at a time


def fingerprint(text: str | None, width: int = 4, seed: int = 42) -> int:
    """As a signed 64-bit number. Bits set in over half the shingles' hashes."""
    ones, n = np.zeros(BITS, np.int64), 0
    for got in shingle_hashes(text, width, seed):
        ones += np.unpackbits(got.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(got)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, seed: int = 42) -> DataFrame:
    return per_row(docs, [text_col], [id_col], "fp long", lambda: lambda t: (fingerprint(t, width, seed),))


def orders(n: int, budget: int) -> list[tuple[list[tuple[int, int]], int]]:
    """For each choice of blocks: the blocks as (shift, width), the chosen first, and how many bits are chosen.

    With budget + m blocks, any pair within the budget agrees on m of them. m is the least for which n fingerprints,
    spread evenly, leave at most 64 to each value of the chosen bits."""
    for m in range(1, 5):
        cuts = np.linspace(0, BITS, budget + m + 1).round().astype(int)
        blocks = [(int(a), int(b - a)) for a, b in zip(cuts, cuts[1:], strict=False)]
        if m == 4 or n <= 64 << sum(sorted(w for _, w in blocks)[:m]):
            break
    return [([*own, *(b for b in blocks if b not in own)], sum(w for _, w in own)) for own in map(list, combinations(blocks, m))]


def tries(fps: DataFrame, n: int, budget: int) -> DataFrame:
    """fp -> a row for each order of bits: cell (seed, order and chosen bits), bits (the fingerprint in that order), depth, used, side.

    fps may name its fingerprints (name), and hold those of several seeds (seed), of which only equal ones meet."""
    plan = orders(n, budget)
    fps = fps.select("fp", "name" if "name" in fps.columns else F.col("fp").alias("name"), "seed" if "seed" in fps.columns else F.lit(0).alias("seed"))

    def run(batches):
        for b in batches:
            fp, name, seed = b.column("fp").to_numpy().view(np.uint64), b.column("name"), b.column("seed").to_numpy().astype(np.uint64)
            for k, (blocks, depth) in enumerate(plan):
                bits = np.zeros_like(fp)
                for shift, w in blocks:
                    bits = (bits << np.uint64(w)) | ((fp >> np.uint64(shift)) & np.uint64((1 << w) - 1))
                cell = ((((seed * np.uint64(len(plan)) + np.uint64(k)) << np.uint64(40)) | (bits >> np.uint64(BITS - depth))) << np.uint64(1)).view(np.int64)
                same = lambda x: np.full(len(fp), x, np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(bits.view(np.int64)), name, *map(pa.array, (same(depth), same(0), same(0)))], names=["cell", "bits", "fp", "depth", "used", "side"])

    return fps.mapInArrow(released(run), "cell long, bits long, fp long, depth int, used int, side int")


STEP = 4


def split(rows: DataFrame, budget: int, limit: int) -> DataFrame:
    """Rows whose cell has more than limit rows go to the pairs of its subtrees that stay within the budget, until no cell has more.

    Even cells join side 0 with itself, odd ones side 0 with side 1."""
    done, rest = None, rows
    for _ in range(BITS // STEP + 1):
        sizes = written(rest.groupBy("cell").count().filter(F.col("count") > limit).select("cell"))
        if sizes.isEmpty():
            break
        cold, hot = rest.join(sizes, "cell", "left_anti"), rest.join(sizes, "cell", "left_semi")
        done = cold if done is None else done.unionByName(cold)
        hot = written(hot.withColumn("child", (F.call_function("shiftrightunsigned", F.col("bits"), F.lit(BITS - STEP) - F.col("depth")).bitwiseAND(2**STEP - 1)).cast("int")))
        kids = hot.select("cell", "side", "child", "used").distinct()  # at most 2 * 2**STEP for each cell
        cross = F.col("cell") % 2 != 0
        a = kids.filter("side = 0").select("cell", F.col("child").alias("ca"), "used")
        b = kids.filter((~cross) | (F.col("side") == 1)).select("cell", F.col("child").alias("cb"))
        pairs = a.join(b, "cell").withColumn("spent", F.col("used") + F.bit_count(F.col("ca").bitwiseXOR(F.col("cb")))).filter((F.col("spent") <= budget) & (cross | (F.col("ca") <= F.col("cb"))))
        odd = cross | (F.col("ca") != F.col("cb"))
        pairs = pairs.select(F.col("cell").alias("of"), (F.shiftleft(F.xxhash64("cell", "ca", "cb"), 1) + odd.cast("int")).alias("cell"), "spent", "ca", "cb", odd.alias("odd"), cross.alias("was"))
        ends = pairs.select("of", "cell", "spent", F.lit(0).alias("from"), F.col("ca").alias("child"), F.lit(0).alias("side")).unionByName(
            pairs.filter("odd").select("of", "cell", "spent", F.col("was").cast("int").alias("from"), F.col("cb").alias("child"), F.lit(1).alias("side"))
        )
        h = hot.select(F.col("cell").alias("of"), F.col("side").alias("from"), "child", "bits", "fp", (F.col("depth") + STEP).alias("depth"))
        rest = written(h.join(ends, ["of", "from", "child"]).select("cell", "bits", "fp", F.col("depth").cast("int").alias("depth"), F.col("spent").cast("int").alias("used"), F.col("side").cast("int").alias("side")))
    return rest if done is None else done.unionByName(rest)


def walk(bits: np.ndarray, cuts: np.ndarray, sides: np.ndarray, depth: int, budget: int, meet) -> None:
    """Calls meet(i, j, distances) for pairs within the budget, many at a time. bits: sorted in each cell and side; cuts: where cells start and the end."""
    ones = [None] * BITS

    def counted(d: int) -> np.ndarray:
        if ones[d] is None:
            ones[d] = np.concatenate([[0], np.cumsum((bits >> np.uint64(BITS - 1 - d)) & np.uint64(1)).astype(np.int64)])
        return ones[d]

    lo, hi = cuts[:-1], cuts[1:]
    first = np.concatenate([[0], np.cumsum(sides)])
    mid = hi - (first[hi] - first[lo])  # side 1 stands last
    alone = mid == hi
    whole = [np.stack([lo[alone], hi[alone], lo[alone], hi[alone]]), np.stack([lo[~alone], mid[~alone], mid[~alone], hi[~alone]])]
    todo = [(depth, np.concatenate([np.concatenate(whole, axis=1), np.zeros((1, len(lo)), np.int64)]))]
    while todo:
        d, f = todo.pop()
        if f.shape[1] > PAIRS:
            todo += [(d, f[:, at : at + PAIRS]) for at in range(0, f.shape[1], PAIRS)]
            continue
        a0, a1, b0, b1, used = f
        small = ((a1 - a0) * (b1 - b0) <= 16) | (d >= BITS)
        if small.any():
            a0s, na, b0s, nb = a0[small], (a1 - a0)[small], b0[small], (b1 - b0)[small]
            times = na * nb
            which = np.repeat(np.arange(len(times)), times)
            at = np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)
            i, j = a0s[which] + at // nb[which], b0s[which] + at % nb[which]
            near = (i < j) | (a0s[which] != b0s[which])
            i, j = i[near], j[near]
            apart = np.bitwise_count(bits[i] ^ bits[j])
            near = apart <= budget
            meet(i[near], j[near], apart[near])
            f = f[:, ~small]
            a0, a1, b0, b1, used = f
        if not f.shape[1]:
            continue
        c = counted(d)
        am, bm = a1 - (c[a1] - c[a0]), b1 - (c[b1] - c[b0])
        same = a0 == b0
        nxt = [np.stack([a0, am, b0, bm, used]), np.stack([am, a1, bm, b1, used]), np.stack([a0, am, bm, b1, used + 1]), np.stack([am, a1, b0, bm, used + 1])[:, ~same]]
        f = np.concatenate(nxt, axis=1)
        f = f[:, (f[0] < f[1]) & (f[2] < f[3]) & (f[4] <= budget)]
        if f.shape[1]:
            todo.append((d + 1, f))


class Stars:
    """Root labels: label[i] is the least j that i is linked to."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def __call__(self, i: np.ndarray, j: np.ndarray, apart: np.ndarray) -> None:
        label = self.label
        while len(i):
            a, b = label[i], label[j]
            keep = a != b
            if not keep.any():
                return
            i, j, a, b = i[keep], j[keep], a[keep], b[keep]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = label[label]
                if (up == label).all():
                    break
                label[:] = up

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(self.label != np.arange(len(self.label)))
        return at, self.label[at]


def links(rows: DataFrame, budget: int) -> DataFrame:
    """Of the fingerprints linked inside each cell: spanning stars (u, v)."""

    def joined(cell, bits, fp, depth, side):
        bits = bits.view(np.uint64)
        order = np.lexsort((bits, side, cell))
        cell, bits, fp, side = cell[order], bits[order], fp[order], side[order]
        cuts = np.concatenate([np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])), [len(cell)]]).astype(np.int64)
        stars = Stars(len(bits))
        walk(bits, cuts, side.astype(np.int64), int(depth.min()), budget, stars)
        i, j = stars.edges()
        return pa.RecordBatch.from_arrays([pa.array(fp[i]), pa.array(fp[j])], names=["u", "v"])

    def run(batches):
        held = None
        for b in batches:
            got = [b.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "bits", "fp", "depth", "side")]
            held = got if held is None else [np.concatenate(x) for x in zip(held, got, strict=True)]
            if len(held[0]) and held[0][0] != held[0][-1]:  # the last cell may go on in the next batch
                cut = int(np.flatnonzero(held[0] != held[0][-1])[-1]) + 1
                yield joined(*(x[:cut] for x in held))
                held = [x[cut:] for x in held]
        if held is not None and len(held[0]):
            yield joined(*held)

    return rows.repartition("cell").sortWithinPartitions("cell").select("cell", "bits", "fp", "depth", "side").mapInArrow(released(run), "u long, v long")


def are_stars(edges: DataFrame) -> bool:
    """Whether each node of the edges (u, v) is either the u of one edge or only ever a v: then the components are stars, and each v is a root."""
    ends = edges.select(F.col("u").alias("id"), F.lit(1).alias("up")).union(edges.select("v", F.lit(0)))
    return ends.groupBy("id").agg(F.sum("up").alias("ups"), F.min("up").alias("least")).filter((F.col("ups") > 1) | (F.col("ups") == 1) & (F.col("least") == 0)).isEmpty()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, root) of every node of the edges (u, v): alternating large and small stars until the edges are stars.

    The least neighbours are summed up map-side and written before edges are joined with them, so that join may split a hub like any hot
    key; a round keeps at most as many edges as there are nodes, and its tables go with it."""
    edges = written(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    for _ in range(rounds):
        if are_stars(edges):
            break
        both = edges.select("u", "v").union(edges.select(F.col("v"), F.col("u")))
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")))
        large = written(both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct())
        least2 = written(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least2, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least2.select("u", "m")).filter("u <> v")
        before, edges = edges, written(small.distinct())
        forget(before, least, large, least2)
    else:
        raise RuntimeError("components did not settle")
    out = written(edges.select(F.col("u").alias("id"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct()))
    forget(edges)
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, budget: int = 4, seed: int = 42, limit: int = 4096) -> DataFrame:
    """id, fp, component: the smallest id reachable over fingerprints that differ in at most budget bits."""
    prints = written(fingerprints(docs, id_col, text_col, width, seed))
    nodes = written(prints.groupBy("fp").agg(F.min(id_col).alias("least")))
    rows = split(tries(nodes, nodes.count(), budget), budget, limit)
    roots = components(links(rows, budget))
    inside = written(nodes.join(roots, nodes["fp"] == roots["id"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    of_root = written(inside.groupBy("root").agg(F.min("least").alias("component")))  # apart from the joins, which then may split a hot group
    named = written(inside.join(of_root, "root").select("fp", "component"))
    forget(nodes, roots, inside, of_root)
    return prints.join(named, "fp").select(id_col, "fp", "component")


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """The distinct shingles' hashes, ascending."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *shingle_hashes(text, width)]))


def parities(h: np.ndarray) -> bytes:
    """For each value of the hashes' low bits whether an odd number of them has it. Two sets differ in at least as many hashes as these bits; a power of two of them, by the set's size."""
    n = min(1 << 15, max(1 << 9, 1 << int(len(h)).bit_length()))
    return np.packbits(np.bincount((h & np.uint64(n - 1)).astype(np.int64), minlength=n) & 1).tobytes()


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """Rows of parities, cut down to so many words: what fewer low bits give."""
    return np.bitwise_xor.reduce(bits.reshape(len(bits), -1, words), axis=1)


def first_shingles(sets: DataFrame, similarity: float, common: np.ndarray) -> DataFrame:
    """token, id, n, ahead, strong: of each set the hashes that one as similar must share one of, in one order for all sets: by the count in common (hash, count), then the hash.

    ahead: how many hashes of the set stand there or behind, which bounds what it can share with a set that it first meets there. strong: whether one that is not smaller may meet it there first;
    of two as similar the smaller (either, if they are equal) is strong where they first meet, as it must share more of its hashes than the larger."""
    known = common[np.argsort(common[:, 0], kind="stable")]

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                of = part.column("h")
                ends, every = of.offsets.to_numpy(), of.values.to_numpy()
                ends, every = ends - ends[0], every[ends[0] : ends[-1]]
                place = np.minimum(np.searchsorted(known[:, 0], every), max(len(known) - 1, 0))
                weight = np.where(known[place, 0] == every, known[place, 1], 0) if len(known) else np.zeros(len(every), np.int64)
                picked, ahead, strong, sizes = [], [], [], []
                for s, e in zip(ends[:-1], ends[1:], strict=True):
                    n = int(e - s)
                    most = n - math.ceil(similarity * n - 1e-9) + 1
                    picked.append(every[s:e][np.lexsort((every[s:e], weight[s:e]))[:most]])
                    ahead.append(n - np.arange(len(picked[-1])))
                    strong.append(ahead[-1] >= math.ceil(least_shared(n, n, similarity) - 1e-9))
                    sizes.append(len(picked[-1]))
                which = pa.array(np.repeat(np.arange(part.num_rows), sizes))
                join = lambda x, kind: pa.array(np.concatenate([np.zeros(0, kind), *x]).astype(kind))
                yield pa.RecordBatch.from_arrays([join(picked, np.int64), *(part.column(c).take(which) for c in ("id", "n")), join(ahead, np.int32), join(strong, bool)], names=["token", "id", "n", "ahead", "strong"])

    return sets.select("h", "id", "n").mapInArrow(released(run), "token long, id long, n int, ahead int, strong boolean")


def least_shared(a, b, similarity: float):
    """How many hashes sets of so many share at least, if they are as similar."""
    return similarity / (1 + similarity) * (a + b)


def may_meet(a: dict, b: dict, similarity: float):
    """Whether rows of one token may be as similar, and meet there first: of numbers, arrays or columns n, ahead, strong."""
    smaller = (a["n"] <= b["n"]) & a["strong"] | (b["n"] <= a["n"]) & b["strong"]
    need = least_shared(a["n"], b["n"], similarity) - 1e-6
    return sizes_fit(a["n"], b["n"], similarity) & smaller & (a["ahead"] >= need) & (b["ahead"] >= need)


def sizes_fit(a, b, similarity: float):
    """Whether sets of so many shingles can be as similar: of numbers, arrays or columns."""
    return (a >= similarity * b - 1e-6) & (b >= similarity * a - 1e-6)


def most_apart(a, b, similarity: float):
    """In how many shingles sets of so many can differ and be as similar."""
    return (1 - similarity) / (1 + similarity) * (a + b) + 1e-6


def maybe(n: np.ndarray, ahead: np.ndarray, strong: np.ndarray, label: np.ndarray, bits: list[bytes], half: np.ndarray | None, similarity: float, most: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """Of the sets of one cell the pairs (i, j) with different labels that neither may_meet nor parities rule out; and whether pairs were put off, each i meeting its `most` nearest only.

    The sets of the largest label are held against the others, not against each other. half: only pairs with different values."""
    kinds, which, count = np.unique(label, return_inverse=True, return_counts=True)
    width = np.array([len(x) // 8 for x in bits])
    own = {}
    for w in np.unique(width):
        at = np.flatnonzero(width >= w)
        parts = [at[width[at] == v] for v in np.unique(width[at])]
        own[w] = np.concatenate([folded(np.frombuffer(b"".join(bits[i] for i in x), np.uint64).reshape(len(x), -1), w) for x in parts]), np.concatenate(parts)
    left, right, late = [], [], False
    for i in np.flatnonzero(which != count.argmax()):
        found, apart = [], []
        for w, (rows, at) in own.items():
            if w > width[i]:
                continue
            if w < width[i]:
                keep = width[at] == w  # narrower ones; the wider meet it at its own width
                rows, at = rows[keep], at[keep]
                me = folded(np.frombuffer(bits[i], np.uint64).reshape(1, -1), w)
            else:
                me = rows[at == i]
            near = (label[at] != label[i]) & may_meet({"n": n[at], "ahead": ahead[at], "strong": strong[at]}, {"n": n[i], "ahead": ahead[i], "strong": strong[i]}, similarity)
            if half is not None:
                near &= half[at] != half[i]
            rows, at = rows[near], at[near]
            far = np.bitwise_count(rows ^ me).sum(axis=1, dtype=np.int64)
            near = far <= most_apart(n[at], n[i], similarity)
            found.append(at[near])
            apart.append(far[near])
        found, apart = np.concatenate(found), np.concatenate(apart)
        if len(found) > most:
            late, found = True, found[np.lexsort((found, apart))[:most]]
        left.append(np.full(len(found), i))
        right.append(found)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right]), late


def met(rows: DataFrame, similarity: float, most: int) -> DataFrame:
    """u, v (ids, u < v) and late, of each cell of rows with id, n, ahead, strong, label, bits, half. late: rows that only say that pairs were put off."""
    cols = ["id", "n", "ahead", "strong", "label", "half", "bits"]

    def one(ids, n, ahead, strong, label, half, bits):
        half = np.array([-1 if x is None else x for x in half], np.int64)
        i, j, late = maybe(*(np.array(x, np.int64) for x in (n, ahead)), np.array(strong, bool), np.array(label, np.int64), bits, half if (half >= 0).all() else None, similarity, most)
        pairs = {(min(ids[a], ids[b]), max(ids[a], ids[b])) for a, b in zip(i.tolist(), j.tolist(), strict=True)}
        return [(u, v, False) for u, v in pairs] + ([(ids[0], ids[0], True)] if late else [])

    def run(batches):
        cell, held = None, []

        def close():
            return one(*zip(*sorted(held), strict=True)) if len(held) > 1 else []

        for b in batches:
            out = []
            for c, *row in zip(*(b.column(x).to_pylist() for x in ("cell", *cols)), strict=True):
                if c != cell:
                    out += close()
                    cell, held = c, []
                held.append(tuple(row))
            yield made(out)
        yield made(close())

    def made(out):
        u, v, late = zip(*out, strict=True) if out else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(late, pa.bool_())], names=["u", "v", "late"])

    return rows.repartition("cell").sortWithinPartitions("cell").select("cell", *cols).mapInArrow(released(run), "u long, v long, late boolean")


def cells(rows: DataFrame, limit: int) -> DataFrame:
    """rows (token, sharing: how many rows the token has) with cell and half: a bucket of at most limit rows is one cell; a larger one is cut into blocks, and each pair of blocks, of
    which only rows of different blocks meet, and each block with itself is one."""
    blocks = F.ceil(F.col("sharing") / limit)
    block = F.pmod(F.xxhash64("id"), blocks)
    rows = rows.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1)))
    return rows.withColumns({"cell": F.xxhash64("token", F.least("block", "other"), F.greatest("block", "other")), "half": F.when(F.col("block") != F.col("other"), (F.col("block") > F.col("other")).cast("int"))}).drop("block", "other")


MOST_BROADCAST = 1 << 20  # rows of a few numbers


def among(rows: DataFrame, ids: DataFrame, anti: bool = False) -> DataFrame:
    """The rows whose id is one of ids (written), or is not. Up to MOST_BROADCAST ids are broadcast, so that the rows stay where they are; beyond, both sides sort."""
    side = F.broadcast(ids) if ids.count() <= MOST_BROADCAST else ids.hint("merge")
    return rows.join(side, "id", "left_anti" if anti else "left_semi")


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Of the pairs (u, v) those whose sets are as similar: ruled out by parities first, then counted exactly. Only sets that stand in a pair move."""
    end = lambda df, c: written(df.select(F.explode(F.array("u", "v")).alias("id")).distinct())
    half = lambda df, c, x: df.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col(x).alias(f"{x}{c}"))

    def possible(batches):
        for b in batches:
            nu, nv = (b.column(c).to_numpy().astype(np.int64) for c in ("nu", "nv"))
            far = np.zeros(len(nu), np.int64)
            for i, (x, y) in enumerate(zip(b.column("bitsu").to_pylist(), b.column("bitsv").to_pylist(), strict=True)):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                few = min(len(x), len(y))
                far[i] = np.bitwise_count(folded(x[None], few) ^ folded(y[None], few)).sum()
            keep = sizes_fit(nu, nv, similarity) & (far <= most_apart(nu, nv, similarity))
            yield pa.RecordBatch.from_arrays([b.column("u"), b.column("v")], names=["u", "v"]).filter(pa.array(keep))

    ids = end(pairs, "id")
    own = among(sets.select("id", "n", "bits"), ids)
    left = pairs.join(half(own, "u", "bits").hint("merge"), "u").join(half(own, "v", "bits").hint("merge"), "v")
    left = written(left.select("u", "v", "nu", "nv", "bitsu", "bitsv").mapInArrow(released(possible), "u long, v long").distinct())
    forget(ids)
    ids = end(left, "id")
    own = among(sets.select("id", "n", "h"), ids)
    both = F.size(F.array_intersect("hu", "hv"))
    out = written(left.join(half(own, "u", "h").hint("merge"), "u").join(half(own, "v", "h").hint("merge"), "v").filter(both >= similarity * (F.col("nu") + F.col("nv") - both)).select("u", "v").distinct())
    forget(ids, left)
    return out


def buckets(first: DataFrame) -> DataFrame:
    """Rows of first_shingles in buckets (token, sharing: its rows) in which a pair may meet: of two rows or more, one of them strong.

    Of buckets with the same ids one stays: texts that share a passage share all its shingles. Its rows have what the most of these buckets allows. Buckets are told apart by
    the number of their ids and two sums of hashes, 128 bits, made where the rows are, as the counts are: no token's rows meet in one task for it."""
    first = written(first)
    sums = [F.count("*").alias("sharing"), F.max("strong").alias("any"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64(F.lit(7), "id")).alias("y")]
    marks = written(first.groupBy("token").agg(*sums).filter("sharing > 1 AND any").drop("any"))
    one = written(marks.groupBy("sharing", "x", "y").agg(F.min("token").alias("one")))
    names = written(marks.join(one, ["sharing", "x", "y"]).select("token", "one", "sharing"))
    out = first.join(names, "token").groupBy(F.col("one").alias("token"), "sharing", "id", "n").agg(F.max("ahead").alias("ahead"), F.max("strong").alias("strong"))
    out = written(out)
    forget(first, marks, one, names)
    return out


FEW = 8  # sets of a bucket that all meet at once


def equal_texts(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """docs (id, text) without repeated texts; the others (id, least): ids whose texts all went, and the least id with the same text; and such pairs of ids
    that have several texts, which stay nodes. Texts move only where a row is there twice."""
    marks = {"t1": F.xxhash64("text"), "t2": F.xxhash64(F.lit(7), "text")}
    prints = written(docs.withColumns(marks).select("id", *marks))
    same = written(prints.groupBy("t1", "t2").agg(F.min("id").alias("least"), F.count("*").alias("rows")).filter("rows > 1").drop("rows"))
    found = written(prints.join(same, ["t1", "t2"]))
    copies = written(found.filter("id <> least").distinct())
    if not found.filter("id = least").groupBy("id", "t1", "t2").count().filter("count > 1").isEmpty():
        docs = docs.dropDuplicates(["id", "text"])
    if copies.isEmpty():
        return docs, copies.select("id", "least"), copies.select("id", "least")
    rows = docs.withColumns(marks)
    side = copies.select("id", *marks)
    kept = rows.join(F.broadcast(side) if side.count() <= MOST_BROADCAST else side.hint("merge"), ["id", *marks], "left_anti").select("id", "text")
    ids = copies.select("id", "least")
    several = written(prints.join(ids.select("id").distinct(), "id", "left_semi").distinct().groupBy("id").count().filter("count > 1").select("id"))
    linked, ids = written(ids.join(several, "id", "left_semi")), written(ids.join(several, "id", "left_anti"))
    forget(same, found, several)
    return kept, ids, linked


def alike_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8, known: DataFrame | None = None, common: int = 1 << 20, share: int = 8, most: int = 6, limit: int = 4096) -> tuple[DataFrame, DataFrame]:
    """(id, root) of the ids that hang together over the known links (u, v) and all pairs of texts that share at least `similarity` of their distinct shingles; and (id, least) of those whose text is that of a lesser id, which are not in the former.

    Exact: two such sets share one of their first shingles, whatever the order; the counts in one of `share` sets only put common ones last (`common` of them at most), and where they first meet the smaller
    is strong (first_shingles). Texts that share a passage and little else are strong in none of its shingles, so it makes no bucket. The sets of a
    bucket (a shared first shingle) all meet if they are few, else each meets the first of one of its buckets. Then, in large buckets, sets of different
    components meet, those that sizes, places and parities do not rule out: `most` for each set, then four times as many, until none was put
    off. Only pairs inside a component are never compared, as they change nothing. An exact count decides."""
    kind = docs.schema[id_col].dataType.typeName()
    if kind not in ("byte", "short", "integer", "long"):
        raise ValueError(f"ids must be whole numbers, not {kind}")
    docs = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    docs, copies, linked = equal_texts(docs)
    name = lambda h: xxhash.xxh3_128_digest(h.tobytes())

    def measured(text):
        h = shingle_set(text, width)
        return name(h), len(h), h.view(np.int64), parities(h)

    sets = written(per_row(docs, ["text"], ["id"], "key binary, n int, h array<long>, bits binary", lambda: measured))
    # other texts with the same shingles (other blanks, other case; texts without words)
    same = sets.groupBy("key").agg(F.min("id").alias("least"), F.count("*").alias("rows")).filter("rows > 1").select("key", "least")
    twins = written(sets.select("key", "id").join(written(same), "key").filter("id <> least").select("id", "least").distinct())
    links = twins.union(linked).select(F.col("id").alias("u"), F.col("least").alias("v"))
    if known is not None:
        links = links.union(known.select(F.col("u").alias("id"), "v").join(copies.select("id"), "id", "left_anti").filter("id <> v").select("id", "v"))
    links = written(links)
    worded = sets.filter("n > 0")
    worded = worded if twins.isEmpty() else among(worded, twins.select("id"), anti=True)
    some = sets.filter(F.pmod(F.xxhash64("key"), F.lit(share)) == 0)
    often = some.select(F.explode("h").alias("t")).groupBy("t").count().filter("count > 1").orderBy(F.desc("count"), "t").limit(common).toArrow()  # at most `common` pairs of numbers
    live = buckets(first_shingles(worded, similarity, np.stack([often.column(c).to_numpy() for c in ("t", "count")], axis=1)))
    fit = lambda a, b: (a["id"] < b["id"]) & may_meet(a, b, similarity)
    row = F.struct("id", "n", "ahead", "strong")
    few = live.filter(F.col("sharing") <= FEW).groupBy("token").agg(F.collect_list(row).alias("m"))
    few = few.select(F.explode(F.flatten(F.transform("m", lambda a: F.transform(F.filter("m", lambda b: fit(a, b)), lambda b: F.struct(a["id"].alias("u"), b["id"].alias("v")))))).alias("p")).select("p.*")
    large = live.filter(F.col("sharing") > FEW)
    # each meets one at first, the least id that leads one of its buckets: a pair for each set
    first = written(large.groupBy("token").agg(F.min(F.struct("id", "n")).alias("first")))
    led = large.join(first, "token").filter(sizes_fit(F.col("first.n"), F.col("n"), similarity) & (F.col("first.id") < F.col("id")))
    led = led.groupBy(F.col("id").alias("v")).agg(F.min("first.id").alias("u")).select("u", "v")
    done = written(few.unionByName(led).distinct())
    links = links.unionByName(verified(done, sets, similarity))
    label = components(links)
    forget(first)
    while True:
        labelled = written(large.join(label.withColumnRenamed("root", "label"), "id", "left").withColumn("label", F.coalesce("label", "id")))
        mixed = written(labelled.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi").select("token"))
        rows = written(labelled.join(mixed, "token"))
        forget(mixed, labelled)
        if rows.isEmpty():
            break
        ids = written(rows.select("id").distinct())
        found = written(met(cells(rows.join(among(sets.select("id", "bits"), ids).dropDuplicates(["id"]).hint("merge"), "id"), limit), similarity, most).distinct())
        pairs = written(found.filter(~F.col("late")).select("u", "v").join(done, ["u", "v"], "left_anti"))
        new = verified(pairs, sets, similarity)
        over, any_new = found.filter("late").isEmpty(), not new.isEmpty()
        forget(ids, found)
        if any_new:
            links = links.unionByName(new)
            forget(label)
            label = components(links)
        if over:
            break
        done, large, most = done.unionByName(pairs), rows.drop("label"), most * 4
    forget(sets)
    return label, copies


def alike(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """id, root of every document that has another one as similar (alike_groups)."""
    label, copies = alike_groups(docs, id_col, text_col, **options)
    return with_copies(label, copies)


def with_copies(label: DataFrame, copies: DataFrame) -> DataFrame:
    """Copies join the group of the least id with their text, which is one by itself if it has no other."""
    roots = label.withColumnRenamed("id", "least")
    own = written(copies.join(roots, "least", "left").select("id", F.coalesce("root", "least").alias("root"), "least"))
    alone = own.filter("root = least").select(F.col("least").alias("id"), "root").distinct().join(label, "id", "left_anti").select("id", "root")
    return label.unionByName(own.select("id", "root")).unionByName(alone)


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """id, component of every document that has a near-duplicate: its fingerprint linked (near_duplicates), or its text alike."""
    linked = near_duplicates(docs, id_col, text_col).filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("u"), F.col("component").cast("long").alias("v"))
    return alike(docs, id_col, text_col, known=written(linked), **options).select("id", F.col("root").alias("component"))
