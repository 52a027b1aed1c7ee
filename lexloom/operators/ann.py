"""What a task does with the vectors of one cell: 8-bit codes, product codes, and a navigable graph with its search.

Vectors are unit rows, so a dot product is the cosine. Everything here is arrays of one bounded cell; Spark deals the cells out (operators/index.py).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

# --- 8-bit codes ---


def coded(m: np.ndarray) -> np.ndarray:
    """Numbers of -1 to 1 as whole ones of -127 to 127."""
    return np.clip(np.rint(m * 127), -127, 127).astype(np.int8)


def decoded(codes: np.ndarray) -> np.ndarray:
    return codes.astype(np.float32) / 127


# --- product codes ---


@dataclass
class Codebooks:
    """For each of `parts` runs of a vector's numbers, at most 256 centres."""

    centres: list[np.ndarray]
    cuts: np.ndarray

    def encode(self, m: np.ndarray) -> np.ndarray:
        """A byte for each part: the nearest centre."""
        out = np.empty((len(m), len(self.centres)), np.uint8)
        for i, c in enumerate(self.centres):
            x = m[:, self.cuts[i] : self.cuts[i + 1]]
            out[:, i] = ((c * c).sum(axis=1)[None] - 2 * (x @ c.T)).argmin(axis=1)
        return out

    def tables(self, q: np.ndarray) -> np.ndarray:
        """queries x parts x 256: the dot product of each part with each centre; unused centres count as none."""
        out = np.full((len(q), len(self.centres), 256), -np.inf, np.float32)
        for i, c in enumerate(self.centres):
            out[:, i, : len(c)] = q[:, self.cuts[i] : self.cuts[i + 1]] @ c.T
        return out

    def scores(self, tables: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """queries x rows: sums of table entries."""
        out = np.zeros((len(tables), len(codes)), np.float32)
        for i in range(len(self.centres)):
            out += tables[:, i, :][:, codes[:, i]]
        return out

    def needed(self, x: np.ndarray, k: int, recall: float, queries: int = 200) -> int:
        """How many rows with the best codes hold this share of the k nearest others: measured on a sample, 1 in len / queries against all."""
        k = min(k, len(x) - 1)
        if k < 1:
            return 1
        codes, ranks = self.encode(x), []
        of = np.arange(0, len(x), max(1, len(x) // queries))
        for at in range(0, len(of), 25):
            q, own = x[of[at : at + 25]], of[at : at + 25]
            exact, rough = q @ x.T, self.scores(self.tables(q.astype(np.float32)), codes)
            for s in (exact, rough):
                s[np.arange(len(q)), own] = -np.inf
            best = np.take_along_axis(rough, np.argpartition(-exact, k - 1, axis=1)[:, :k], axis=1)
            ranks += [len(x) - np.searchsorted(np.sort(r), b, "left") for r, b in zip(rough, best, strict=True)]
        ranks = np.sort(np.concatenate(ranks))
        return int(ranks[int(np.ceil(recall * len(ranks))) - 1])

    @property
    def numbers(self) -> int:
        return int(self.cuts[-1])


def codebooks(sample: np.ndarray, parts: int, rounds: int = 10, seed: int = 7) -> Codebooks:
    """k-means of each part on a bounded sample."""
    d = sample.shape[1]
    cuts = np.linspace(0, d, min(parts, d) + 1).round().astype(int)
    rng, centres = np.random.default_rng(seed), []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        x = sample[:, a:b]
        c = x[rng.choice(len(x), min(256, len(x)), replace=False)] if len(x) else np.zeros((1, b - a))
        for _ in range(rounds if len(x) else 0):
            near = ((c * c).sum(axis=1)[None] - 2 * (x @ c.T)).argmin(axis=1)
            n = np.bincount(near, minlength=len(c))
            sums = np.stack([np.bincount(near, weights=x[:, j], minlength=len(c)) for j in range(b - a)], axis=1)
            c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
        centres.append(c)
    return Codebooks(centres, cuts)


# --- the graph ---

#: The cosine, by 8-bit codes, from which a row counts as the query itself.
LIKE = 0.99


#: How many products a step holds, about.
NUMBERS = 1 << 21


def dots(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Products of row i of a with row j of b, pair by pair; no more rows are gathered at once than make NUMBERS numbers."""
    step = max(1, NUMBERS // max(1, a.shape[1]))
    return np.concatenate([np.einsum("ij,ij->i", a[i[at : at + step]], b[j[at : at + step]]) for at in range(0, max(1, len(i)), step)])


def neighbours(m: np.ndarray, most: int, step: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """The `most` nearest others of each row, nearest first, and their cosines."""
    most = min(most, len(m) - 1)
    near, sims = np.empty((len(m), most), np.int64), np.empty((len(m), most), np.float32)
    step = max(1, min(step, NUMBERS // max(1, len(m))))
    for at in range(0, len(m), step):
        s = m[at : at + step] @ m.T
        s[np.arange(len(s)), np.arange(at, at + len(s))] = -np.inf
        top = np.argpartition(-s, most - 1, axis=1)[:, :most]
        own = np.take_along_axis(s, top, axis=1)
        order = np.argsort(-own, axis=1, kind="stable")
        near[at : at + step], sims[at : at + step] = np.take_along_axis(top, order, axis=1), np.take_along_axis(own, order, axis=1)
    return near, sims


def links(m: np.ndarray, degree: int = 10, pool: int = 40, far: int = 2, seed: int = 7, step: int = 256) -> np.ndarray:
    """A navigable graph of different unit rows: rows x (2 * degree + far) positions, -1 where there are fewer.

    Of a row's nearest `pool` those are linked that are nearer to it than to any linked before (at most `degree`), which spreads its links over
    directions; links go both ways, at most 2 * degree, the nearest kept; and `far` random ones keep the whole in reach."""
    n = len(m)
    m = m.astype(np.float32)
    if n < 2:
        return np.full((n, 1), -1, np.int64)
    near, sims = neighbours(m, pool)
    heads, tails, weight = [], [], []
    for at in range(0, n, step):
        c, s = near[at : at + step], sims[at : at + step]
        between = np.einsum("bcd,bed->bce", m[c], m[c])
        keep = np.zeros(c.shape, bool)
        for j in range(c.shape[1]):
            hidden = (keep[:, :j] & (between[:, j, :j] > s[:, j : j + 1])).any(axis=1)
            keep[:, j] = ~hidden & (keep.sum(axis=1) < degree)
        i, j = np.nonzero(keep)
        heads.append(i + at)
        tails.append(c[i, j])
        weight.append(s[i, j])
    a, b, w = np.concatenate(heads), np.concatenate(tails), np.concatenate(weight)
    a, b, w = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([w, w])
    _, first = np.unique(a * n + b, return_index=True)
    a, b, w = a[first], b[first], w[first]
    order = np.lexsort((b, -w, a))
    a, b = a[order], b[order]
    place = np.arange(len(a)) - np.searchsorted(a, a, "left")
    keep = place < 2 * degree
    out = np.full((n, 2 * degree + far), -1, np.int64)
    out[a[keep], place[keep]] = b[keep]
    if far:
        out[:, 2 * degree :] = np.random.default_rng(seed).integers(0, n, (n, far))
    return out


def entries(n: int, few: int = 4) -> np.ndarray:
    """Where a search begins: positions spread over the graph."""
    return np.unique(np.linspace(0, n - 1, min(few, n)).astype(np.int64))


def beam_search(m: np.ndarray, graph: np.ndarray, q: np.ndarray, beam: int, wide: int = 1, starts: np.ndarray | None = None, without: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each query the `beam` best rows found (query, row, score; by query, best first), and for each query how many rows were scored.

    All queries go forward together: each expands its `wide` best rows that it hasn't yet, scores the linked rows that it hasn't met, and keeps the
    best `beam`, until none of these is left to expand. without: of each query a row that it never meets, as if it weren't there.
    With wide beams fewer queries go together, so that what they hold stays under a bound."""
    n, k = len(m), len(q)
    few = max(1, (NUMBERS >> 3) // max(1, min(beam, n), wide * graph.shape[1]))
    if k > few:
        own = [(at, beam_search(m, graph, q[at : at + few], beam, wide, starts, None if without is None else without[at : at + few])) for at in range(0, k, few)]
        return tuple(np.concatenate(x) for x in zip(*((of + at, row, score, scored) for at, (of, row, score, scored) in own), strict=True))
    none = np.zeros(0, np.int64)
    if not n or not k:
        return none, none, np.zeros(0, np.float32), np.zeros(k, np.int64)
    starts = entries(n) if starts is None else starts
    met = np.zeros((k, n), bool)
    of, row = np.repeat(np.arange(k), len(starts)), np.tile(starts, k)
    if without is not None:
        met[np.arange(k), without] = True
        of, row = (x[~met[of, row]] for x in (of, row))
    met[of, row] = True
    score = dots(q, of, m, row)
    done, scored = np.zeros(len(of), bool), np.bincount(of, minlength=k)
    while True:
        order = np.lexsort((row, -score, of))
        of, row, score, done = of[order], row[order], score[order], done[order]
        keep = np.arange(len(of)) - np.searchsorted(of, of, "left") < beam
        of, row, score, done = of[keep], row[keep], score[keep], done[keep]
        left = np.flatnonzero(~done)
        if not len(left):
            return of, row, score, scored
        left = left[np.arange(len(left)) - np.searchsorted(of[left], of[left], "left") < wide]
        done[left] = True
        to = graph[row[left]]
        who = np.repeat(of[left], to.shape[1])
        to = to.ravel()
        fresh = to >= 0
        who, to = who[fresh], to[fresh]
        key = np.unique(who * n + to)
        who, to = key // n, key % n
        new = ~met[who, to]
        who, to = who[new], to[new]
        met[who, to] = True
        scored += np.bincount(who, minlength=k)
        of, row = np.concatenate([of, who]), np.concatenate([row, to])
        score = np.concatenate([score, dots(q, who, m, to)])
        done = np.concatenate([done, np.zeros(len(to), bool)])


def beam_needed(m: np.ndarray, graph: np.ndarray, k: int = 10, recall: float = 0.97, asked: int = 64, least: int = 32, held: bool = False) -> int:
    """The beam, doubled from the least, with which rows spread over the graph find this share of their k nearest: of the others, none of them met by its own search, as with a query that isn't in the graph; held: with themselves, as with one that is."""
    n = len(m)
    k, beam = min(k, n - 1), least
    if k < 1:
        return beam
    own = entries(n, asked)
    q = m[own]
    s = q @ m.T
    if not held:
        s[np.arange(len(own)), own] = -np.inf
    # a row as good as the k-th counts as well
    mark = -np.partition(-s, k - 1, axis=1)[:, k - 1]
    while beam < n:
        of, row, _, _ = beam_search(m, graph, q, beam, wide_of(beam), without=None if held else own)
        met = np.bincount(of[s[of, row] >= mark[of]], minlength=len(own))
        if np.minimum(met, k).sum() >= recall * k * len(own):
            break
        beam *= 2
    return min(beam, max(n, least))


def searched(m: np.ndarray, graph: np.ndarray, q: np.ndarray, held: int, other: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """beam_search with the beam `held`; queries that don't come upon a row like themselves search again with `other`, if it is wider."""
    of, row, score, scored = beam_search(m, graph, q, held, wide_of(held))
    like = np.zeros(len(q), bool)
    like[of[score >= LIKE]] = True
    again = np.flatnonzero(~like)
    if other > held and len(again):
        new = beam_search(m, graph, q[again], other, wide_of(other))
        scored[again] = np.maximum(scored[again], new[3])  # a wider search meets what a narrower one met
        keep = like[of]
        of, row, score = np.concatenate([of[keep], again[new[0]]]), np.concatenate([row[keep], new[1]]), np.concatenate([score[keep], new[2]])
        order = np.lexsort((row, -score, of))
        of, row, score = of[order], row[order], score[order]
    return of, row, score, scored


def wide_of(beam: int) -> int:
    """How many rows a search with this beam expands at once."""
    return max(1, beam // 16)
