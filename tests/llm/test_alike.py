"""Texts alike, against all pairs."""

import random
from itertools import combinations

import pytest

from lexloom.llm import simhash


def words(rng, n, of=20_000):
    return [f"w{rng.randrange(of)}" for _ in range(n)]


def plain_components(texts):
    sets = [{tuple(x[i : i + 5]) for i in range(max(1, len(x) - 4))} if (x := t.split()) else set() for t in texts]
    root = list(range(len(texts)))
    for i, j in combinations(range(len(texts)), 2):
        both = len(sets[i] & sets[j])
        if root[i] != root[j] and both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
            a, b = sorted((root[i], root[j]))
            root = [a if r == b else r for r in root]
    return root


def held(spark, texts, **options):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    roots = {r["id"]: r["root"] for r in simhash.alike(docs, **options).collect()}
    assert [roots.get(i, i) for i in range(len(texts))] == plain_components(texts)
    return roots


def test_appended_cut_and_replaced_passages(spark):
    rng, texts = random.Random(1), ["", " ", "one", "One two"]
    for _ in range(60):
        own = words(rng, rng.randrange(150, 1200))
        n = len(own)
        k, at = int(n * rng.uniform(0.05, 0.25)), rng.randrange(n // 2)
        texts += map(" ".join, [own, own + words(rng, k), own[: n - k], own[:at] + words(rng, k // 2) + own[at + k // 2 :]])
    held(spark, texts)


def test_same_words_in_another_order(spark):
    """Of three texts with the same words the second and third are alike, the first is not."""
    rng, texts = random.Random(2), []
    for _ in range(40):
        lines = [words(rng, 10) for _ in range(30)]
        mixed = [rng.sample(x, len(x)) for x in lines]
        a, b = rng.sample(range(30), 2)
        swapped = list(mixed)
        swapped[a], swapped[b] = mixed[b], mixed[a]
        texts += ["\n".join(map(" ".join, x)) for x in (lines, mixed, swapped)]
    held(spark, texts)


@pytest.mark.parametrize("most", [1, 8])
def test_crowded_cells(spark, most):
    """Texts of nearly the same words, where those nearest by their words are not those that share shingles; and a large group with one beginning."""
    rng = random.Random(3)
    base, texts = words(rng, 300), []
    for _ in range(60):
        own = rng.sample(base, len(base))
        texts += [" ".join(own), " ".join([*own[:270], *words(rng, 30)])]
    start = words(rng, 120)
    texts += [" ".join(start + words(rng, rng.randrange(20, 40))) for _ in range(80)]
    held(spark, texts, most=most)


def counted(spark, monkeypatch, texts):
    """How many rows went into buckets and cells, and how many pairs were verified."""
    n = {"buckets": 0, "cells": 0, "verified": 0}
    real = {k: getattr(simhash, k) for k in n}

    def after(k):
        def run(*a):
            out = real[k](*a)
            n[k] += out.count()
            return out

        return run

    def before(p, *a):
        n["verified"] += p.count()
        return real["verified"](p, *a)

    with monkeypatch.context() as m:
        m.setattr(simhash, "buckets", after("buckets"))
        m.setattr(simhash, "cells", after("cells"))
        m.setattr(simhash, "verified", before)
        held(spark, texts)
    return n


@pytest.mark.parametrize("share", [0.5, 0.82, 0.87])
def test_one_passage_in_unlike_texts(spark, monkeypatch, share):
    """Texts of any size that have a passage in common and are not alike make no buckets, let alone pairs; but for a few that happen to have words around it in common, too."""
    for size in (50, 100, 200):
        rng = random.Random(4)
        passage, texts = words(rng, 400), []
        for _ in range(size):
            own = int(len(passage) * (1 / share - 1) * rng.uniform(1, 1.1))
            k = rng.randrange(own)
            texts.append(" ".join(words(rng, k) + passage + words(rng, own - k)))
        n = counted(spark, monkeypatch, texts)
        assert n["cells"] == 0 and n["buckets"] <= size / 10 and n["verified"] <= size / 20


def test_near_copies_at_the_threshold(spark, monkeypatch):
    """One text with one to three words changed: some are alike, most pairs are not. Work follows the texts."""
    for size in (50, 100, 200):
        rng = random.Random(5)
        base, texts = words(rng, 120), []
        for _ in range(size):
            own = list(base)
            for at in rng.sample(range(120), rng.randrange(1, 4)):
                own[at] = f"n{rng.randrange(10**9)}"
            texts.append(" ".join(own))
        n = counted(spark, monkeypatch, texts)
        assert n["buckets"] <= 12 * size and n["cells"] <= 3 * n["buckets"] and n["verified"] <= 6 * size


def test_components(spark):
    """Chains, hubs, stars, repeated edges and loops, against plain merging."""
    rng = random.Random(6)
    cases = [[], [(3, 3)], [(i + 1, i) for i in range(60)], [(i, 0) for i in range(1, 50)], [(99, i) for i in range(50)], [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] * 2, [(9, -5), (-5, 7), (2, 9)]]
    for edges in cases:
        root = {x: x for e in edges if e[0] != e[1] for x in e}
        for _ in root:
            for u, v in edges:
                if u != v:
                    root[u] = root[v] = min(root[u], root[v])
        got = simhash.components(spark.createDataFrame(edges, "u long, v long"))
        assert sorted(map(tuple, got.collect())) == sorted(root.items())
