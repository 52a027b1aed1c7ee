"""The learned operators, the licence scan and the pipeline's stages against plain versions; the queries as they are registered."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from itertools import combinations

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from lexloom.llm import bpe, common, langid, licenses, quality, rules, simhash, toxicity
from lexloom.llm.queries import QUERIES, SQL, byte_coder
from tests.llm.test_operators import plain_components, plain_fingerprint, plain_line_dedup, plain_statistics


def prose(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


ALPHA = ["ka", "lo", "mi", "tu", "re", "so", "pe", "za", "fu", "ne", "vi", "do"]


def spoken(rng, n):
    return " ".join(rng.choice(ALPHA) for _ in range(n))


# --- 1 licence scan ---


def plain_units(text):
    low = text.lower()
    lines = low.split("\n")
    yield from (licenses.WORD.findall(x) for x in lines)
    for x in lines:
        yield from map(licenses.WORD.findall, re.split(r"(?<=[.!?;])\s+", x))
    block = []
    for x in [*lines, ""]:
        block = block + licenses.WORD.findall(x)
        if not x.strip():
            yield block
            block = []
    yield licenses.WORD.findall(low)


def plain_cosine(words, template, idf, rarest):
    weigh = lambda ws: {t: (1 + math.log(k)) * idf.get(t, rarest) for t, k in Counter([*ws, *map(" ".join, zip(ws, ws[1:], strict=False))]).items()}
    a, b = weigh(words), weigh(template)
    norm = math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values()))
    return sum(x * b[t] for t, x in a.items() if t in b) / norm if norm else 0.0


@pytest.mark.parametrize("seed", range(4))
def test_licence_scan_drops_nothing(seed):
    """Without key words, every unit against every template: what reaches the threshold is found, with its score."""
    rng = random.Random(seed)
    df = {t: rng.choice([0, 3, 50, 4000]) for t in sorted(licenses.TERMS)}
    scan = licenses.Scanner(df, 5000, 0.6, margin=0.0)
    idf, rarest = {t: math.log(5001 / (1 + df[t])) + 1 for t in licenses.TERMS}, math.log(5001) + 1
    said = [(n, licenses.WORD.findall(x.lower())) for n, xs in licenses.TEMPLATES.items() for x in xs]
    reached = 0
    for _ in range(60):
        parts = []
        for _ in range(rng.randrange(1, 6)):
            words = rng.choice(said)[1]
            a = rng.randrange(max(1, len(words) // 2))
            parts.append(rng.choice(["", prose(rng, 3) + " ", prose(rng, 9) + ". "]) + " ".join(words[a : a + rng.randrange(1, len(words) + 1)]) + rng.choice(["", ".", "; " + prose(rng, 4)]))
        text = "".join(x + rng.choice(["\n", "\n\n", " "]) for x in parts)
        best = max(plain_cosine(u, t, idf, rarest) for u in plain_units(text) for _, t in said)
        name, score, _, _ = scan(text)
        if best >= 0.6 + 1e-6:
            reached += 1
            assert name is not None and score >= best - 1e-6
    assert reached > 20


def test_long_texts_are_weighed_alike(monkeypatch):
    rng = random.Random(5)
    scan = licenses.Scanner({"the": 900, "license": 7}, 1000, 0.6)
    words = licenses.WORD.findall((prose(rng, 300) + " " + licenses.TEMPLATES["MIT"][2] * 2).lower())
    want = scan.vector(words)
    monkeypatch.setattr(licenses, "MANY", 10)
    got = scan.vector(words)
    assert got.keys() == want.keys() and all(got[t] == pytest.approx(want[t], abs=1e-12) for t in want)
    assert scan("\n".join([licenses.TEMPLATES["MIT"][2]] * 25))[3] and not scan(prose(rng, 400) + "\n" + licenses.TEMPLATES["MIT"][0])[3]


def test_families_of_licences():
    scan = licenses.Scanner({}, 10_000, 0.6)
    for name, texts in licenses.TEMPLATES.items():
        for t in texts:
            got = scan(f"Copyright 2020 someone.\n{t}\n")
            assert got[0] == name or got[0] in ("MIT", "BSD-2-Clause", "BSD-3-Clause") and got[1] == 1.0
    assert scan("This library is under the GNU Lesser General Public License, version 2.1")[0] == "LGPL-2.1"
    assert scan("licensed under the GNU Affero General Public License, version 3")[0] == "AGPL-3.0"


# --- 2 toxicity ---


def plain_fit(texts, of_all, rounds, least=1, rate=0.3, penalty=2e-4):
    bags = [[{x for w in set(toxicity.WORD.findall(s.lower())) for x in toxicity.marks(w)} for s in toxicity.SENTENCE.findall(t)] for t, _ in texts]
    df = Counter(x for bag in bags for x in set().union(*bag))
    names = sorted(x for x, k in df.items() if k >= least)
    y = [v for _, v in texts]
    share, mean = of_all[1] / sum(of_all.values()), sum(y) / len(y)
    n = sum(map(len, bags))
    w, b, gw, gb = dict.fromkeys(names, 0.0), -math.log(max(2.0, n / len(y)) * 2), dict.fromkeys(names, 1e-8), 1e-8
    for _ in range(rounds):
        dw, db = dict.fromkeys(names, 0.0), 0.0
        for bag, v in zip(bags, y, strict=True):
            p = [1 / (1 + math.exp(-b - sum(w.get(x, 0.0) for x in s))) for s in bag]
            q = math.prod(1 - x for x in p)  # no sentence is toxic
            weight = (share / mean if v else (1 - share) / (1 - mean)) / len(y)
            for s, x in zip(bag, p, strict=True):
                d = weight * x * (-q / (1 - q) if v else 1.0)  # of the negative log likelihood by the sentence's logit
                db += d
                for f in s:
                    if f in dw:
                        dw[f] += d
        for f in names:
            gw[f] += dw[f] ** 2
            step = rate / math.sqrt(gw[f])
            z = w[f] - step * dw[f]
            w[f] = math.copysign(max(abs(z) - step * penalty, 0.0), z)
        gb += db**2
        b -= rate / math.sqrt(gb) * db
    return {f: x for f, x in w.items() if abs(x) > 1e-3}, b


def test_noisy_or_fit():
    rng = random.Random(6)
    texts = [(". ".join(spoken(rng, 4) for _ in range(3)) + (". scum" if i % 3 == 0 else ""), int(i % 3 == 0)) for i in range(24)]
    got, bias = toxicity.fit(texts, {0: 160, 1: 40}, least_docs=1, rounds=6)
    want, plain_bias = plain_fit(texts, {0: 160, 1: 40}, 6)
    assert bias == pytest.approx(plain_bias) and got.keys() == want.keys() and all(got[f] == pytest.approx(want[f], abs=1e-9) for f in want)


def test_scores_are_those_of_the_worst_passage():
    rng = random.Random(7)
    w = {toxicity.marks(x)[0]: rng.uniform(-1, 3) for x in ALPHA[:8]}
    for bias in (-1.0, -4.0, -8.0):
        score, most = toxicity.scorer(w, bias), toxicity.passage(math.log1p(math.exp(bias)))
        for n in (1, 3, 20, 300):
            sentences = [spoken(rng, 2) for _ in range(n)]
            z = [bias + sum(toxicity.Weights(w)[x] for x in set(toxicity.WORD.findall(s))) for s in sentences]
            p = [1 / (1 + math.exp(-x)) for x in z]
            want = max(1 - math.prod(1 - x for x in p[i : i + most]) for i in range(max(1, n - most + 1)))
            assert score(". ".join(sentences))[0] == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize("each, most", [(30, 10**9), (30, 900), (1000, 10**9)])
def test_bounded_sample(spark, each, most):
    rows = spark.range(1000).selectExpr("id AS of", "IF(id % 10 = 0, 1, 0) AS y", "10 AS chars").withColumn("place", common.place("of"))
    got, there = common.bounded_sample(rows, "y", each, "chars", most)
    got, every = got.toPandas(), rows.toPandas()
    assert there == {0: 900, 1: 100}
    for y, own in every.groupby("y"):
        kept = got[got.y == y]
        first = own.sort_values("place").head(len(kept))
        assert set(kept.of) == set(first.of) and len(kept) <= each
        assert len(kept) == min(each, len(own)) or len(kept) >= 0.85 * each or kept.chars.sum() >= most


# --- 3 language ---


def test_ftrl_and_vectors():
    rng = np.random.default_rng(8)
    idf = np.log(2 + rng.random(langid.FEATURES))
    texts = ["kalo mira tosu", "strn grzk", "mira mira", "pwlm strn strn", "tosu"]
    for t in texts:
        n = langid.counts(t)
        plain = np.sqrt(n) * idf
        at, x = langid.vector(t, idf)
        assert (at == np.flatnonzero(n)).all() and np.allclose(x, (plain / np.linalg.norm(plain))[at], atol=1e-6)
    x, y = [langid.vector(t, idf) for t in texts], np.array([0, 1, 0, 1, 0])
    got = langid.ftrl(x, y, 2, epochs=2)
    z, n, order = np.zeros((langid.FEATURES + 1, 2)), np.zeros((langid.FEATURES + 1, 2)), np.random.default_rng(7)
    w = lambda i, k: 0.0 if abs(z[i, k]) <= 1e-3 else (math.copysign(1e-3, z[i, k]) - z[i, k]) / (1 + math.sqrt(n[i, k]) + 1e-3)
    for _ in range(2):
        for i in order.permutation(5):
            own = [*zip(x[i][0].astype(int).tolist(), x[i][1].astype(float).tolist(), strict=True), (langid.FEATURES, 1.0)]
            e = np.exp([sum(v * w(f, k) for f, v in own) for k in range(2)])
            p = e / e.sum() - (np.arange(2) == y[i])
            old = {(f, k): w(f, k) for f, _ in own for k in range(2)}
            for f, v in own:
                for k in range(2):
                    g = v * p[k]
                    z[f, k] += g - (math.sqrt(n[f, k] + g * g) - math.sqrt(n[f, k])) * old[f, k]
                    n[f, k] += g * g
    want = np.array([[w(i, k) for k in range(2)] for i in np.flatnonzero(n.sum(axis=1))])
    assert np.allclose(got[np.flatnonzero(n.sum(axis=1))], want, atol=1e-9) and np.count_nonzero(got) == np.count_nonzero(want)


def test_temperature():
    rng = np.random.default_rng(9)
    z = rng.normal(size=(400, 3)) * 4
    y = np.array([rng.choice(3, p=np.exp(r / 2.5) / np.exp(r / 2.5).sum()) for r in z])
    loss = lambda t: -np.mean([r[k] / t - math.log(np.exp(r / t).sum()) for r, k in zip(z, y, strict=True)])
    grid = np.exp(np.linspace(-2, 2, 400))
    assert langid.temperature(z, y) == pytest.approx(grid[np.argmin([loss(t) for t in grid])], rel=0.02)


def test_language_learns_from_long_texts(spark):
    rng = random.Random(10)
    rows = [(i, " ".join(rng.choices(["kalo", "mira"] if i % 2 else ["strn", "grzk"], k=8000 if i < 6 else 5)), "ab"[i % 2]) for i in range(40)]
    model = langid.trained(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.col("doc_id") < 6)
    assert all(model.predict(t)[0] == k for _, t, k in rows)


# --- 10 quality ---


def plain_boost(x, y, trees, depth, bins, rate, shrink, least):
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    z = np.full(len(y), math.log(y.mean() / (1 - y.mean())))

    def grow(rows, d):
        g, h = y[rows] - p[rows], (p * (1 - p))[rows]
        if d == depth:
            z[rows] += rate * g.sum() / (h.sum() + shrink)
            return
        best, cut = 1e-6, None
        for j in range(x.shape[1]):
            for c in cuts[j]:
                left = x[rows, j] <= c
                if left.sum() >= least and (~left).sum() >= least:
                    gain = g[left].sum() ** 2 / (h[left].sum() + shrink) + g[~left].sum() ** 2 / (h[~left].sum() + shrink) - g.sum() ** 2 / (h.sum() + shrink)
                    if gain > best + 1e-12:
                        best, cut = gain, (j, c)
        left = x[rows, cut[0]] <= cut[1] if cut else np.ones(len(rows), bool)
        for own in (rows[left], rows[~left]):
            if len(own):
                grow(own, d + 1)

    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        grow(np.arange(len(y)), 0)
    return z


def test_boosting_against_exhaustive_splits():
    rng = np.random.default_rng(14)
    x = np.round(rng.normal(size=(150, 3)), 2)
    y = ((x[:, 0] + 0.3 * rng.normal(size=150) > 0) ^ (x[:, 2] > 1)).astype(float)
    got = quality.boost(x, y, trees=4, depth=2, bins=16, least=5).logits(x)
    assert np.allclose(got, plain_boost(x, y, 4, 2, 16, 0.15, 1.0, 5), atol=1e-9)


def test_quality_statistics():
    text = "Ab ab, 12 | x\n\nAb ab, 12 | x\nthe end."
    n, chars, symbols, dup, repeats, lines = plain_statistics(text)
    got = dict(zip(quality.NAMES, quality.features(text), strict=True))
    assert got["words"] == n == 12 and got["chars"] == len(text) and got["mean_word"] == chars / n and got["symbols"] == symbols / n and got["repeats"] == repeats / n and got["dup_lines"] == dup / lines
    assert got["distinct"] == 7 / 12 and got["top_word"] == 2 / 12 and got["upper"] == 2 / len(text) and got["digits"] == 4 / len(text) and got["spaced_marks"] == 2 / 12 and got["ended"] == 1 / 3
    assert quality.features(None) == quality.features("") == (0.0,) * 16


# --- near duplicates ---


def test_copies_and_rows_with_several_texts(spark):
    """Exact copies, other blanks and case, an id with two texts, null ids and texts: what all pairs would give."""
    rng = random.Random(15)
    a, b, c = (prose(rng, 120, 10**6) for _ in range(3))
    rows = [(5, a), (3, a), (9, a), (7, a.upper()), (8, b), (8, c), (11, b), (12, c), (13, None), (14, ""), (None, a), (20, prose(rng, 90, 10**6)), (20, prose(rng, 90, 10**6)), (11, b), (11, b)]
    got = {r["id"]: r["root"] for r in simhash.alike(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {3: 3, 5: 3, 9: 3, 7: 3, 8: 8, 11: 8, 12: 8, 13: 13, 14: 13}
    with pytest.raises(ValueError):
        simhash.alike(spark.createDataFrame([("a", "b")], "doc_id string, text string"))
    assert simhash.alike(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("limit", [4096, 16])
def test_a_large_group_of_near_copies(spark, monkeypatch, limit):
    """All are found, at a number of checked pairs in proportion to the group."""
    pairs, real = [], simhash.verified

    def counted(p, *rest):
        pairs.append(p.count())
        return real(p, *rest)

    monkeypatch.setattr(simhash, "verified", counted)
    checked = []
    for n in (60, 120, 240):
        rng = random.Random(16)
        base = prose(rng, 300, 10**6).split()
        texts = []
        for _ in range(n):
            own, at = list(base), rng.randrange(280)
            own[at : at + 12] = prose(rng, 12, 10**6).split()
            texts.append(" ".join(own))
        pairs.clear()
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        assert {r["root"] for r in simhash.alike(df, limit=limit).collect()} == {0} and simhash.alike(df, limit=limit).count() == n
        checked.append(sum(pairs) / 2)
    assert checked[1] < 3 * checked[0] and checked[2] < 3 * checked[1]


# --- the pipeline ---


def corpus(rng):
    """Clean prose on three hosts with copies, near copies, repeated passages, toxic and poor documents, odd rows."""
    texts = [prose(rng, rng.randrange(80, 300), 3000) for _ in range(40)]
    passage = prose(rng, 60, 3000)
    texts[4] += "\n" + passage
    texts[9] += "\n" + passage
    texts += [texts[1], " ".join(texts[2].split()[:-5]), texts[3] + " " + prose(rng, 8), "# " * 90, prose(rng, 5), None, "", "\n".join(texts[6].split(" ", 60))]
    texts += [prose(rng, 90, 3000) + ". scum scum. " + prose(rng, 20, 3000) for _ in range(14)]
    return [(i * 3 + 1, t, "en", f"s{i % 3}" if i % 7 else None, len(t) if t is not None else None) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    top, rows = tmp_path_factory.mktemp("sf"), corpus(random.Random(17))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(top / "documents.parquet"))
    spark.createDataFrame([(r[0], int(bool(r[1]) and "# #" not in r[1]), int("scum" in (r[1] or ""))) for r in rows], "doc_id long, quality int, toxic int").write.parquet(str(top / "labels.parquet"))
    return str(top), rows


def test_stages_against_plain_versions(spark, folder):
    top, rows = folder
    docs = common.table(spark, top, "documents")
    stage = lambda k, df: common.written(pipeline.STAGES[k][1](spark, df, top))
    of = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}
    # quality rules
    stats, hosts = {}, {}
    for i, t, _, host, _ in rows:
        n, chars, symbols, dup, repeats, lines = plain_statistics(t or "")
        bad = n < 50 or 100 * repeats > 50 * n or 10 * symbols > 3 * n or 2 * dup > lines or chars > 20 * n or chars < 2 * n
        stats[i] = bad, host
        hosts.setdefault(host, []).append(bad)
    p = [sum(v) / len(v) for v in hosts.values()]
    m = min(max(sum(p) / len(p), 1e-6), 1 - 1e-6)
    between = max(np.var(p, ddof=1) - m * (1 - m) * np.mean([1 / len(v) for v in hosts.values()]), 1e-9)
    weight = min(max(m * (1 - m) / between - 1, 2), 1e6)
    rate = {h: (sum(v) + m * weight) / (len(v) + weight) for h, v in hosts.items()}
    good = stage(0, docs)
    assert of(good).keys() == {i for i, (bad, h) in stats.items() if not bad and rate[h] <= 0.5}
    # toxicity: the labels of ids that are not held out, and a threshold on the score
    kept = stage(1, good)
    score = toxicity.scorer(*toxicity.trained(good, common.table(spark, top, "labels"), ~common.held_out(F.col("doc_id"), 5, 0)))
    assert of(kept) == {i: t for i, t in of(good).items() if score(t)[0] < 0.5} and not any("scum" in t for t in of(kept).values())
    # line dedup
    ids = sorted(of(kept))
    want = dict(zip(ids, plain_line_dedup([of(kept)[i] for i in ids], 50), strict=True))
    lines = stage(2, kept)
    assert of(lines) == {i: t for i, t in want.items() if t == of(kept)[i] or re.search(r"[^\x20\x09-\x0D]", t)}
    assert lines.filter("n_chars <> length(text)").count() == 0
    # near duplicates
    texts = of(lines)
    ids = sorted(texts)
    root = dict(zip(ids, (ids[k] for k in plain_components([plain_fingerprint(texts[i]) for i in ids])), strict=True))
    sets = {i: {tuple(x[k : k + 5]) for k in range(max(1, len(x) - 4))} if (x := texts[i].lower().split()) else set() for i in ids}
    for i, j in combinations(ids, 2):
        both = len(sets[i] & sets[j])
        if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both) and root[i] != root[j]:
            a, b = sorted((root[i], root[j]))
            root = {k: a if r == b else r for k, r in root.items()}
    near = stage(3, lines)
    assert of(near) == {i: t for i, t in texts.items() if root[i] == i} and len(of(near)) < len(ids)
    # packing
    encode = byte_coder()()
    packed = pipeline.run(spark, top).toPandas()
    assert {i: int(g.length.sum()) for i, g in packed.groupby("doc_id")} == {i: len(encode(t)) + 1 for i, t in of(near).items()}
    assert (packed.groupby("sequence_id").length.sum() <= 2048).all()


def test_stages_on_odd_tables(spark, folder):
    """Empty tables, rows that repeat, null ids: defined results, no crash."""
    top, _ = folder
    docs = common.table(spark, top, "documents")
    empty = docs.limit(0)
    for _, f in pipeline.STAGES:
        assert f(spark, empty, top).count() == 0
    some = docs.filter("doc_id IN (1, 4, 7)")
    odd = some.unionByName(some).unionByName(some.withColumn("doc_id", F.lit(None).cast("long")))
    for name, f in pipeline.STAGES[:-1]:
        got = sorted((r["doc_id"] or 0, r["text"]) for r in f(spark, odd, top).collect())
        want = sorted((r["doc_id"] or 0, r["text"]) for r in odd.collect())
        assert got == (want if name != "line_dedup" else got) and len(got) >= 3


# --- the queries ---

LATER = ("op11_source_divergence", "op12_importance_resampling", "op13_warc")  # in test_audits.py: they give other rows, or read other tables


def test_queries(spark, folder):
    top, rows = folder
    texts, out = {r[0]: r[1] for r in rows}, {n: f(spark, top).toPandas() for n, f in QUERIES.items() if n not in LATER}
    rest = lambda i, m: zlib.crc32(str(i).encode()) % m
    for name, df in out.items():
        assert set(df.doc_id) == set(texts), name
        assert name == "op5_best_fit_packing" or len(df) == len(texts), name
    for name, m, k, cut in (("op2_toxicity", 5, 0, 0.5), ("op10_quality", 4, 2, 0.7)):
        df = out[name]
        assert all(r.held_out == (rest(r.doc_id, m) == k) and r.predicted == int(r.score >= cut) and 0 <= r.score <= 1 for r in df.itertuples())
    toxic = {r.doc_id for r in out["op2_toxicity"].itertuples() if r.predicted}
    assert toxic == {i for i, t in texts.items() if "scum" in (t or "")}
    lang = out["op3_language"]
    assert all(r.held_out == (rest(r.doc_id, 5) == 0) and r.lang_pred == ("en" if re.search("[a-z]", texts[r.doc_id] or "") else "und") for r in lang.itertuples())
    library, sha = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), lambda s: hashlib.sha256(s.encode()).hexdigest()
    library.encode_special_tokens = True
    for r in out["op4_bpe"].itertuples():
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))
    order = sorted(texts)
    prints = [plain_fingerprint(texts[i]) for i in order]
    found = out["op6_simhash"].set_index("doc_id")
    assert [found.fingerprint[i] for i in order] == [f"{x:016x}" for x in prints] and [found.component_id[i] for i in order] == [order[k] for k in plain_components(prints)]
    near = out["op8_fingerprint"].set_index("doc_id")
    for k, i in enumerate(order):
        own, nxt = texts[i] or "", texts[order[(k + 1) % len(order)]] or ""
        assert near.n_chars[i] == len(own) and near.edited_sha256[i] == sha(own[: len(own) - len(own) // 4] + nxt[: len(own) // 4])
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{top}/documents.parquet/*.parquet'")
    for name, sql in SQL.items():
        if name in LATER:
            continue
        want = duck.sql(sql).df()
        lines = lambda df: sorted("|".join(map(str, r)) for r in df[sorted(want.columns)].astype(str).itertuples(index=False))  # noqa: B023, E731
        assert set(out[name].columns) == set(want.columns) and lines(out[name]) == lines(want), name


def test_transducer_streams(monkeypatch):
    """Long words and texts in stretches give what whole ones do."""
    c = bpe.Coder(bpe.vocabulary(public_tokenizers.path("word_bpe_49k.json")))
    rng = random.Random(18)
    text = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.choice([3, 9, 60, 5000]))) for _ in range(40)) + "!" * 3000 + " é" * 50
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = library.encode(text, add_special_tokens=False).ids
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for stretch in (1 << 16, 50):
        monkeypatch.setattr(bpe, "STRETCH", stretch)
        assert c(text) == ids and c.digests(text) == (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))
    assert c.transducer.most <= 4 * c.v.longest


def test_decoder_holds_unfinished_characters():
    v = bpe.vocabulary(public_tokenizers.path("word_bpe_49k.json"))
    d, marks = bpe.Decoder(v), bpe.byte_marks()
    parts = [d.feed(v.ids[marks[b]]) for b in "é日".encode()]
    assert parts == ["", "é", "", "", "日"] and d.finish() == ""


def test_rules_are_the_ones_of_the_stage(spark, folder):
    top, _ = folder
    docs = common.table(spark, top, "documents")
    assert {r["doc_id"] for r in rules.passing(docs).collect()} == {r["doc_id"] for r in rules.host_quality(docs).collect() if r["kept"]}
