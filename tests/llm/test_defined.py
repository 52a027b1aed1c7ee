"""The result that each operator's docstring defines for nulls, empty and very long texts, ties and repeated rows."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lexloom.llm import bpe, fingerprint, langid, licenses, linededup, packing, quality, rules, simhash, toxicity
from lexloom.llm.queries import byte_coder
from tests.llm.test_operators import AWKWARD, frame

NONE, EMPTY, BLANK, ONE, WIDE, LINES, COPY, AGAIN, ODD = range(len(AWKWARD))


@pytest.fixture(scope="module")
def rows(spark):
    """Every row twice, and twice a row of nulls."""
    df = frame(spark, AWKWARD)
    nulls = df.limit(1).select(*(F.lit(None).cast(df.schema[c].dataType).alias(c) for c in df.columns))
    df = df.unionByName(nulls)
    return df.unionByName(df).cache()


def held(df, *cols):
    """id -> its rows' values, which repeated rows have in common."""
    out = {}
    for r in df.select("doc_id", *cols).collect():
        out.setdefault(r[0], []).append(tuple(r)[1:])
    assert set(out) == {*range(len(AWKWARD)), None} and all(len(v) == 2 and v[0] == v[1] for v in out.values()), out
    return {k: v[0] for k, v in out.items()}


def test_licences(rows):
    got = held(licenses.scanned(rows, F.concat_ws("/", "source", F.col("doc_id").cast("string"))), "own_license", "license")
    assert set(got.values()) == {(None, None)}


def test_toxicity(rows):
    got = held(toxicity.scored(rows, {}, -5.0), "score", "offending")
    p = 1 / (1 + np.exp(5.0))
    assert got[NONE] == got[EMPTY] == got[None] == (0.0, []) and got[ONE][0] == pytest.approx(p) and all(not v[1] for v in got.values())
    assert got[LINES][0] < 0.5 and got[COPY] == got[AGAIN]
    assert toxicity.clean(rows, {}, -5.0).count() == rows.count()


def test_language(rows):
    model = langid.trained(rows, F.col("doc_id").isNotNull())
    got = held(langid.predicted(rows, model), "lang_pred", "score")
    assert got[NONE] == got[EMPTY] == got[BLANK] == got[None] == ("und", 0.0)
    assert {got[i][0] for i in (ONE, WIDE, LINES, COPY, AGAIN, ODD)} == {"en"}


def test_bpe(rows):
    got = held(bpe.coded(rows, public_tokenizers.path("word_bpe_49k.json")), "n_tokens", "ids_sha256", "decoded_sha256")
    nothing = hashlib.sha256(b"").hexdigest()
    assert got[NONE] == got[EMPTY] == got[None] == (0, nothing, nothing) and got[COPY] == got[AGAIN] and got[WIDE][0] > 0 and got[LINES][0] >= 6000


def test_packing(rows):
    got = packing.best_fit(rows, byte_coder()).collect()
    pieces = Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got)
    assert set(pieces.values()) == {2} and {(r["piece"], r["start"], r["length"]) for r in got if r["doc_id"] in (NONE, EMPTY, None)} == {(0, 0, 1)}
    long = sorted((r["piece"], r["length"]) for r in got if r["doc_id"] == LINES)[::2]
    assert len(long) > 2 and all(n == 2048 for _, n in long[1:])
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in bins.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:], strict=False)) and sum(n for _, n in own) <= 2048


def test_simhash(rows):
    got = held(simhash.near_duplicates(rows), "fp", "component")
    assert got[NONE] == got[EMPTY] == got[BLANK] == got[None] == (0, NONE) and got[COPY] == got[AGAIN] and got[AGAIN][1] == COPY


def test_line_dedup(rows):
    got = held(linededup.without_copies(rows), "text", "n_deleted")
    assert got[NONE] == got[None] == (None, 0) and got[EMPTY] == ("", 0) and got[BLANK] == (AWKWARD[BLANK], 0) and got[COPY] == got[AGAIN] == (AWKWARD[COPY], 0)
    assert got[LINES][1] > 2900 and got[LINES][0].startswith("a b\n")


def test_fingerprints(rows):
    got = {r["doc_id"]: r for r in fingerprint.neighbours(rows).collect()}
    assert fingerprint.neighbours(rows).count() == rows.count() and got[COPY]["fingerprint"] == got[AGAIN]["fingerprint"]
    assert got[NONE]["n_chars"] == got[EMPTY]["n_chars"] == 0 and got[NONE]["fingerprint"] == got[EMPTY]["fingerprint"] == got[None]["fingerprint"]
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got.values()) and got[COPY]["near_next"] == 1.0


def test_rules(rows):
    got = held(rules.host_quality(rows), "n_words", "word_chars", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    assert got[NONE] == got[EMPTY] == got[BLANK] == got[None] == (0, 0, 0, 0, True, False)
    assert got[LINES] == (6000, 6000, 2999, 6000, True, False) and got[WIDE][:2] == (1, 50_000)
    assert rules.passing(rows).count() == 0


def test_quality(rows):
    got = held(quality.scored(rows, quality.boost(np.zeros((0, 16)), np.zeros(0))), "score")
    assert len(set(got.values())) == 1
