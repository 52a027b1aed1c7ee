"""Posting blocks against plain keyword search."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lexloom.operators import keyword, postings


def rows(spark, n=4000, seed=1):
    rng = random.Random(seed)
    out = [(f"d{i}", s, w, rng.randrange(1, 4)) for i in range(n) for s in ("title", "content") for w in {f"w{int(rng.paretovariate(0.7))}" for _ in range(4)}]
    out += [("d7", "content", "rare", 900), ("d8", "content", "rare", 5), ("d7", "content", "w1", 500), (None, "content", "w1", 9), ("d1", "content", None, 9)]
    return spark.createDataFrame(out, "document_id string, source string, keyword string, frequency int")


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    r = rows(spark).cache()
    return r, postings.store(r, str(tmp_path_factory.mktemp("p") / "blocks"), buckets=32)


@pytest.mark.parametrize("words", [["w1"], ["w1", "W2", "w1"], ["rare", "w1", "none"], ["none"], []])
def test_equal_to_plain_search(spark, stored, words):
    r, posted = stored
    plain = keyword.search(r.filter("document_id IS NOT NULL"), words)
    assert sorted(map(tuple, postings.search(posted, words).select("document_id", "score", "matched").collect())) == sorted(map(tuple, plain.select("document_id", "score", "matched").collect()))
    for least in (1, 2):
        for k in (1, 5, 300):
            best = [tuple(x) for x in plain.filter(F.col("matched") >= least).orderBy(F.desc("score"), "document_id").limit(k).select("document_id", "score", "matched").collect()]
            assert [tuple(x) for x in postings.topk(posted, words, k, least).select("document_id", "score", "matched").collect()] == best


def test_blocks_are_skipped_and_filters_pushed(spark, stored):
    _, posted = stored
    got = postings.skipped(posted, ["rare", "w1"], 1).first()
    assert got["blocks"] >= 33 and got["read"] <= 4
    plan = postings.search(posted, ["rare", "w1"])._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PushedFilters: \[[^\]]*In\(keyword, \[rare,w1\]\)", plan)
    hot = posted.filter("keyword = 'w1'").agg(F.max("n"), F.count("*")).first()
    assert hot[1] == 32 and hot[0] < 250  # a common keyword is no single group


def test_odd_rows(spark):
    empty = postings.blocks(rows(spark, 1).limit(0))
    assert empty.count() == 0 and postings.topk(empty, ["w1"], 3).count() == 0
    assert {r["document_id"] for r in postings.entries(postings.blocks(rows(spark, 2))).collect()} >= {"d0", "d1", "d7"}
