"""Each registered query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from lexloom import queries
from lexloom.queries import QUERIES, SQL

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ["events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def lines(df):
    df = df[sorted(df.columns)]
    return list(df.columns), sorted("|".join(map(str, r)) for r in df.astype(str).itertuples(index=False))


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, DATA).toPandas()
    if name in SQL:
        assert lines(got) == lines(duck.sql(SQL[name]).df())


def test_index_recall(spark):
    best, found = (QUERIES[n](spark, DATA).toPandas() for n in ("vector_search", "ivf_search"))
    want, got = (set(zip(x["query"], x["id"], strict=True)) for x in (best, found))
    assert len(want & got) >= 0.9 * len(want)


def test_topk_recall(spark, monkeypatch):
    folder = os.environ.get("TEST_RECALL_DIR", "/root/testdata/sf0.1")
    share = []
    for i in range(0, 500, 100):
        monkeypatch.setattr(queries, "first_vector", lambda spark, d, i=i: queries.table(spark, d, "embeddings").filter(f"vec_id = {i}").first()["embedding"])
        best, found = (set(QUERIES[n](spark, folder).toPandas()["id"]) for n in ("vector_topk", "ivf_topk"))
        share.append(len(best & found) / len(best))
    assert share[0] >= 0.9 and sum(share) / len(share) >= 0.9, share
