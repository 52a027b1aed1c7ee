"""What a review found, each case on rows that show it."""

import duckdb
import numpy as np
import pytest

from lexloom import rule_queries, stored_queries  # noqa: F401
from lexloom.operators import vector
from lexloom.queries import QUERIES, SQL
from lexloom.session import shared_folder
from lexloom.sources.vector_index import VectorIndex
from tests.test_queries import lines

PAGES = [
    (1, "https://e.com/a", '<html><head><title>say &quot;so&quot; &amp;lt; ends&amp</title></head><body><h1>ends&amp</h1><article><p>&quot;a&quot; &copy; &lt;b&gt;<br><p>c&#x27;d &middot; e&</article></body></html>'),
]


@pytest.mark.parametrize("name", ["entities", "html_text", "html_title"])
def test_references(spark, tmp_path, name):
    spark.createDataFrame(PAGES, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    sql = duckdb.connect()
    sql.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert lines(QUERIES[name](spark, str(tmp_path)).toPandas()) == lines(sql.sql(SQL[name]).df())


def test_uploads_read_on_a_cluster(spark, monkeypatch):
    monkeypatch.setattr(type(spark.sparkContext), "master", property(lambda s: "spark://elsewhere"), raising=False)
    assert QUERIES["uploads_read"](spark, "unused").count() == 6


def recall(spark, kind, n=4000, d=48, appended=False, **options):
    """Share of ten neighbours that an index of rows without structure finds for queries that it doesn't hold."""
    x = np.random.default_rng(3).standard_normal((n + 40, d)).astype(np.float32)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<float>").cache()
    asked, held = rows.filter(f"id >= {n}"), rows.filter(f"id < {n}")
    index = VectorIndex(spark, shared_folder(spark))
    index.fit(held.filter("id % 2 = 1") if appended else held, kind, **options)
    if appended:
        index.append(held.filter("id % 2 = 0"))
    want, got = (set(df.select("query", "id").toPandas().itertuples(index=False, name=None)) for df in (vector.search(held, asked, 10), index.search(asked, 10)))
    return len(want & got) / len(want)


def test_graph_recall(spark):
    assert recall(spark, "graph") >= 0.9


def test_graph_recall_after_growth(spark):
    assert recall(spark, "graph", appended=True) >= 0.9


def test_codes_recall(spark):
    assert recall(spark, "codes", parts=4) >= 0.9
