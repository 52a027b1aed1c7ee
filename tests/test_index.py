"""The stored vector index: codes and graphs against exact search, growth, pruning."""

import os
import re
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexloom.operators import ann, vector
from lexloom.sources.vector_index import VectorIndex

DATA = os.environ.get("TEST_RECALL_DIR", "/root/testdata/sf0.1")


def vectors(spark):
    return spark.read.parquet(f"{DATA}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")


def recall(rows, asked, index, k=10, **options):
    best, found = ({(r["query"], r["id"]) for r in df.collect()} for df in (vector.search(rows, asked, k), index.search(asked, k, **options)))
    return len(best & found) / len(best)


def size(path):
    return sum(p.stat().st_size for p in Path(path).rglob("*.parquet"))


@pytest.fixture(scope="module")
def graph(spark, tmp_path_factory):
    index = VectorIndex(spark, str(tmp_path_factory.mktemp("graph") / "i"))
    index.fit(vectors(spark))
    return index


def test_graph_recall(spark, graph):
    rows = vectors(spark)
    asked = rows.filter("id % 100 = 0")
    assert recall(rows, asked, graph) >= 0.9
    n = rows.count()
    assert 0 < graph.search(asked, 10).agg(F.avg("scored")).first()[0] < n / 5
    assert graph.rows().agg(F.sum(F.size("ids"))).first()[0] == n  # every row
    best = vector.topk(rows, [1.0] * 64, 10).select("id", "score").collect()
    got = graph.topk([1.0] * 64, 10, beam=80).orderBy("nth").collect()
    assert len({r["id"] for r in best} & {r["id"] for r in got}) >= 9 and abs(best[0]["score"] - got[0]["score"]) < 1e-6


def test_codes_recall_and_pruning(spark, tmp_path):
    rows = vectors(spark)
    index = VectorIndex(spark, str(tmp_path / "i"))
    index.fit(rows, "codes", cells=8, parts=16)
    asked = rows.filter("id % 100 = 0")
    assert recall(rows, asked, index, beam=80) >= 0.9
    assert index.bytes_a_row() == 16
    plan = index.search(asked.limit(1), 10, probes=2)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*cell#\d+ IN", plan) and "codes" in plan
    assert recall(rows, asked, index, probes=1) < recall(rows, asked, index, probes=8)


def test_growth(spark, tmp_path):
    """Appended rows are written alone, found like the rest, and rows from elsewhere show as drift."""
    rows = vectors(spark)
    for kind in ("graph", "codes"):
        path = str(tmp_path / kind)
        index = VectorIndex(spark, path)
        index.fit(rows.filter("id % 10 > 0"), kind, cells=4)
        folders = index.store.manifest()["rows"]
        before, files = size(path), {p for p in Path(path).rglob("*.parquet")}
        index.append(rows.filter("id % 10 = 0"))
        assert index.store.manifest()["rows"][:-1] == folders and files <= {p for p in Path(path).rglob("*.parquet")}
        assert size(path) - before < before / 4
        assert recall(rows, rows.filter("id % 100 = 0"), index, probes=4) >= 0.9
        assert 0.9 < index.drift() < 1.1 and not index.needs_fit()
        index.fit(rows, kind, cells=2)
        assert index.vacuum() == 3 and recall(rows, rows.filter("id % 100 = 0"), index, probes=2) >= 0.9


def test_drift(spark, tmp_path):
    """Rows near other directions than those of the fit ask for a new one."""
    rng = np.random.default_rng(3)
    about = lambda first, n, axes: spark.createDataFrame([(first + i, (rng.normal(size=16) * 0.1 + (np.arange(16) == axes[i % len(axes)])).tolist()) for i in range(n)], "id long, embedding array<float>")
    index = VectorIndex(spark, str(tmp_path / "i"))
    index.fit(about(0, 400, [0, 1, 2, 3]), "codes", cells=4)
    index.append(about(400, 200, [0, 1, 2, 3]))
    assert not index.needs_fit()
    index.append(about(600, 200, [9, 10]))
    assert index.needs_fit() and index.drift() > 1.5


def test_odd_tables(spark, tmp_path):
    schema = "id long, embedding array<float>"
    index = VectorIndex(spark, str(tmp_path / "i"))
    index.fit(spark.createDataFrame([], schema))
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [1.0]), (4, [])], schema)
    assert index.search(asked, 3).count() == 0
    copies = [(i, [1.0, 0.0]) for i in range(50)] + [(100, [0.0, 1.0]), (101, None), (102, []), (103, [1.0, 2.0, 3.0]), (104, [0.0, 0.0])]
    index.append(spark.createDataFrame(copies, schema))
    got = index.search(asked, 3).orderBy("nth").collect()
    assert [(r["query"], r["id"], r["score"]) for r in got] == [(1, 0, 1.0), (1, 1, 1.0), (1, 2, 1.0)]
    assert index.rows().count() == 3 and index.stored(spark.createDataFrame([(5,), (101,)], "id long")).count() == 1


def test_parts_of_a_crowded_cell(spark, tmp_path):
    rows = vectors(spark)
    index = VectorIndex(spark, str(tmp_path / "i"))
    index.fit(rows, cells=1, cell_rows=300)
    sizes = [r["count"] for r in index.rows().groupBy("cell", "part").count().collect()]
    assert len(sizes) == 7 and max(sizes) < 500
    assert recall(rows, rows.filter("id % 100 = 0"), index, block=7) >= 0.9


def test_graph_of_arrays():
    """Links go both ways, spread, and lead everywhere."""
    rng = np.random.default_rng(4)
    m = vector.unit(rng.normal(size=(500, 16))).astype(np.float32)
    g = ann.links(m, 6, far=2)
    assert g.shape == (500, 14) and g.max() < 500
    seen, todo = {0}, [0]
    while todo:
        todo = [j for i in todo for j in g[i].tolist() if j >= 0 and j not in seen and not seen.add(j)]
    assert len(seen) == 500
    assert ann.links(m[:1]).tolist() == [[-1]] and len(ann.links(m[:0])) == 0 and ann.links(m[:2], far=0)[0, 0] == 1
    of, row, score, scored = ann.beam_search(m, g, m[:9], 500)
    assert all(sorted(row[of == i].tolist()) == list(range(500)) for i in range(9)) and scored.tolist() == [500] * 9
    assert (np.diff(score[of == 3]) <= 0).all() and row[of == 3][0] == 3


def test_product_codes():
    rng = np.random.default_rng(5)
    x = vector.unit(rng.normal(size=(600, 10)))
    books = ann.codebooks(x, 4)
    codes = books.encode(x)
    assert codes.shape == (600, 4) and books.numbers == 10
    q = x[:5]
    rebuilt = np.concatenate([c[codes[:, i]] for i, c in enumerate(books.centres)], axis=1)
    assert np.allclose(books.scores(books.tables(q), codes), q @ rebuilt.T, atol=1e-5)
    few = ann.codebooks(x[:3], 4)
    assert np.allclose(few.scores(few.tables(q), few.encode(x[:3])), q @ x[:3].T, atol=1e-5)
