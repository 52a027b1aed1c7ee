"""What a task holds or a query moves doesn't follow the size of a batch, a text or a group."""

import random
import sys
import tracemalloc
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexloom.functions import batches, chunk, html, language
from lexloom.operators import ann, keyword, postings, vector
from lexloom.queries import QUERIES
from lexloom.sources import crawl


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def counting():
    """Says how many results of earlier rows there are still."""
    import weakref

    class Kept(list):
        pass

    refs = []

    def run(x):
        refs[:] = [r for r in refs if r() is not None]
        out = Kept([len(refs)])
        refs.append(weakref.ref(out))
        return out

    return run


def test_results_of_a_batch_are_handed_on(spark):
    rows = spark.range(0, 3000, 1, 1)
    got = [r[0][0] for r in rows.select(batches.by_row(counting, "array<int>", F.col("id"))).collect()]
    assert len(got) == 3000 and max(got) <= 2 * batches.ROWS


@pytest.mark.parametrize("column", [lambda: html.extracted(F.col("t"), F.lit("https://e.com/")), lambda: html.decoded_entities(F.col("t")), lambda: chunk.chunked(F.col("t")), lambda: language.detected(F.col("t"), {"a": {"abc": -1.0}})])
def test_texts_go_through_a_part_at_a_time(spark, column):
    df = spark.createDataFrame([("<p>a</p>",), (None,)], "t string").select(column().alias("x"))
    assert df.count() == 2 and len(df.collect()) == 2
    assert "ArrowEvalPython" in plan(df) and ", 251" in plan(df)  # an iterator over Arrow arrays


def test_links_of_a_page_take_one_worker(spark):
    page = '<a href="/b/#x">1</a><a href="b">2</a><a href="HTTPS://e.com:443/c//d/">3</a><a href="ftp://e.com/">4</a><pre>code</pre>'
    pages = spark.createDataFrame([("https://e.com/a/", page), (None, page), ("no url", "<a href='https://e.com/z'>z</a>"), ("https://e.com/n", None)], "url string, html string")
    found = crawl.page_links(pages)
    assert plan(found).split("Initial Plan")[0].count("ArrowEvalPython") == 1
    want = [("https://e.com/a", "https://e.com/a/b"), ("https://e.com/a", "https://e.com/b"), ("https://e.com/a", "https://e.com/c/d"), (None, "https://e.com/c/d"), (None, "https://e.com/z")]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)
    assert crawl.page_links(pages, within=True).count() == 0


def test_parts_are_bounded():
    import pyarrow as pa

    texts = pa.array(["x" * (batches.BYTES // 3)] * 7 + [None] * 1000 + ["y" * (2 * batches.BYTES)])
    got = list(batches.parts((texts, pa.array(range(len(texts))))))
    assert [x for a, _ in got for x in a] == texts.to_pylist() and [x for _, b in got for x in b] == list(range(len(texts)))
    assert all(len(a) == 1 or len(a) <= batches.ROWS and sum(len(x or "") for x in a) <= batches.BYTES for a, _ in got)


def test_postings_move_rows_once(spark):
    docs = spark.createDataFrame([(i, f"alpha word{i % 7} alpha") for i in range(50)], "id long, content string")
    made = postings.blocks(keyword.occurrences(docs, fields={"content": "content"}).withColumn("frequency", F.lit(1)), 4)
    assert plan(made).split("Initial Plan")[0].count("Exchange ") == 1
    assert postings.search(made, ["alpha"]).agg(F.sum("score"), F.count("*")).first() == (100.0, 50)


def test_chunk_rules_leave_texts_where_they_are(spark, tmp_path):
    rows = [(1, "some words " * 300), (1, "other words"), (2, " \n "), (3, None), (4, "x" * 900)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    df = QUERIES["chunk_rules"](spark, str(tmp_path))
    assert "Exchange" not in plan(df) and "Generate" not in plan(df)
    assert sorted(map(tuple, df.collect())) == [(1, True, True, True, True)] * 2 + [(4, True, True, True, True)]


def test_a_wide_beam_is_bounded():
    rng = np.random.default_rng(2)
    m, q = (vector.unit(rng.standard_normal((n, 64))).astype(np.float32) for n in (4096, 128))
    graph = ann.links(m, 8)
    tracemalloc.start()
    got = ann.beam_search(m, graph, q, 4096, 256)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80e6, peak
    one = [ann.beam_search(m, graph, q[i : i + 1], 4096, 256) for i in range(3)]
    for i, (_, row, score, scored) in enumerate(one):
        assert (got[1][got[0] == i] == row).all() and (got[2][got[0] == i] == score).all() and got[3][i] == scored[0]


def test_cells_are_found_a_part_at_a_time():
    import pandas as pd

    rng = np.random.default_rng(3)
    v, centroids = rng.standard_normal((5000, 8)), rng.standard_normal((2000, 8))
    tracemalloc.start()
    got = vector.nearest_cells(pd.Series(list(v)), centroids, 3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6 and (np.stack(got) == np.argsort(-(v @ centroids.T), axis=1, kind="stable")[:, :3]).all()


def test_letters_and_sums_of_the_detector():
    text = "".join(map(chr, [c for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]))
    assert language.words(text) == Counter("".join(c if c.isalpha() else " " for c in text.lower()).split())
    rng = random.Random(4)
    known = {x: {a + b + c: -rng.random() * 9 for a in " abc" for b in "abc" for c in "abc "} for x in ("x", "y", "z")}
    detect = language.Detector(known, most=50)
    for _ in range(60):
        t = " ".join("".join(rng.choice("abcd") for _ in range(rng.randrange(1, 7))) for _ in range(40))
        n, fit = 0, [0.0] * 3
        for w, k in language.words(t).items():
            g = language.trigrams(w)
            n += len(g) * k
            fit = [a + k * sum(known[x].get(y, -12.0) for y in g) for a, x in zip(fit, "xyz", strict=True)]
        assert detect(t)[0] == "xyz"[max(range(3), key=fit.__getitem__)]
    assert len(detect.seen) < 100


def test_stages_read_whole_texts_a_few_at_a_time(spark, tmp_path):
    import corpus_pipeline
    from lexloom.llm import common

    keys = {"spark.sql.parquet.columnarReaderBatchSize": common.READ_ROWS, "spark.sql.execution.arrow.maxRecordsPerBatch": common.ARROW_ROWS}
    for key in keys:
        spark.conf.unset(key)
    spark.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(3).cast("long").alias("n_chars")).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    try:
        packed = corpus_pipeline.pack(spark, docs, str(tmp_path))
        assert packed.columns and all(int(spark.conf.get(k)) == most for k, most in keys.items())

        def rows(batches):
            for b in batches:
                yield b.from_arrays([[b.num_rows]], names=["n"])

        got = [r[0] for r in docs.select("text").mapInArrow(rows, "n long").collect()]
        assert sum(got) == 3000 and max(got) <= common.ARROW_ROWS
        spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", 100)
        common.small_batches(spark)
        assert spark.conf.get("spark.sql.parquet.columnarReaderBatchSize") == "100"  # a smaller setting stays
    finally:
        for key in keys:
            spark.conf.unset(key)
