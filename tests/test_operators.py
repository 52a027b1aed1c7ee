import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexloom.functions.embed import Sine
from lexloom.operators import documents, filters, fusion, hybrid, keyword, rerank, stats, validate, vector
from lexloom.plans import config, cost

SINE = Sine(16)


def chunk_rows(spark):
    rows = [(f"c{i}", f"d{(i + 1) // 2}", i, SINE.embed("x" * i)) for i in range(1, 6)] + [("c9", "d1", 9, [])]
    return spark.createDataFrame(rows, "id string, document_id string, chunk_index int, embedding array<float>")


def test_topk(spark):
    got = vector.topk(chunk_rows(spark), SINE.embed("x"), 2).collect()
    assert len(got) == 2 and got[0]["id"] == "c1" and got[0]["score"] == pytest.approx(1) and all(0 <= r["score"] <= 1 for r in got)
    assert {r["document_id"] for r in vector.in_document(chunk_rows(spark), SINE.embed("x"), "d2", 9).collect()} == {"d2"}
    assert vector.topk(chunk_rows(spark).limit(0), SINE.embed("x"), 2).count() == 0
    assert vector.topk(chunk_rows(spark), SINE.embed("x"), 9).count() == 5
    assert vector.topk(chunk_rows(spark), [1.0], 9).count() == 0


def test_cosine_guards(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 0.0])], "a array<float>, b array<float>")
    assert [r[0] for r in df.select(vector.cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.0]


def test_fusion(spark):
    rows = spark.createDataFrame([("a", s) for s in (0.9, 0.5, 0.4, 0.1)] + [("b", 0.2)], "document_id string, score double")
    got = {r["document_id"]: (round(r["score"], 6), r["hits"]) for r in fusion.by_document(rows).collect()}
    assert got == {"a": (0.66, 4), "b": (0.2, 1)} and fusion.by_document(rows, 0.5).count() == 1


def test_keyword_need():
    assert [keyword.need(n) for n in (1, 2, 3, 4, 5)] == [1, 2, 2, 2, 3]


def test_keyword_merge(spark):
    docs = spark.createDataFrame([("a", "red fish", "red red fish"), ("b", "", "red"), ("c", "", "fish red")], "id string, title string, content string")
    rows = keyword.index(docs)
    assert {(r["document_id"], r["score"], r["matched"]) for r in keyword.search(rows, ["red", "fish"]).collect()} == {("a", 5.0, 2), ("b", 1.0, 1), ("c", 2.0, 2)}
    own = spark.createDataFrame([("c", 0.7)], "document_id string, score double")
    assert {(r[0], r[1]) for r in keyword.merged(own, rows, "red fish", 0.1).collect()} == {("c", 0.7), ("a", 1.0)}
    assert keyword.eligible(rows, "red red").count() == 0 and keyword.eligible(rows, "red red", distinct=True).count() == 3


@pytest.mark.parametrize("n, rows, want", [(2, [(0.5, False), (0.0, True)], [(0.0, True)]), (2, [(0.5, False), (0.0, False)], [(0.5, False)]), (3, [(0.5, False), (0.0, False)], [(0.5, False), (0.0, False)]), (4, [(0.0, True), (0.0, False)], [(0.0, True), (0.0, False)])])
def test_gating(spark, n, rows, want):
    df = spark.createDataFrame(rows, "ratio double, phrase boolean")
    assert sorted(map(tuple, fusion.gated(df, n).collect())) == sorted(want)


def test_context_window(spark):
    rows = spark.createDataFrame([("d", i * 10) for i in range(5)], "document_id string, chunk_index int")
    assert [r["position"] for r in fusion.context_window(rows, "d", 1, 2, 1).orderBy("position").collect()] == [0, 1, 2]
    assert fusion.context_window(rows, "d", 9).count() == 0


@given(st.integers(0, 30), st.integers(0, 12), st.integers(1, 12))
def test_page_arithmetic(total, offset, limit):
    returned = min(max(total - offset, 0), limit)
    assert (offset + limit < total) == (total - offset - returned > 0)


def test_pages_do_not_overlap(spark):
    df = spark.range(7).selectExpr("cast(id as string) as id", "'t' as title", "'api' as source", "1 as content_length", "1 as chunks_count", "'x' as content", "cast(id % 3 as string) as updated_at")
    pages = [[r["id"] for r in documents.listing(df, o, 3).collect()] for o in (0, 3, 6, 9)]
    assert sorted(sum(pages, [])) == [str(i) for i in range(7)] and pages[3] == [] and documents.listing(df, 0, 0).count() == 0
    info = vector.page(df, df, 6, 3).first()
    assert (info["total_documents"], info["returned"], info["has_more"], info["next_offset"]) == (7, 1, False, None)


def tables(spark):
    docs = spark.createDataFrame([("1", "Python Tutorial", "learn python here", "upload", "Ann"), ("2", "Rust Guide", "learn rust", "api", None), ("3", "Python Notes", "nothing", "crawl", None)], "id string, title string, content string, source string, author string")
    none = F.lit(None).cast("string")
    docs = docs.withColumns({c: none for c in ("original_filename", "crawl_url", "description", "crawl_id", "content_type")})
    tags = spark.createDataFrame([("1", "python", False), ("1", "tutorial", False), ("2", "python", True)], "document_id string, tag string, is_generated boolean")
    langs = spark.createDataFrame([("1", "en"), ("2", "en"), ("3", "de")], "document_id string, language_code string")
    chunks = spark.createDataFrame([("c" + i, i, SINE.embed(t)) for i, t in (("1", "aa"), ("2", "b"), ("3", "aa"))], "id string, document_id string, embedding array<float>")
    return {"documents": docs, "tags": tags, "languages": langs, "chunks": chunks, "keywords": keyword.index(docs)}


def test_filters(spark):
    t = tables(spark)
    rows = t["chunks"]
    assert {r["document_id"] for r in filters.tags_any(rows, t["tags"], ["PYTHON"]).collect()} == {"1", "2"}
    assert {r["document_id"] for r in filters.tags_all(rows, t["tags"], ["python", "Tutorial"]).collect()} == {"1"}
    assert {r["document_id"] for r in filters.storage_filter(rows, t["documents"], t["tags"], t["languages"], {"languages": ["en"], "source": "api"}).collect()} == {"2"}
    assert [r["id"] for r in t["documents"].filter(filters.parsed("source = 'api' AND id = 2", t["documents"].columns)).collect()] == ["2"]
    own = documents.with_metadata(t["documents"], t["tags"], t["languages"])
    assert {r["id"] for r in own.filter(filters.metadata({"tags": ["python"]})).collect()} == {"1"}
    assert {r["id"] for r in own.filter(filters.metadata({"tags": ["python"]}, True)).collect()} == {"1", "2"}


def test_hybrid(spark):
    t = tables(spark)
    rows, info = hybrid.query(t, "python tutorial", SINE.embed("aa"), hybrid.Options(threshold=0.0))
    got = rows.collect()
    assert [r["id"] for r in got] == ["1"] and got[0]["ratio"] == 1.0 and info.first()["total_documents"] == 1
    rows, _ = hybrid.query(t, "", SINE.embed("aa"), hybrid.Options(threshold=0.0, filters={"languages": ["de"]}))
    assert [r["id"] for r in rows.collect()] == ["3"]
    rows, _ = hybrid.query(t, "nothing", SINE.embed("aa"), hybrid.Options(threshold=2.0, filters={"languages": ["de"]}))
    assert [(r["id"], r["score"]) for r in rows.collect()] == [("3", 1.0)]  # the fallback over metadata
    assert hybrid.query(t, "python", SINE.embed("aa"), hybrid.Options(threshold=0.0, limit=0))[0].count() == 0
    assert hybrid.query(t, "python", SINE.embed("aa"), hybrid.Options(threshold=0.0, rerank=True, prefilter=True))[0].count() == 2  # the second by its generated tag


def test_rerank(spark):
    df = spark.createDataFrame([("a", 0.9, "x y"), ("b", 0.8, "q r"), ("c", 0.7, "")], "document_id string, score double, t string")
    assert [r["document_id"] for r in rerank.rerank(df, "Q r", "t", 2).collect()] == ["b", "a"]
    remote = rerank.Remote(lambda u, h, b: {"results": [{"index": 1, "relevance_score": 0.9}, {"index": 7, "relevance_score": 1}]}, "u", "m", "k")
    assert rerank.with_model(df, "q", "t", remote, 2).select("document_id").collect()[0][0] == "b" and remote.rerank("q", [], 3) == []
    assert rerank.Chat(lambda p: 'x [{"index": 0, "score": 0.2}]').rerank("q", ["a", "b"], 5) == [(0, 0.2), (1, 0.0)]
    broken = rerank.Remote(lambda u, h, b: 1 / 0, "u", "m", "k")
    assert rerank.with_model(df, "q", "t", broken, 2).count() == 2
    assert not rerank.Settings().enabled and rerank.Settings(key="k").enabled and rerank.Settings(top_k=0).errors()


def test_ivf_recall(spark):
    rows = spark.createDataFrame([(i, SINE.embed(str(i))) for i in range(400)], "id int, embedding array<float>")
    cells = vector.ivf_fit(rows, 16)
    indexed = vector.ivf_assign(rows, cells).cache()
    hit = 0
    for q in (3, 50, 121):
        want = {r["id"] for r in vector.topk(rows, SINE.embed(str(q)), 10).collect()}
        hit += len(want & {r["id"] for r in vector.ivf_topk(indexed, cells, SINE.embed(str(q)), 10, probes=8).collect()})
    assert hit >= 27


def test_parameters():
    assert vector.ivf_parameters(10_000, 64) == (100, 4) and vector.hnsw_parameters(2_000_000)["m"] == 32 and vector.hnsw_memory(1, 1, 1) == 50
    assert vector.hnsw_errors(1, 200, 50) and not vector.hnsw_errors(16, 200, 50) and vector.index_choice(100, 64, False)["type"] == "ivf_pq"


def test_validate(spark):
    good = "00000000-0000-4000-8000-000000000001"
    docs = spark.createDataFrame([(good, "0123456789abcdef", "2024-01-02", "2024-01-01", 1, 0, "upload", "active"), ("bad", "x", "?", "2024-01-01", -1, 0, "?", "?")], "id string, content_hash string, created_at string, updated_at string, chunks_count int, code_blocks_count int, source string, status string")
    chunks = spark.createDataFrame([(good, "none", 5, 5, "ab", 3, [])], "id string, document_id string, start_position int, end_position int, content string, content_length int, embedding array<float>")
    blocks = spark.createDataFrame([], "id string, document_id string, content string, content_length int, language string, embedding array<float>")
    issues = validate.validate({"documents": docs, "chunks": chunks, "code_blocks": blocks})
    rules = {(r["category"], r["rule"]) for r in issues.collect()}
    assert {("document", "updated_before_created"), ("document", "bad_uuid"), ("document", "bad_created_at"), ("document", "negative_chunks_count"), ("relationship", "chunks_count_mismatch"), ("chunk", "missing_document"), ("chunk", "missing_embedding"), ("chunk", "empty_range"), ("chunk", "length_mismatch"), ("orphan", "orphan_chunk")} <= rules
    assert not validate.summary(issues).first()["valid"] and validate.validate_document(docs, good).first()["issues"] == ["updated_before_created"]


def test_stats(spark):
    rows = spark.createDataFrame([(float(i),) for i in range(1, 11)], "v double")
    assert stats.percentile(rows, "v", 95).first()[0] == 10.0 and stats.latency(rows, "v").first()["p50"] == 5.0
    history = spark.createDataFrame([(str(i), f"2024-01-0{i}", i != 2, 10.0 * i, i) for i in range(1, 5)], "id string, timestamp string, success boolean, duration_ms double, size long")
    s = stats.backup_stats(history).first()
    assert (s["total"], s["successful"], s["failed"], s["size"]) == (4, 3, 1, 10)
    assert [r["id"] for r in stats.backups_expired(history, 2).collect()] == ["1"]


def test_config(tmp_path):
    f = tmp_path / "c.toml"
    f.write_text('[lexloom]\nsimilarity_threshold = 7.0\naccepted_languages = ["en", "de"]\nmax_results = 3 # few\n')
    s = config.Settings.of(config.load(str(f), {"LEXLOOM_MAX_RESULTS": "4"}))
    assert s.similarity_threshold == 1.0 and s.max_results == 4 and s.query_languages == ("en", "de")
    assert config.timeout_ms({"A": " 5 "}, "A") == 5 and config.timeout_ms({"A": "5.5", "REQUEST_TIMEOUT_MS": "0"}, "A") == 30_000
    assert config.number("x", 7, 1, 9) == 7 and config.number("99", 7, 1, 9) == 9


def test_cost():
    steps = cost.plan(filters=2, tags=True)
    assert cost.total(cost.optimized(steps)) == cost.total(steps) == 85 and cost.estimate(1024, 1) == 70
    assert [s.kind for s in cost.optimized(steps[::-1])][-1] == "limit"


def test_search_with_odd_vectors(spark):
    """Other lengths, nulls, no vectors, no queries, no rows; ties by id; and blocks of any size give the same."""
    rows = [(i, [float(i % 3), 1.0, 0.5 * (i % 2)]) for i in range(12)] + [(50, [1.0]), (51, []), (52, None), (53, [0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, embedding array<double>")
    q = df.filter("id IN (0, 1, 50, 51, 52)")
    plain = {}
    for i, v in rows:
        if i in (0, 1, 50):
            cos = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / max((sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5, 1e-12)
            near = [(-round((1 + cos(v, w)) / 2, 9), j) for j, w in rows if w and len(w) == len(v)]
            plain[i] = [j for _, j in sorted(near)[:4]]
    for size in (1 << 22, 6):
        got = vector.search(df, q, 4, rows_block=size, query_block=size).collect()
        found = {i: [r["id"] for r in sorted(got, key=lambda r: r["nth"]) if r["query"] == i] for i in {r["query"] for r in got}}
        assert found == plain
    assert vector.search(df, df.filter("id < 0"), 4).count() == vector.search(df.limit(0), q, 4).count() == 0
    c = vector.ivf_fit(df, 3)
    got = vector.search(vector.ivf_assign(df, c), q, 4, centroids=c, probes=len(c))
    assert {r["query"] for r in got.collect()} == {0, 1}
    none = vector.ivf_fit(df.limit(0), 3)
    assert len(none) == 0 and vector.ivf_assign(df, none).count() == 0 and vector.ivf_topk(vector.ivf_assign(df, c), c, [1.0], 3).count() == 0


def test_probes_follow_the_clusters(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 16))
    x = np.repeat(centres, 40, axis=0) + 0.05 * rng.normal(size=(800, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>")
    c = vector.ivf_fit(df, 20)
    probes = vector.ivf_probes(df, c, 5)
    want = {(r["query"], r["id"]) for r in vector.search(df, df.filter("id % 40 = 0"), 5).collect()}
    got = {(r["query"], r["id"]) for r in vector.search(vector.ivf_assign(df, c), df.filter("id % 40 = 0"), 5, centroids=c, probes=probes).collect()}
    assert probes <= 5 and len(want & got) >= 0.9 * len(want)
