"""Caches, pools, chat and rerank models: what lives in the driver."""

import json
import sys

import pytest
from pyspark.sql import functions as F

from lexloom.functions import answers, embed
from lexloom.operators import rerank, stats
from lexloom.plans.cache import Lru, Metrics, Pool, Results, Vectors, query_key
from lexloom.sources.vectors import Chunks


def test_lru():
    now = [0.0]
    c = Lru(2, ttl_s=10, clock=lambda: now[0])
    c.put("a", 1), c.put("b", 2)
    assert c.get("a") == 1
    c.put("c", 3)
    assert "b" not in c and c.get("b") is None and c.stats()["hit_rate"] == 0.5 and c.evicted == 1
    now[0] = 11
    assert c.get("a") is None and c.expire() == 1 and len(c) == 0
    c.put("x1", 1), c.put("x2", 2)
    c.resize(1)
    assert "x2" in c and len(c) == 1 and c.drop_where(lambda k: k.startswith("x")) == 1 and not c.drop("x2")
    with pytest.raises(ValueError):
        Lru(0)


def test_vectors():
    c = Vectors(10)
    assert c.preload("m", [("A ", [1.0, 0.0]), ("b", [0.0, 1.0])]) == 2 and c.get(c.key("m", " a")) == [1.0, 0.0] and c.memory() == 232
    d = Vectors(10)
    assert d.imported(json.loads(json.dumps(c.exported()))) == 2 and d.get(d.key("m", "B")) == [0.0, 1.0]
    with pytest.raises(ValueError):
        d.imported({"version": 2})

    class Once(embed.Sine):
        asked = 0

        def batch(self, texts):
            self.asked += len(texts)
            return super().batch(texts)

    behind = Once(8)
    p = embed.Remembering(behind, Vectors(10))
    assert p.batch(["x", "X", "y"])[0] == p.embed("x") and behind.asked == 2
    assert embed.shared(lambda: behind, "a") is embed.shared(lambda: Once(8), "a")


def test_results():
    far, now = {}, [0.0]
    a, b = (Results(far=far, clock=lambda: now[0]) for _ in range(2))
    key = query_key("q", {"x": {"y": 1}}, limit=3)
    assert key == query_key("q", {"x": {"y": 1}}, limit=3) != query_key("q", {"x": {"y": 2}}, limit=3)
    a.put(key, [1, 2])
    assert b.get(key) == [1, 2] and b.stats()["far_hits"] == 1
    now[0] = 400
    assert a.get(key) is None
    a.put(key, 3), a.clear()
    assert a.get(key) is None and not far


def test_pool():
    made, closed, now = [], [], [0.0]
    p = Pool(lambda: made.append(1) or len(made), least=1, most=2, wait_s=0.01, idle_s=5, close=closed.append, clock=lambda: now[0])
    with p.lent() as x, p.lent() as y:
        assert {x, y} == {1, 2} and p.stats()["lent"] == 2
        with pytest.raises(TimeoutError), p.lent():
            pass
    now[0] = 10
    assert p.trim() == 1 and p.stats() == {"total": 1, "idle": 1, "lent": 0, "max": 2} and len(closed) == 1


def test_metrics(spark):
    m = Metrics(last=2)
    for i in range(3):
        m.add(float(i), {"scan": i, "sort": 1}, at=i)
    records, steps = m.frames(spark)
    assert stats.average_time(records).first()["average"] == 1.5 and {r["step"]: r["time"] for r in stats.step_times(steps).collect()} == {"scan": 3.0, "sort": 2.0}


def test_chat_failover():
    now, asked = [0.0], []

    def post(url, headers, body):
        asked.append(url)
        if "bad" in url:
            raise OSError("down")
        return {"choices": [{"message": {"content": body["model"]}}]}

    ask = answers.Asker([answers.Chat("http://bad", "a"), answers.Chat("http://good", "b", "k")], post, clock=lambda: now[0])
    assert ask("x") == ask("x") == "b" and len(asked) == 3  # the good one is asked first from then on
    only = answers.Asker([answers.Chat("http://bad", "a")], post, clock=lambda: now[0])
    for _ in range(4):
        with pytest.raises(RuntimeError):
            only("x")
    n = len(asked)
    with pytest.raises(RuntimeError):
        only("x")
    assert len(asked) == n  # it rests


def test_rerank_process():
    p = rerank.Process([sys.executable, "-m", "lexloom.operators.rerank"], timeout_s=60)
    assert p.rerank("a b", ["c", "b a", "a"], 2) == [(1, 1.0), (2, 0.5)] and p.rerank("a", [], 2) == []
    with pytest.raises(RuntimeError):
        rerank.Process([sys.executable, "-c", "import sys; sys.exit(3)"]).rerank("a", ["b"], 1)
    with pytest.raises(RuntimeError):
        rerank.Process([sys.executable, "-c", "print('{\"error\": \"no\"}')"]).rerank("a", ["b"], 1)


def test_chunks(spark):
    c = Chunks(spark)
    rows = spark.createDataFrame([("1", "d", "x", [1.0, 0.0], {"k": "v"}), ("2", "e", "y", [0.0, 1.0], {"id": "1"})], "id string, document_id string, content string, embedding array<float>, metadata map<string,string>")
    c.add(rows)
    c.add(rows.filter("id = '1'").withColumn("content", F.lit("z")))
    assert [r["content"] for r in c.search([1.0, 0.0]).collect()] == ["z", "y"] and c.get("1").first()["content"] == "z"
    assert [r["id"] for r in c.search([1.0, 0.0], filter="k = 'v'").collect()] == ["1"]
    assert {r["id"] for r in c.search([1.0, 0.0], filter="id = '1'").collect()} == {"1", "2"}  # metadata first, then the column


def test_chunk_tables_grow_by_their_changes(spark, tmp_path):
    """Both tables alike through any changes; a stored one writes what came or went, and folds it in when told."""
    import random

    from lexloom.sources.vectors import SCHEMA, Chunks, StoredChunks

    rng, path = random.Random(1), tmp_path / "c"
    held, own, plain = Chunks(spark), StoredChunks(spark, str(path)), {}
    big = [(f"i{i}", f"d{i % 40}", f"text {rng.random()}", [rng.random(), 1.0], {"k": "v"}) for i in range(3000)]
    size = lambda: sum(f.stat().st_size for f in path.rglob("*.parquet"))
    for step in range(10):
        if step % 3 == 2:
            doc = f"d{rng.randrange(40)}"
            held.remove_document(doc)
            own.remove_document(doc)
            plain = {k: v for k, v in plain.items() if v[1] != doc}
        else:
            rows = big if not step else [(i, d, f"new {step}", v, m) for i, d, _, v, m in rng.sample(big, 5)]
            before = size() if path.exists() else 0
            for c in (held, own):
                c.add(spark.createDataFrame(rows, SCHEMA))
            assert not step or size() - before < before / 5
            plain |= {r[0]: r for r in rows}
    show = lambda c: sorted((r["id"], r["document_id"], r["content"]) for r in c.rows.collect())
    want = sorted(r[:3] for r in plain.values())
    assert show(held) == show(own) == show(StoredChunks(spark, str(path))) == want
    own.compact()
    assert len(list(path.iterdir())) == 1 and show(own) == show(StoredChunks(spark, str(path))) == want
    assert own.search([1.0, 0.0], 2).count() == 2 and own.get("i1").count() == 1
