import random

import corpus_pipeline as pipeline
from lexloom.llm.common import written


def test_stages(spark, tmp_path):
    rng = random.Random(1)
    prose = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    passage = prose(60)
    texts = [prose(200) for _ in range(30)]
    texts[3] += " " + "scum. " * 3
    texts[5] += "\n" + passage
    texts[8] += "\n" + passage
    texts[11] = "# " * 90
    texts += ["\n".join(texts[0].split(" ", 100)), texts[1], prose(3)]
    texts += [t + " scum scum" for t in (prose(100) for _ in range(12))]
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df = df.selectExpr("*", "doc_id as other", "'x' as failed", "7 as n_deleted", "doc_id as `a.b`")  # further columns pass through
    df.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int("scum" in t)) for i, t in enumerate(texts)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, left = df, {}
    for name, stage in pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, str(tmp_path)))
        assert docs.columns == df.columns
        left[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert not {11, 32} & set(left["quality_rules"]) and len(left["quality_rules"]) == len(texts) - 2
    assert not any("scum" in t for t in left["toxicity"].values())
    assert passage in left["line_dedup"][5] and passage not in left["line_dedup"][8] and 31 not in left["line_dedup"]
    assert set(range(30)) - {3, 11} <= set(left["near_dedup"])
    assert docs.filter("other <> doc_id or failed <> 'x' or n_deleted <> 7 or `a.b` <> doc_id").count() == 0
    packed = pipeline.pack(spark, docs, str(tmp_path)).toPandas()
    assert set(packed.doc_id) == set(left["near_dedup"])
    again = pipeline.run(spark, str(tmp_path)).toPandas()
    key = ["doc_id", "piece", "length", "ids_crc32"]
    assert sorted(map(tuple, again[key].values)) == sorted(map(tuple, packed[key].values))
