"""What fitting the language model takes on the driver."""

import random
import tracemalloc

from pyspark.sql import functions as F

from lexloom.llm import langid


def test_features_reach_the_driver_packed(spark):
    rng = random.Random(1)
    rows = [(i, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6000)), "ab"[i % 2]) for i in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    tracemalloc.start()
    model = langid.trained(docs, F.lit(True))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert model.langs == ["a", "b"] and peak < 40e6, peak  # some 3,000 features a text
