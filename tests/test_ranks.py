"""Exact ranks and pages against sorted rows."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lexloom.operators import ranks, stats


def plain(values, p):
    own = sorted((v for v in values if v is not None), key=lambda v: (math.isnan(v), v))
    return own[max(1, math.ceil(round(p * len(own), 9))) - 1] if own else None


def corpus():
    rng = random.Random(1)
    rows = [("hot", rng.choice([rng.gauss(0, 1), rng.gauss(0, 1) * 1e12, 5.0, -0.0, 1e-300])) for _ in range(6000)]
    rows += [("odd", v) for v in (math.nan, math.inf, -math.inf, math.inf, 0.0, None, 1.7e308, -1.7e308)] + [("one", 3.0), ("none", None), (None, 2.0), (None, 4.0)]
    return rows + [("same", 7.5)] * 500


@pytest.mark.parametrize(("parts", "few"), [(1024, 1 << 16), (16, 20), (8, 0)])
def test_quantiles(spark, parts, few):
    rows = corpus()
    df = spark.createDataFrame(rows, "kind string, v double")
    wanted = {"low": 0.05, "mid": 0.5, "high": 0.99, "all": 1.0, "none": 0.0}
    got = {r["kind"]: r for r in ranks.quantiles(df, "v", wanted, ["kind"], parts, few).collect()}
    assert set(got) == {k for k, _ in rows}
    for kind, r in got.items():
        for name, p in wanted.items():
            want = plain([v for k, v in rows if k == kind], p)
            assert r[name] == want or math.isnan(r[name]) and math.isnan(want), (kind, name)


def test_ranks_without_groups(spark):
    df = spark.range(1, 101).withColumnRenamed("id", "v")
    assert ranks.quantiles(df, "v", {"a": 0.07, "b": 0.95}).first()[:] == (7, 95)
    assert stats.percentile(df, "v", 99).first()[0] == 99 and stats.percentile(df.limit(0), "v", 99).first()[0] is None
    assert ranks.quantiles(df.limit(0).withColumn("g", F.lit(1)), "v", {"a": 0.5}, ["g"]).count() == 0


def test_a_hot_group_is_summed_up_where_it_lies(spark):
    """No exchange carries the group's rows."""
    df = spark.range(20_000).selectExpr("'x' AS g", "CAST(id AS DOUBLE) * 1.5 AS v")
    found = ranks.quantiles(df, "v", {"a": 0.5}, ["g"], few=100)
    assert found.first()["a"] == 1.5 * 9_999
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan and "collect_" not in plan


@pytest.mark.parametrize("parts", [None, 1, 5])
def test_pages(spark, parts):
    rng = random.Random(2)
    rows = [(i, rng.choice([None, "a", "b", "c" * 9, "é"]), rng.randrange(3), f"text {i}") for i in range(500)]
    df = spark.createDataFrame(rows, "id long, at string, n int, text string").repartition(3)
    order = [("at", True), ("n", False)]
    key = lambda r: (r[1] is None, [-b for b in (r[1] or "").encode()] + [1], r[2], r[0])
    want = sorted(rows, key=key)
    for offset, limit in ((0, 7), (250, 20), (495, 20), (600, 5), (250, 0), (-3, 2)):
        page = ranks.page_at(df, order, "id", offset, limit, parts)
        assert [tuple(r) for r in page.collect()] == want[max(offset, 0) : max(offset, 0) + limit]
    last, seen = None, []
    for _ in range(30):
        page = [tuple(r) for r in ranks.page_after(df, order, "id", last, 20).collect()]
        seen += page
        if not page:
            break
        last = (page[-1][1], page[-1][2], page[-1][0])
    assert seen == want


def test_pages_of_odd_tables(spark):
    df = spark.createDataFrame([], "id long, at string")
    assert ranks.page_at(df, [("at", True)], "id", 5, 5).count() == 0 and ranks.page_after(df, [("at", True)], "id", None, 5).count() == 0
