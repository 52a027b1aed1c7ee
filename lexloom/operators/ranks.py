"""Exact ranks and deep pages without gathering what is ranked.

`quantiles` narrows ranges: it counts the values of each group by 1,024 equal parts of their range, where the rows are, which leaves one part that holds the rank; what lies there is counted by
value if it is little, and narrowed again if not. So a group, however hot, is only ever summed up, and no task holds its values.
`page_at` deals the keys out by range, writes them, counts the parts, and sorts only those that the page lies in; `page_after` needs no count, as
it goes on from a row's key.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.session import shared_folder

PARTS = 1024
FEW = 1 << 16  # rows of a part that are counted by value


def kept(df: DataFrame) -> DataFrame:
    """df, written in the shared folder."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def part_of(v: Column, low: Column, high: Column, parts: int) -> Column:
    """Which part of the range low to high (of its finite numbers) v lies in; rising with v, in the order that puts NaN last."""
    x, a, b = (c.cast("double") / 4 for c in (v, low, high))  # a quarter: differences stay finite
    inner = F.when(b > a, F.least(F.floor((x - a) / (b - a) * (parts - 3)), F.lit(parts - 4).cast("bigint"))).otherwise(0)
    infinite = float("inf")
    return F.when(F.isnan(x), parts - 1).when(x == infinite, parts - 2).when(x == -infinite, 0).otherwise(1 + inner).cast("int")


def quantiles(rows: DataFrame, value: str, wanted: dict[str, float | Decimal], by: list[str] | None = None, parts: int = PARTS, few: int = FEW) -> DataFrame:
    """For each group, and each name of wanted, the least value that at least this share of the group's values doesn't exceed.

    Nulls don't count; NaN is the greatest; a group without values has nulls; without `by` there is one row, also of no rows."""
    by = by or []
    names = [f"_g{i}" for i in range(len(by))]
    group = F.struct(*[F.col(f"`{c}`").alias(n) for c, n in zip(by, names, strict=True)]) if by else F.lit(0)
    all_rows = rows.select(group.alias("g"), F.col(f"`{value}`").alias("v"))
    own = all_rows.filter("v IS NOT NULL")
    finite = F.when(~F.isnan(F.col("v").cast("double")) & (F.abs(F.col("v").cast("double")) < float("inf")), F.col("v"))
    ends = [F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.min(finite).alias("flo"), F.max(finite).alias("fhi")]
    first = own.groupBy("g").agg(*ends)
    asked = F.array(*(F.struct(F.lit(k).alias("name"), F.lit(Decimal(str(p))).cast("decimal(12,10)").alias("p")) for k, p in wanted.items()))
    ask = first.withColumn("a", F.explode(asked)).withColumn("rank", F.greatest(F.ceil(F.col("a.p") * F.col("n").cast("decimal(20,0)")).cast("long"), F.lit(1).cast("long")))
    ask = kept(ask.select("g", "a.name", "rank", "n", "lo", "hi", "flo", "fhi"))
    done = None
    while True:
        over = F.col("lo").eqNullSafe(F.col("hi"))
        ended = ask.filter(over).select("g", "name", F.col("lo").alias("v"))
        done = ended if done is None else done.unionByName(ended)
        left = ask.filter(~over)
        state = left.agg(F.count("*"), F.max("n")).first()
        if not state[0]:
            break
        met = own.join(left.withColumnRenamed("g", "_of"), F.col("g").eqNullSafe(F.col("_of"))).filter((F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi")))
        if state[1] <= few:  # what is left lies in few rows: by value
            counts = met.groupBy("g", "name", "rank", "v").agg(F.count("*").alias("n"))
            upto = F.sum("n").over(Window.partitionBy("g", "name").orderBy("v"))
            found = counts.withColumn("upto", upto).filter(F.col("upto") >= F.col("rank")).groupBy("g", "name").agg(F.min("v").alias("v"))
            done = done.unionByName(found)
            break
        counts = met.groupBy("g", "name", "rank", part_of(F.col("v"), F.col("flo"), F.col("fhi"), parts).alias("part")).agg(*ends)
        upto = F.sum("n").over(Window.partitionBy("g", "name").orderBy("part"))  # `parts` rows at most
        counts = counts.withColumn("before", upto - F.col("n")).filter((F.col("before") < F.col("rank")) & (F.col("before") + F.col("n") >= F.col("rank")))
        ask = kept(counts.select("g", "name", (F.col("rank") - F.col("before")).alias("rank"), "n", "lo", "hi", "flo", "fhi"))
    wide = done.groupBy("g").agg(*(F.max(F.when(F.col("name") == k, F.col("v"))).alias(k) for k in wanted))
    if not by:
        return wide.select(*wanted) if wide.count() else rows.sparkSession.range(1).select(*(F.lit(None).cast(rows.schema[value].dataType).alias(k) for k in wanted))
    every = all_rows.select("g").distinct()
    out = every.join(wide.withColumnRenamed("g", "_of"), F.col("g").eqNullSafe(F.col("_of")), "left")
    return out.select(*(F.col("g")[n].alias(c) for c, n in zip(by, names, strict=True)), *wanted)


def page_at(rows: DataFrame, order: list[tuple[str, bool]], id_col: str, offset: int, limit: int, parts: int | None = None) -> DataFrame:
    """`limit` rows after `offset` in an order of (column, whether descending), then the id, which names one row. Nulls come last where descending, else first.

    Only ids and keys are dealt out; of these only the parts are sorted that the page lies in; and the rows of the page alone are read whole."""
    offset, limit = max(offset, 0), max(limit, 0)
    keys = [F.col(f"`{c}`").desc() if down else F.col(f"`{c}`").asc() for c, down in order] + [F.col(f"`{id_col}`").asc()]
    spark = rows.sparkSession
    cols = list(dict.fromkeys([*(c for c, _ in order), id_col]))
    dealt = rows.select(*(F.col(f"`{c}`") for c in cols))
    dealt = (dealt.repartitionByRange(parts, *keys) if parts else dealt.repartitionByRange(*keys)).withColumn("_part", F.spark_partition_id())
    path = shared_folder(spark)
    dealt.write.partitionBy("_part").parquet(path)
    held = spark.read.schema(dealt.schema).parquet(path)
    sizes, before, skip, mine = sorted(map(tuple, held.groupBy("_part").count().collect())), 0, 0, []  # a row a part
    for part, n in sizes:
        if before + n > offset and before < offset + limit:
            skip = skip if mine else offset - before
            mine.append(part)
        before += n
    page = held.filter(F.col("_part").isin(mine) if mine else F.lit(False)).orderBy(*keys).offset(skip).limit(limit)
    ids = page.select(F.col(f"`{id_col}`").alias("_id"))
    return rows.join(ids, F.col(f"`{id_col}`") == F.col("_id"), "left_semi").orderBy(*keys)


def page_after(rows: DataFrame, order: list[tuple[str, bool]], id_col: str, last: tuple | None, limit: int) -> DataFrame:
    """`limit` rows after the one with the key `last` (its values of order's columns, and its id), or the first ones: a filter and the best `limit`, however deep."""
    keys = [*order, (id_col, False)]
    if last is not None:
        after, same = F.lit(False), F.lit(True)
        for (c, down), v in zip(keys, last, strict=True):
            x = F.col(f"`{c}`")
            if v is None:  # nulls come last where descending, else first
                behind = F.lit(False) if down else x.isNotNull()
            else:
                behind = (x < v) | x.isNull() if down else x > v
            after = after | (same & F.coalesce(behind, F.lit(False)))
            same = same & x.eqNullSafe(F.lit(v))
        rows = rows.filter(after)
    return rows.orderBy(*(F.col(f"`{c}`").desc() if down else F.col(f"`{c}`").asc() for c, down in keys)).limit(max(limit, 0))
