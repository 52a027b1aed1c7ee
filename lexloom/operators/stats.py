"""Counts of tables, and figures of timings and backups."""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.operators import ranks


def table_stats(tables: dict[str, DataFrame]) -> DataFrame:
    """A row for each table: name, rows."""
    return reduce(DataFrame.unionByName, [t.agg(F.count("*").alias("rows")).select(F.lit(n).alias("name"), "rows") for n, t in tables.items()])


def percentile(rows: DataFrame, value: str, p: float) -> DataFrame:
    """Nearest rank: the value at place ceil(p / 100 * n)."""
    return ranks.quantiles(rows, value, {"value": Decimal(str(p)) / 100})


def latency(rows: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """p50, p95, p99, avg, min and max."""
    by = by or []
    found = ranks.quantiles(rows, value, {"p50": 0.5, "p95": 0.95, "p99": 0.99}, by)
    sums = rows.groupBy(*by).agg(F.avg(value).alias("avg"), F.min(value).alias("min"), F.max(value).alias("max"))
    if not by:
        return found.crossJoin(F.broadcast(sums))  # single rows
    side = sums.select(*(F.col(c).alias(f"_{c}") for c in by), "avg", "min", "max")
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by])
    return found.join(side, same).drop(*(f"_{c}" for c in by))


def average_time(records: DataFrame, value: str = "total_time", last: int = 1000, order: str = "at") -> DataFrame:
    """Mean of the last records; 0 without any."""
    return records.orderBy(F.desc(order)).limit(last).agg(F.coalesce(F.avg(value), F.lit(0.0)).alias("average"))


def step_times(steps: DataFrame) -> DataFrame:
    return steps.groupBy("step").agg(F.sum("time").alias("time"))


def backup_stats(history: DataFrame) -> DataFrame:
    """One row of history (success, duration_ms, size): totals, and the mean duration of the successes."""
    return history.agg(
        F.count("*").cast("int").alias("total"),
        F.coalesce(F.sum(F.col("success").cast("int")), F.lit(0)).cast("int").alias("successful"),
        F.coalesce(F.sum((~F.col("success")).cast("int")), F.lit(0)).cast("int").alias("failed"),
        F.coalesce(F.avg(F.when(F.col("success"), F.col("duration_ms"))), F.lit(0.0)).alias("average_ms"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("size"),
    )


def backups_listed(history: DataFrame) -> DataFrame:
    return history.orderBy(F.desc("timestamp"), "id")


def backups_expired(history: DataFrame, keep: int = 7) -> DataFrame:
    """Successes beyond the newest ones to keep."""
    order = Window.partitionBy("success").orderBy(F.desc("timestamp"), "id")
    return history.filter("success").withColumn("nth", F.row_number().over(order)).filter(F.col("nth") > keep).drop("nth")
