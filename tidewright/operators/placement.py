"""Where rows go: hints that never change a result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def round_robin(df: DataFrame, n: int | None = None) -> DataFrame:
    return df.repartition(n or df.sparkSession.sparkContext.defaultParallelism)


def rescale(df: DataFrame, n: int | None = None) -> DataFrame:
    """Fewer partitions without a shuffle."""
    return df.coalesce(n or df.sparkSession.sparkContext.defaultParallelism)


def adaptive_shuffle(df: DataFrame) -> DataFrame:
    """Partitions of about equal size, set at run time."""
    return df.hint("rebalance")


def partition_by(df: DataFrame, target: Column, n: int) -> DataFrame:
    """Row to partition ``target`` (an integer expression)."""
    return df.repartitionById(n, F.pmod(target.cast("int"), F.lit(n)))


def broadcast(df: DataFrame) -> DataFrame:
    """Marks a table for broadcasting in a join; for tables of proven size."""
    return F.broadcast(df)
