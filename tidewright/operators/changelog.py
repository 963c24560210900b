"""Changelogs: rows that carry their kind, and what they amount to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The column that holds a row's kind.
ROW_KIND = "_row_kind"
INSERT, BEFORE, AFTER, DELETE = "+I", "-U", "+U", "-D"
ADDITIONS, RETRACTIONS = (INSERT, AFTER), (BEFORE, DELETE)
INSERT_ONLY = frozenset({INSERT})
ALL_KINDS = frozenset({INSERT, BEFORE, AFTER, DELETE})


def with_kind(df: DataFrame, kind: str = INSERT) -> DataFrame:
    """``df`` as a changelog; rows without a kind are inserts."""
    if ROW_KIND in df.columns:
        return df.withColumn(ROW_KIND, F.coalesce(ROW_KIND, F.lit(kind)))
    return df.withColumn(ROW_KIND, F.lit(kind))


def materialise(changes: DataFrame) -> DataFrame:
    """The table that a bounded changelog amounts to: each row as often as it was added more than retracted.

    One partial aggregation and one shuffle on the rows; retractions of unknown rows have no effect.
    """
    if ROW_KIND not in changes.columns:  # inserts only
        return changes
    columns = [c for c in changes.columns if c not in (ROW_KIND, "_seq")]
    sign = F.when(F.col(ROW_KIND).isin(*ADDITIONS), 1).otherwise(-1)
    counted = changes.groupBy(*columns).agg(F.sum(sign).alias("_n")).where("_n > 0")
    return counted.withColumn("_n", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_n")))).select(*columns)


def fold_aggregate(changes: DataFrame, keys: list[str], sums: dict[str, str], count: str = "n") -> DataFrame:
    """Sums and counts of a bounded changelog by key, retractions taken off; groups without rows are gone."""
    sign = F.when(F.col(ROW_KIND).isin(*ADDITIONS), 1).otherwise(-1)
    out = changes.groupBy(*keys).agg(F.sum(sign).alias(count), *(F.sum(sign * F.col(c)).alias(name) for name, c in sums.items()))
    return out.where(F.col(count) > 0)
