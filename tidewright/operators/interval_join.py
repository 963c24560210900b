"""Event-time interval join: pairs of one key whose times differ by an amount between two bounds, both included."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.duration import milliseconds
from tidewright.errors import EngineError


def interval_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, left_timestamp: str, right_timestamp: str, lower_bound: int | str, upper_bound: int | str) -> DataFrame:
    """All columns of both sides, ``left_`` and ``right_`` before the names, where ``lower <= right time - left time <= upper``.

    On bounded input, both sides are dealt by key and a time bucket as wide as the interval, a left row to the buckets that
    its interval touches (three at most), so that a busy key is spread over time.  On streams it is Spark's stream-stream
    join, which drops state by the bounds and the watermarks.
    """
    lower, upper = milliseconds(lower_bound), milliseconds(upper_bound)
    if upper < lower:
        raise EngineError("the lower bound is above the upper bound")
    a = left.select(*(F.col(c).alias(f"left_{c}") for c in left.columns))
    b = right.select(*(F.col(c).alias(f"right_{c}") for c in right.columns))
    lk, rk, lt, rt = F.col(f"left_{left_key}"), F.col(f"right_{right_key}"), F.col(f"left_{left_timestamp}"), F.col(f"right_{right_timestamp}")
    if left.isStreaming or right.isStreaming:
        span = lambda n: F.expr(f"INTERVAL '{n // 1000}.{n % 1000:03d}' SECOND") if n >= 0 else -F.expr(f"INTERVAL '{-n // 1000}.{-n % 1000:03d}' SECOND")
        return a.join(b, (lk == rk) & (rt >= lt + span(lower)) & (rt <= lt + span(upper)))
    left_ms, right_ms = F.unix_millis(lt.cast("timestamp")), F.unix_millis(rt.cast("timestamp"))
    width = max(1, upper - lower)
    first, last = F.floor((left_ms + lower) / width), F.floor((left_ms + upper) / width)
    a = a.where(lt.isNotNull()).withColumn("_bucket", F.explode(F.sequence(first, last)))
    b = b.withColumn("_bucket2", F.floor(right_ms / width))
    joined = a.join(b, (lk == rk) & (F.col("_bucket") == F.col("_bucket2")) & (right_ms - left_ms).between(lower, upper))
    return joined.drop("_bucket", "_bucket2")
