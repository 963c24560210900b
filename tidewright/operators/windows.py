"""Event-time windows, half-open in epoch milliseconds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.duration import milliseconds
from tidewright.errors import EngineError


@dataclass(frozen=True)
class TumblingWindow:
    """``[k * size + offset, ...)``."""

    size: int | str
    offset: int | str = 0

    def __post_init__(self) -> None:
        if milliseconds(self.size) <= 0:
            raise EngineError("a window's size must be positive")

    def assign(self, df: DataFrame, ts: Column) -> DataFrame:
        size = milliseconds(self.size)
        return _with_window(df, F.window(ts, _ms(size), _ms(size), _ms(milliseconds(self.offset) % size)))


@dataclass(frozen=True)
class SlidingWindow:
    """Every window of ``size`` that starts at a multiple of ``slide`` and holds the time; gaps if the slide is larger."""

    size: int | str
    slide: int | str
    offset: int | str = 0

    def __post_init__(self) -> None:
        if milliseconds(self.size) <= 0 or milliseconds(self.slide) <= 0:
            raise EngineError("a window's size and slide must be positive")

    def assign(self, df: DataFrame, ts: Column) -> DataFrame:
        size, slide = milliseconds(self.size), milliseconds(self.slide)
        offset = milliseconds(self.offset) % slide
        if slide <= size:
            return _with_window(df, F.window(ts, _ms(size), _ms(slide), _ms(offset)))
        out = _with_window(df, F.window(ts, _ms(slide), _ms(slide), _ms(offset)))
        out = out.where(F.unix_millis(ts) - F.col("window_start") < size)
        return out.withColumn("window_end", F.col("window_start") + size)


@dataclass(frozen=True)
class SessionWindow:
    """``[ts, ts + gap)`` merged where they overlap; events exactly a gap apart stay apart."""

    gap: int | str

    def __post_init__(self) -> None:
        if milliseconds(self.gap) <= 0:
            raise EngineError("a session's gap must be positive")

    def column(self, ts: Column) -> Column:
        # Spark joins events exactly a gap apart, so its gap is a microsecond less
        return F.session_window(ts, f"{milliseconds(self.gap) * 1000 - 1} microseconds")


def _ms(n: int) -> str:
    return f"{n} milliseconds"


def _with_window(df: DataFrame, window: Column) -> DataFrame:
    out = df.withColumn("window", window)
    return out.withColumns({"window_start": F.unix_millis("window.start"), "window_end": F.unix_millis("window.end")})


def window_aggregate(df: DataFrame, assigner: TumblingWindow | SlidingWindow | SessionWindow, keys: list[str], ts: str, **aggregates: Column) -> DataFrame:
    """One row per key and window: ``keys, window_start, window_end`` (milliseconds) and the aggregates.

    Works on bounded and unbounded input alike; partial sums are formed before the shuffle on key and window.
    """
    time = F.col(ts).cast("timestamp")
    if isinstance(assigner, SessionWindow):
        grouped = df.groupBy(*keys, assigner.column(time).alias("window")).agg(*(c.alias(n) for n, c in aggregates.items()))
        grouped = grouped.withColumns({"window_start": F.unix_millis("window.start"), "window_end": F.floor((F.unix_micros("window.end") + 1) / 1000)})
        return grouped.select(*keys, "window_start", "window_end", *aggregates)
    if isinstance(assigner, SlidingWindow) and milliseconds(assigner.slide) > milliseconds(assigner.size):
        rows = assigner.assign(df, time)
        return rows.groupBy(*keys, "window_start", "window_end").agg(*(c.alias(n) for n, c in aggregates.items()))
    size = milliseconds(assigner.size)
    slide = milliseconds(assigner.slide) if isinstance(assigner, SlidingWindow) else size
    window = F.window(time, _ms(size), _ms(slide), _ms(milliseconds(assigner.offset) % slide))
    grouped = df.groupBy(*keys, window.alias("window")).agg(*(c.alias(n) for n, c in aggregates.items()))
    return grouped.select(*keys, F.unix_millis("window.start").alias("window_start"), F.unix_millis("window.end").alias("window_end"), *aggregates)
