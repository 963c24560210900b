"""A PySpark-native engine for batch and continuous analytics."""

from tidewright.errors import EngineError, ResultOverflowError, SQLQueryError
from tidewright.operators.windows import SessionWindow, SlidingWindow, TumblingWindow
from tidewright.session import Pipeline, pipeline
from tidewright.stream import DataStream, KeyedStream, StatementSet, WatermarkStrategy, WindowedStream
from tidewright.streaming.keyed import KeyedProcessFunction, ListStateDescriptor, MapStateDescriptor, StateTtl, ValueStateDescriptor

__all__ = [
    "DataStream", "EngineError", "KeyedProcessFunction", "KeyedStream", "ListStateDescriptor", "MapStateDescriptor", "Pipeline", "ResultOverflowError", "SQLQueryError", "SessionWindow",
    "SlidingWindow", "StateTtl", "StatementSet", "TumblingWindow", "ValueStateDescriptor", "WatermarkStrategy", "WindowedStream", "pipeline",
]
