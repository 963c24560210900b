"""Keyed processing with value, list and map state and timers."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from tidewright.duration import milliseconds
from tidewright.errors import EngineError


@dataclass(frozen=True)
class StateTtl:
    """How long an entry lives after it was written, or also read."""

    duration: int | str
    refresh_on_read: bool = False


@dataclass(frozen=True)
class ValueStateDescriptor:
    name: str
    schema: str
    ttl: StateTtl | None = None


@dataclass(frozen=True)
class ListStateDescriptor:
    name: str
    schema: str
    ttl: StateTtl | None = None


@dataclass(frozen=True)
class MapStateDescriptor:
    name: str
    key_schema: str
    schema: str
    ttl: StateTtl | None = None


class KeyedProcessFunction:
    """Subclasses name their states in ``states`` and override ``process`` and, with timers, ``on_timer``.

    Both may return a mapping, several, or None.
    """

    states: tuple = ()

    def process(self, value: dict, context: Context) -> Any:
        raise NotImplementedError

    def on_timer(self, timestamp: int, context: Context) -> Any:
        return None


class _Value:
    def __init__(self, state: Any, refresh: bool):
        self._state, self._refresh = state, refresh

    @property
    def value(self) -> Any:
        if not self._state.exists():
            return None
        got = self._state.get()
        if self._refresh:
            self._state.update(got)
        return got[0] if len(got) == 1 else tuple(got)

    @value.setter
    def value(self, new: Any) -> None:
        self._state.update(new if isinstance(new, tuple) else (new,))

    def clear(self) -> None:
        self._state.clear()


class _List:
    def __init__(self, state: Any, refresh: bool):
        self._state = state

    def append(self, item: Any) -> None:
        self._state.appendValue(item if isinstance(item, tuple) else (item,))

    def __iter__(self) -> Iterator:
        return iter([x[0] if len(x) == 1 else tuple(x) for x in (self._state.get() if self._state.exists() else ())])

    def __len__(self) -> int:
        return sum(1 for _ in self)

    def set(self, items: Iterable) -> None:
        made = [i if isinstance(i, tuple) else (i,) for i in items]
        self._state.put(made) if made else self._state.clear()

    def clear(self) -> None:
        self._state.clear()


class _Map:
    def __init__(self, state: Any, refresh: bool):
        self._state = state

    @staticmethod
    def _key(key: Any) -> tuple:
        return key if isinstance(key, tuple) else (key,)

    def __contains__(self, key: Any) -> bool:
        return self._state.exists() and self._state.containsKey(self._key(key))

    def __getitem__(self, key: Any) -> Any:
        if key not in self:
            raise KeyError(key)
        got = self._state.getValue(self._key(key))
        return got[0] if len(got) == 1 else tuple(got)

    def get(self, key: Any, default: Any = None) -> Any:
        return self[key] if key in self else default

    def __setitem__(self, key: Any, value: Any) -> None:
        self._state.updateValue(self._key(key), value if isinstance(value, tuple) else (value,))

    def __delitem__(self, key: Any) -> None:
        if key not in self:
            raise KeyError(key)
        self._state.removeKey(self._key(key))

    def items(self) -> Iterator[tuple]:
        for k, v in self._state.iterator():
            yield (k[0] if len(k) == 1 else tuple(k)), (v[0] if len(v) == 1 else tuple(v))

    def clear(self) -> None:
        self._state.clear()


class Context:
    """State and timers of the current key."""

    def __init__(self, handle: StatefulProcessorHandle, states: dict[str, Any], time_mode: str):
        self._handle, self._states, self._mode = handle, states, time_mode
        self.key: Any = None
        self.current_watermark: int = 0
        self.current_processing_time: int = 0

    def state(self, descriptor: Any) -> Any:
        return self._states[descriptor.name]

    def _timer(self, mode: str) -> None:
        if self._mode != mode:
            raise EngineError(f"this query's timers run in {self._mode}; one query has one kind of time")

    def register_event_time_timer(self, ts: int) -> None:
        self._timer("EventTime")
        self._handle.registerTimer(ts)

    def register_processing_time_timer(self, ts: int) -> None:
        self._timer("ProcessingTime")
        self._handle.registerTimer(ts)

    def delete_timer(self, ts: int) -> None:
        self._handle.deleteTimer(ts)


class _Adapter(StatefulProcessor):
    def __init__(self, function: KeyedProcessFunction, columns: list[str], time_mode: str, order: str | None):
        self.function, self.columns, self.time_mode, self.order = function, columns, time_mode, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        made = {}
        for d in self.function.states:
            ttl = milliseconds(d.ttl.duration) if d.ttl else None
            refresh = bool(d.ttl and d.ttl.refresh_on_read)
            if isinstance(d, ValueStateDescriptor):
                made[d.name] = _Value(handle.getValueState(d.name, d.schema, ttl), refresh)
            elif isinstance(d, ListStateDescriptor):
                made[d.name] = _List(handle.getListState(d.name, d.schema, ttl), refresh)
            else:
                made[d.name] = _Map(handle.getMapState(d.name, d.key_schema, d.schema, ttl), refresh)
        self.context = Context(handle, made, self.time_mode)

    def _out(self, result: Any) -> Iterator[Row]:
        if result is None:
            return
        for r in [result] if isinstance(result, Mapping) else result:
            yield Row(**{c: r.get(c) for c in self.columns})

    def _at(self, key: Any, times: Any) -> None:
        self.context.key = key[0] if len(key) == 1 else tuple(key)
        if self.time_mode != "None":
            self.context.current_processing_time = times.getCurrentProcessingTimeInMs()
            self.context.current_watermark = times.getCurrentWatermarkInMs() if self.time_mode == "EventTime" else 0

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        self._at(key, timerValues)
        if self.order:
            rows = sorted(rows, key=lambda r: r[self.order])
        for row in rows:
            yield from self._out(self.function.process(row.asDict(recursive=True), self.context))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        self._at(key, timerValues)
        yield from self._out(self.function.on_timer(expiredTimerInfo.getExpiryTimeInMs(), self.context))

    def close(self) -> None:
        pass


def process_keyed(df: DataFrame, keys: list[str], function: KeyedProcessFunction, schema: StructType | str, time_mode: str = "None", order: str | None = None) -> DataFrame:
    """Runs a function over each key's rows; ``order`` sorts the rows of a key within a micro-batch."""
    kind = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    if time_mode == "None" and any(d.ttl for d in function.states):
        time_mode = "ProcessingTime"  # without it, state can't expire
    return df.groupBy(*keys).transformWithState(_Adapter(function, kind.names, time_mode, order), kind, "Append", time_mode)
