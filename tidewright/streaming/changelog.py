"""Continuous aggregate, join and top-n that publish inserts, updates and deletes.

State lives in Spark's state store, one entry per group, value or row, so that a large group isn't one large object.  The
materialised result of the changes equals the batch answer; their order is kept within a key.  An aggregate over
insert-only input is formed in parts before the shuffle, and publishes one change for each group and micro-batch.  One
over other input publishes every row's change; its rows are packed before the shuffle, those of a group in an Arrow batch
as one binary, and so are its changes until they leave the operator.
"""

from __future__ import annotations

import datetime
import heapq
import json
import math
from collections.abc import Callable, Iterator
from decimal import Decimal, localcontext
from fractions import Fraction
from itertools import accumulate
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DecimalType, DoubleType, LongType, StringType, StructField, StructType

from tidewright.errors import EngineError
from tidewright.operators.changelog import ADDITIONS, ROW_KIND, with_kind

_KIND = StructField(ROW_KIND, StringType(), False)
#: How rows become text and back without loss.
_JSON = {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def _tag(value: Any) -> dict:
    for name, kind in (("timestamp", datetime.datetime), ("date", datetime.date)):
        if isinstance(value, kind):
            return {name: value.isoformat()}
    return {"decimal": str(value)} if isinstance(value, Decimal) else {"binary": bytes(value).hex()}


def _untag(value: dict) -> Any:
    made = {"timestamp": datetime.datetime.fromisoformat, "date": datetime.date.fromisoformat, "decimal": Decimal, "binary": bytes.fromhex}
    name, text = next(iter(value.items())) if len(value) == 1 else ("", None)
    return made[name](text) if name in made and isinstance(text, str) else value


def _dump(value: Any) -> str:
    return json.dumps(value, default=_tag)


def _load(text: str) -> Any:
    return json.loads(text, object_hook=_untag)


class ExactSum:
    """A sum from which numbers can be taken off again without loss; infinities and NaN are counted apart."""

    def __init__(self, text: str | None = None):
        n, d, *special = json.loads(text) if text else (0, 1, 0, 0, 0)
        self.total, self.special, self.kind = Fraction(int(n), int(d)), list(special[:3]), (special[3:] or ["int"])[0]

    def add(self, value: Any, sign: int) -> None:
        if isinstance(value, float):
            self.kind = "float"
            if math.isnan(value) or math.isinf(value):
                self.special[0 if math.isnan(value) else 1 if value > 0 else 2] += sign
                return
        self.total += sign * Fraction(value)

    def value(self) -> float | int:
        nan, plus, minus = self.special
        if nan or plus and minus:
            return math.nan
        if plus or minus:
            return math.inf if plus else -math.inf
        return int(self.total) if self.kind == "int" and self.total.denominator == 1 else float(self.total)

    def text(self) -> str:
        return json.dumps([str(self.total.numerator), str(self.total.denominator), *self.special, self.kind])


def _order(value: Any) -> tuple:
    """NaN is the greatest."""
    return (1, 0) if isinstance(value, float) and math.isnan(value) else (0, value)


def _frozen(value: Any) -> Any:
    """Lists and structs as tuples, which can be keys of a dict."""
    if isinstance(value, dict):
        value = list(value.values())
    return tuple(map(_frozen, value)) if isinstance(value, (list, tuple)) else value


def _thawed(value: Any, kind: pa.DataType) -> Any:
    """What Arrow takes for a value of ``_frozen``."""
    if value is None:
        return None
    if pa.types.is_struct(kind):
        return {f.name: _thawed(x, f.type) for f, x in zip(kind, value, strict=True)}
    return [_thawed(x, kind.value_type) for x in value] if pa.types.is_list(kind) else value


class _Live:
    """How often each value of a column is there: what has changed, over the state, to which it is written at times."""

    HELD = 200_000

    def __init__(self, state: Any, column: str, stored: bool, refresh: bool):
        self.state, self.column, self.stored, self.refresh = state, column, stored, refresh
        self.now: dict[Any, int] = {}
        self.was: dict[Any, int] = {}

    def _entry(self, value: Any) -> tuple[str, str]:
        return self.column, _dump(value + 0.0 if isinstance(value, float) else value)  # no -0.0

    def count(self, value: Any) -> int:
        have = self.now.get(value)
        if have is None:
            if len(self.now) >= self.HELD:
                self.write()
            found = self.state.getValue(self._entry(value)) if self.stored else None
            have = self.now[value] = self.was[value] = found[0] if found else 0
        return have

    def alive(self) -> Iterator[Any]:
        if self.stored:
            for (column, text), _ in self.state.iterator():
                if column == self.column and (value := _same_nan(_frozen(_load(text)))) not in self.now:
                    yield value
        yield from (v for v, n in self.now.items() if n > 0)

    def write(self) -> None:
        for value, n in self.now.items():
            if n > 0 and (n != self.was[value] or self.refresh):
                self.state.updateValue(self._entry(value), (n,))
            elif n <= 0 < self.was[value]:
                self.state.removeKey(self._entry(value))
            self.stored = self.stored or n > 0
        self.now, self.was = {}, {}


def _same_nan(value: Any) -> Any:
    """One object for every NaN, so that a dict finds it."""
    return math.nan if isinstance(value, float) and value != value else value


class _Extreme:
    """The least or greatest value while values come and go; the first of equal ones.

    When the best one goes, a heap of the next ones is made from all that are alive, and kept up; it holds the best ``HELD``
    at least, and all whose rank is ``worst`` or before.
    """

    HELD = 10_000

    def __init__(self, live: _Live, greatest: bool, number: bool, best: Any):
        self.live, self.greatest, self.number, self.best = live, greatest, number, best
        self.heap: list[tuple] | None = None
        self.held: set = set()
        self.worst: Any = None

    def _rank(self, value: Any) -> Any:
        if not self.number:
            return _Reversed(value) if self.greatest else value
        if value != value:
            return (not self.greatest, 0)
        return (True, -value) if self.greatest else (False, value)

    def added(self, value: Any) -> None:
        rank = self._rank(value)
        if self.best is None or rank < self._rank(self.best):
            self.best = value
        if self.heap is not None and value not in self.held and (self.worst is None or not self.worst < rank):
            heapq.heappush(self.heap, (rank, value))
            self.held.add(value)
            if len(self.heap) > 2 * self.HELD:
                self._hold(e for e in self.heap if self.live.count(e[1]) > 0)

    def gone(self, value: Any) -> None:
        if self.best is value or self.best == value:
            self.best = self._next()

    def _next(self) -> Any:
        while True:
            while self.heap:
                if self.live.count(self.heap[0][1]) > 0:
                    return self.heap[0][1]
                self.held.discard(heapq.heappop(self.heap)[1])
            if self.heap is not None and self.worst is None:
                return None
            self.worst = None
            self._hold((self._rank(v), v) for v in self.live.alive())

    def _hold(self, entries: Iterator[tuple]) -> None:
        best = heapq.nsmallest(self.HELD + 1, entries)
        if len(best) > self.HELD:
            best.pop()
            self.worst = best[-1][0]
        self.heap, self.held = best, {v for _, v in best}


class _Aggregates(StatefulProcessor):
    """``aggregates``: output name -> (function, input column or None); functions count, sum, avg, min, max."""

    def __init__(self, keys: list[str], aggregates: dict[str, tuple[str, str | None]], retractable: bool, ttl: int | None, kinds: dict[str, str]):
        self.keys, self.aggregates, self.retractable, self.ttl, self.kinds = keys, aggregates, retractable, ttl, kinds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("accumulators", "rows bigint, parts string", self.ttl)
        self.values = handle.getMapState("values", "a string, v string", "n bigint", self.ttl) if self.retractable else None

    def _before(self) -> tuple[int, dict]:
        n, parts = self.state.get() if self.state.exists() else (0, None)
        return n, _load(parts) if parts else {}

    def close(self) -> None:
        pass


class AggregateProcessor(_Aggregates):
    """For packed rows (``_packed``): every row's change, packed as well.  A retraction that finds its group empty has no effect."""

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        n, parts = self._before()
        wanted: dict[str, list[str]] = {}
        for name, (function, column) in self.aggregates.items():
            if function in ("min", "max"):
                wanted.setdefault(column, []).append(name)
        stored = bool(wanted) and self.values.exists()
        live = {column: _Live(self.values, column, stored, self.ttl is not None) for column in wanted}
        extremes = {}
        for column, names in wanted.items():
            kind = _plain(self.input.field(column).type)
            number = any(test(kind) for test in (pa.types.is_integer, pa.types.is_floating, pa.types.is_decimal, pa.types.is_boolean))
            for name in names:
                extremes[name] = _Extreme(live[column], self.aggregates[name][0] == "max", number, _same_nan(_frozen(parts.get(name, {}).get("best"))))
        for frame in rows:
            for keys, packed in zip(frame["k"], frame["r"], strict=True):
                batch = pa.ipc.read_record_batch(pa.py_buffer(packed), self.input)
                n, changes = self._changes(n, parts, batch, live, extremes)
                if changes.num_rows:
                    yield pd.DataFrame({"k": [keys], "r": [changes.serialize().to_pybytes()]})
        if n:
            for column in live.values():
                column.write()
            self.state.update((n, _dump(parts)))
        else:
            self.state.clear()
            if wanted:
                self.values.clear()

    def _changes(self, n: int, parts: dict, batch: pa.RecordBatch, live: dict[str, _Live], extremes: dict[str, _Extreme]) -> tuple[int, pa.RecordBatch]:
        sign = batch.column(ROW_KIND).to_numpy().astype(np.int64)
        free = n + np.cumsum(sign)
        # below zero the number of rows is held at zero: what would take it to a new low finds no row
        low = np.minimum.accumulate(np.minimum(free, 0))
        lost = low < np.concatenate([[0], low[:-1]])
        size = np.concatenate([[n], free - low])
        if lost.any():
            batch, sign = batch.filter(pa.array(~lost)), sign[~lost]
            size = size[np.concatenate([[True], ~lost])]
        counts: dict[str, np.ndarray] = {}
        for name, (_, column) in self.aggregates.items():
            if column is not None:
                part = parts.setdefault(name, {"n": 0})
                there = batch.column(column).is_valid().to_numpy(zero_copy_only=False)
                counts[name] = part["n"] + np.concatenate([[0], np.cumsum(sign * there)])
                part["n"] = int(counts[name][-1])
        best = {}
        for column, counted in live.items():
            best |= _running_extremes(batch.column(column), sign, counted, {k: (extremes[k], counts[k]) for k in extremes if self.aggregates[k][1] == column})
        out = []
        for name, (function, column) in self.aggregates.items():
            kind = self.output.field(name).type
            if function == "count":
                out.append(pa.array(size if column is None else counts[name]))
            elif function in ("sum", "avg"):
                out.append(_running_sums(batch.column(column), sign, counts[name], parts[name], function, self.kinds[name], kind))
            else:
                parts[name]["best"] = extremes[name].best
                values = [_thawed(v, kind) for v in best[name]] if pa.types.is_nested(kind) else best[name]
                out.append(pa.array(values, _plain(kind)).cast(kind))
        # states 0 (before the first row) to m; row i leads from state i to state i + 1
        alive = size > 0
        changed = np.zeros(len(sign), bool)
        for x in out:
            changed |= _differs(x)
        old, new = alive[:-1], alive[1:]
        shown = np.stack([old & (~new | changed), new & (~old | changed)], axis=1).ravel()
        at = np.stack([np.arange(len(sign)), np.arange(1, len(sign) + 1)], axis=1).ravel()[shown]
        names = np.stack([np.where(new, 0, 1), np.where(old, 2, 3)], axis=1).ravel()[shown]
        kinds = pa.array(["-U", "-D", "+U", "+I"]).take(pa.array(names))
        return int(size[-1]), pa.record_batch([*(x.take(pa.array(at)) for x in out), kinds], schema=self.output)


def _plain(kind: pa.DataType) -> pa.DataType:
    """Times as whole numbers, which have the same order."""
    return pa.int64() if pa.types.is_timestamp(kind) or pa.types.is_duration(kind) else pa.int32() if pa.types.is_date32(kind) else kind


def _differs(states: pa.Array) -> np.ndarray:
    """For each state but the first, whether it differs from the one before."""
    if pa.types.is_nested(states.type):
        values = [repr(v) for v in states.to_pylist()]
        return np.array([a != b for a, b in zip(values, values[1:], strict=False)], bool)
    if pa.types.is_floating(states.type):
        states = states.view(pa.int64() if states.type == pa.float64() else pa.int32())
    a, b = states.slice(0, len(states) - 1), states.slice(1)
    return pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(a.is_null(), b.is_null())).to_numpy(zero_copy_only=False)


def _running_extremes(column: pa.Array, sign: np.ndarray, live: _Live, wanted: dict[str, tuple[_Extreme, np.ndarray]]) -> dict[str, list]:
    """For each of ``wanted`` its values: before the first row, and after each."""
    extremes = [e for e, _ in wanted.values()]
    counts = next(iter(wanted.values()))[1].tolist()
    values = column.cast(_plain(column.type)).to_pylist()
    if pa.types.is_nested(column.type):
        values = [_frozen(v) for v in values]
    elif pa.types.is_floating(column.type):
        values = [_same_nan(v) for v in values]
    out = [[e.best] for e in extremes]
    for value, s, n in zip(values, sign.tolist(), counts[1:], strict=True):
        if value is not None:
            have = live.count(value)
            live.now[value] = max(have + s, 0)
            if s > 0:
                for e in extremes:
                    e.added(value)
            elif have == 1:
                for e in extremes:
                    e.gone(value)
            if n == 0:
                for e in extremes:
                    e.best = None
        for e, shown in zip(extremes, out, strict=True):
            shown.append(e.best)
    return dict(zip(wanted, out, strict=True))


def _running_sums(column: pa.Array, sign: np.ndarray, counts: np.ndarray, part: dict, function: str, kind: str, made: pa.DataType) -> pa.Array:
    """Exact sums, or their means: before the first row, and after each; null where no value is."""
    sums = ExactSum(part.get("sum"))
    none = counts == 0
    special = None
    if pa.types.is_integer(column.type) and sums.total.denominator == 1:
        low, high = (v or 0 for v in pc.min_max(column).as_py().values())
        most = max(abs(low), abs(high)) * len(column) + abs(int(sums.total))
        if most < 2**62:
            x = pc.fill_null(column.cast(pa.int64()), 0).to_numpy()
            up: Any = int(sums.total) + np.concatenate([[0], np.cumsum(sign * x)])
        else:
            up = list(accumulate((s * (v or 0) for s, v in zip(sign.tolist(), column.to_pylist(), strict=True)), initial=int(sums.total)))
        sums.total = Fraction(int(up[-1]))
        part["sum"] = sums.text()
        if function == "sum" and kind == "long":
            # where no value is, there is no sum to hold
            return pa.array(up, made, mask=none) if most < 2**62 else pa.array([None if z else v for v, z in zip(up, none, strict=True)], made)
        if function == "avg" and most < 2**53:
            return pa.array(up / np.where(none, 1, counts), made, mask=none)
        pairs: list[tuple[int, int]] = [(int(v), 1) for v in up]
    else:
        if pa.types.is_floating(column.type):
            x = column.cast(pa.float64()).to_numpy(zero_copy_only=False)
            there = column.is_valid().to_numpy(zero_copy_only=False)
            special = [before + np.concatenate([[0], np.cumsum(sign * (is_it & there))]) for before, is_it in zip(sums.special, (np.isnan(x), x == np.inf, x == -np.inf), strict=True)]
            sums.special = [int(v[-1]) for v in special]
            sums.kind = "float" if there.any() else sums.kind
            values = [v if f else None for v, f in zip(x.tolist(), np.isfinite(x), strict=True)]
        else:
            values = column.to_pylist()
        top, below = sums.total.numerator, sums.total.denominator
        pairs = [(top, below)]
        for v, s in zip(values, sign.tolist(), strict=True):
            if v is not None:
                a, b = v.as_integer_ratio() if not isinstance(v, str) else Fraction(v).as_integer_ratio()
                if below % b:
                    more = math.lcm(below, b) // below
                    top, below = top * more, below * more
                top += s * a * (below // b)
            pairs.append((top, below))
        sums.total = Fraction(top, below)
        part["sum"] = sums.text()
    out: list[Any] = []
    for i, ((top, below), n) in enumerate(zip(pairs, counts.tolist(), strict=True)):
        nan, plus, minus = (int(v[i]) for v in special) if special else sums.special
        if not n:
            out.append(None)
        elif nan or plus or minus:
            out.append(math.nan if nan or plus and minus else math.inf if plus else -math.inf)
        elif function == "avg":
            out.append(top / (below * n))
        elif kind == "decimal":
            out.append(_decimal(Fraction(top, below)))
        else:
            out.append(top / below if kind == "double" else Fraction(top, below))
    if kind == "long":
        out = [int(v) if isinstance(v, Fraction) and v.denominator == 1 else v if v is None else float(v) for v in out]
    return pa.array(out, made)


def _decimal(value: Fraction) -> Decimal:
    with localcontext() as c:
        c.prec = 76
        return Decimal(value.numerator) / Decimal(value.denominator)


def _time_mode(*ttl: int | None) -> str:
    """Spark lets state expire in queries on processing time only."""
    return "None" if all(t is None for t in ttl) else "ProcessingTime"


class PartialAggregateProcessor(_Aggregates):
    """For insert-only input that ``_partials`` has aggregated: adds the parts, and publishes once for each call."""

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        n, parts = self._before()
        shown = self._result(n, parts) if n else None
        sums = {name: ExactSum(part["sum"]) for name, part in parts.items() if "sum" in part}
        for row in rows:
            n += row["_n"]
            for name, (function, column) in self.aggregates.items():
                if column is None or not row[f"_n_{name}"]:
                    continue
                part = parts.setdefault(name, {"n": 0})
                part["n"] += row[f"_n_{name}"]
                value = row[f"_v_{name}"] if function != "count" else None
                if function in ("sum", "avg"):
                    whole = isinstance(value, Decimal) and value == value.to_integral_value() and self.inputs[name] != "decimal"
                    sums.setdefault(name, ExactSum()).add(int(value) if whole else value, 1)
                elif function in ("min", "max"):
                    some = [v for v in (value, math.nan if row[f"_nan_{name}"] else None, part.get("best")) if v is not None]
                    part["best"] = (max if function == "max" else min)(some, key=_order)
        for name, total in sums.items():
            parts[name]["sum"] = total.text()
        new = self._result(n, parts)
        if shown is None:
            yield self._row(key, new, "+I")
        elif repr(new) != repr(shown):
            yield self._row(key, shown, "-U")
            yield self._row(key, new, "+U")
        self.state.update((n, _dump(parts)))

    def _result(self, n: int, parts: dict) -> dict[str, Any]:
        out = {}
        for name, (function, column) in self.aggregates.items():
            part = parts.get(name, {"n": 0})
            if function == "count":
                out[name] = n if column is None else part["n"]
            elif not part["n"]:
                out[name] = None
            elif function == "sum":
                total = ExactSum(part["sum"])
                value = total.value() if self.kinds[name] != "decimal" else _decimal(total.total)
                out[name] = float(value) if self.kinds[name] == "double" else value
            elif function == "avg":
                total = ExactSum(part["sum"])
                out[name] = float(total.total / part["n"]) if not any(total.special) else total.value()
            else:
                out[name] = part["best"]
        return out

    def _row(self, key: Any, values: dict, kind: str) -> Row:
        return Row(**dict(zip(self.keys, key, strict=True)), **values, **{ROW_KIND: kind})


def _partials(changes: DataFrame, keys: list[str], aggregates: dict[str, tuple[str, str | None]]) -> DataFrame:
    """For each Arrow batch and key: ``_n`` rows, and for each aggregate of a column ``_n_`` values, ``_nan_`` of them NaN, and their sum, minimum or maximum."""
    types = {f.name: f.dataType for f in changes.schema}
    fields = [StructField(k, types[k]) for k in keys] + [StructField("_n", LongType())]
    work: list[tuple[str, str, str, str]] = []
    for name, (function, column) in aggregates.items():
        if column is None:
            continue
        kind = types[column].typeName()
        fields.append(StructField(f"_n_{name}", LongType()))
        if function != "count":
            fields.append(StructField(f"_nan_{name}", LongType()))
            total = DoubleType() if kind in ("double", "float") else DecimalType(38, types[column].scale if kind == "decimal" else 0)
            fields.append(StructField(f"_v_{name}", total if function in ("sum", "avg") else types[column]))
        work.append((name, function, column, kind))
    schema = StructType(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if pc.any(pc.invert(pc.is_in(batch.column(ROW_KIND), pa.array(ADDITIONS)))).as_py():
                raise EngineError("a retraction reached an aggregate over an insert-only input")
            columns = {k: batch.column(k) for k in keys}
            asked: list[tuple] = [([], "count_all")]
            for name, function, column, kind in work:
                x = batch.column(column)
                columns[f"n_{name}"] = x
                asked.append((f"n_{name}", "count"))
                if function == "count":
                    continue
                real = kind in ("double", "float")
                nan = pc.fill_null(pc.is_nan(x), False) if real else pa.array([False] * len(x), pa.bool_())
                columns[f"nan_{name}"] = nan.cast(pa.int64())
                asked.append((f"nan_{name}", "sum"))
                if function in ("sum", "avg"):
                    # as decimals, whole numbers can't overflow within a batch
                    columns[f"v_{name}"] = x.cast(pa.float64()) if real else x.cast(pa.decimal128(38, schema[f"_v_{name}"].dataType.scale))
                    asked.append((f"v_{name}", "sum"))
                else:
                    columns[f"v_{name}"] = pc.if_else(nan, pa.scalar(None, x.type), x)
                    asked.append((f"v_{name}", function))
            table = pa.table(columns).group_by(list(keys), use_threads=False).aggregate(asked)
            out = [*(table[k] for k in keys), table["count_all"]]
            for name, function, _, _ in work:
                out.append(table[f"n_{name}_count"])
                if function != "count":
                    out += [table[f"nan_{name}_sum"], table[f"v_{name}_{'sum' if function in ('sum', 'avg') else function}"]]
            yield from pa.table(out, names=schema.names).cast(to_arrow_schema(schema)).to_batches()

    return changes.mapInArrow(run, schema)


def _packed(changes: DataFrame, keys: list[str], columns: list[str]) -> tuple[DataFrame, pa.Schema, pa.Schema]:
    """For each Arrow batch and group one row: the group as text (``g``), its keys (``k``), and its rows in order (``r``); the schemas of both."""
    texts = F.to_json(F.struct(*(F.col(k) + F.lit(0.0).cast(t) if (t := changes.schema[k].dataType).typeName() in ("double", "float") else F.col(k) for k in keys)), _JSON)  # no -0.0
    of_keys = to_arrow_schema(StructType([changes.schema[k] for k in keys]))
    of_rows = to_arrow_schema(StructType([changes.schema[c] for c in columns])).append(pa.field(ROW_KIND, pa.int8()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sign = pc.if_else(pc.is_in(batch.column(ROW_KIND), pa.array(ADDITIONS)), pa.scalar(1, pa.int8()), pa.scalar(-1, pa.int8()))
            groups = batch.column("_group").dictionary_encode()
            at = groups.indices.to_numpy()
            order = np.argsort(at, kind="stable")
            ends = np.cumsum(np.bincount(at, minlength=len(groups.dictionary)))
            made = [
                pa.table([batch.column(f.name) if f.name != ROW_KIND else sign for f in schema], names=schema.names).cast(schema).take(pa.array(order)).combine_chunks()
                for schema in (of_keys, of_rows)
            ]
            named, rows = (t.to_batches()[0] for t in made)
            starts = [0, *ends[:-1].tolist()]
            yield pa.record_batch(
                [
                    groups.dictionary.cast(pa.string()),
                    pa.array([named.slice(i, 1).serialize().to_pybytes() for i in starts], pa.binary()),
                    pa.array([rows.slice(i, j - i).serialize().to_pybytes() for i, j in zip(starts, ends.tolist(), strict=True)], pa.binary()),
                ],
                names=["g", "k", "r"],
            )

    asked = list(dict.fromkeys([*keys, *columns, ROW_KIND]))
    return changes.select(*asked, texts.alias("_group")).mapInArrow(run, "g string, k binary, r binary"), of_keys, of_rows


def _unpacked(of_keys: pa.Schema, of_rows: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = [*of_keys.names, *of_rows.names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            for k, r in zip(batch.column("k"), batch.column("r"), strict=True):
                named, rows = pa.ipc.read_record_batch(k.as_buffer(), of_keys), pa.ipc.read_record_batch(r.as_buffer(), of_rows)
                first = pa.array(np.zeros(rows.num_rows, np.int64))
                held.append(pa.record_batch([*(c.take(first) for c in named.columns), *rows.columns], names=names))
                if sum(b.num_rows for b in held) >= 10_000 or len(held) >= 1_000:
                    yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                    held = []
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return run


def aggregate_changes(changes: DataFrame, keys: list[str], aggregates: dict[str, tuple[str, str | None]], retractable: bool = True, ttl: int | None = None) -> DataFrame:
    """The changelog of ``SELECT keys, aggregates ... GROUP BY keys`` over a changelog."""
    changes = with_kind(changes)
    constant = not keys
    if constant:
        changes, keys = changes.withColumn("_g", F.lit(1)), ["_g"]
    types = dict(zip(changes.columns, (f.dataType for f in changes.schema), strict=True))
    fields, kinds = [], {}
    for name, (function, column) in aggregates.items():
        kind = types[column] if column else LongType()
        kind = LongType() if function == "count" else "double" if function == "avg" else kind
        if function == "sum" and kind != "double":
            name_of = kind.typeName()
            kind = "double" if name_of in ("double", "float") else DecimalType(38, kind.scale) if name_of == "decimal" else LongType()
        fields.append(StructField(name, StructType.fromDDL("x double")[0].dataType if kind == "double" else kind))
        kinds[name] = fields[-1].dataType.typeName()
    schema = StructType([*(StructField(k, types[k]) for k in keys), *fields, _KIND])
    made = AggregateProcessor if retractable else PartialAggregateProcessor
    processor = made(keys, aggregates, retractable, ttl, kinds)
    processor.inputs = {name: types[column].typeName() if column else "" for name, (_, column) in aggregates.items()}
    if retractable:
        packed, of_keys, processor.input = _packed(changes, keys, sorted({column for _, column in aggregates.values() if column}))
        processor.output = to_arrow_schema(StructType([*fields, _KIND]))
        out = packed.groupBy("g").transformWithStateInPandas(processor, "k binary, r binary", "Append", _time_mode(ttl))
        out = out.mapInArrow(_unpacked(of_keys, processor.output), schema)
    else:
        out = _partials(changes, keys, aggregates).groupBy(*keys).transformWithState(processor, schema, "Append", _time_mode(ttl))
    return out.drop("_g") if constant else out


class JoinProcessor(StatefulProcessor):
    """Rows of both sides, tagged by ``_side``, as JSON; each change is matched with the other side's rows."""

    def __init__(self, ttl: tuple[int | None, int | None]):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sides = [handle.getMapState(f"side_{i}", "r string", "n bigint", t) for i, t in enumerate(self.ttl)]

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        for row in rows:
            mine, other = self.sides[row["_side"]], self.sides[1 - row["_side"]]
            sign = 1 if row[ROW_KIND] in ADDITIONS else -1
            entry = (row["_row"],)
            have = mine.getValue(entry)[0] if mine.containsKey(entry) else 0
            if sign < 0 and not have:
                continue
            if have + sign:
                mine.updateValue(entry, (have + sign,))
            else:
                mine.removeKey(entry)
            for (match,), (n,) in list(other.iterator()):
                pair = (row["_row"], match) if row["_side"] == 0 else (match, row["_row"])
                for _ in range(n):
                    yield Row(_l=pair[0], _r=pair[1], **{ROW_KIND: "+I" if sign > 0 else "-D"})

    def close(self) -> None:
        pass


def join_changes(left: DataFrame, right: DataFrame, left_keys: list[str], right_keys: list[str], ttl: tuple[int | None, int | None] = (None, None)) -> DataFrame:
    """The changelog of an inner equi-join of two changelogs; columns of both sides (names must differ) and the kind.

    Rows with a null key neither match nor are kept.
    """
    sides = []
    for i, (df, keys) in enumerate(((with_kind(left), left_keys), (with_kind(right), right_keys))):
        data = [c for c in df.columns if c != ROW_KIND]
        # without nulls left out, the text of a row tells its columns apart
        text = F.to_json(F.struct(*data), _JSON)
        present = F.lit(True)
        for k in keys:
            present = present & F.col(k).isNotNull()
        named = [F.col(k).cast("string").alias(f"_k{j}") for j, k in enumerate(keys)]
        sides.append(df.where(present).select(*named, F.lit(i).alias("_side"), text.alias("_row"), F.col(ROW_KIND)))
    both = sides[0].unionByName(sides[1])
    out = both.groupBy(*(f"_k{j}" for j in range(len(left_keys)))).transformWithState(JoinProcessor(ttl), StructType.fromDDL(f"_l string, _r string, {ROW_KIND} string"), "Append", _time_mode(*ttl))
    schemas = [StructType([f for f in df.schema if f.name != ROW_KIND]) for df in (left, right)]
    out = out.select(F.from_json("_l", schemas[0], _JSON).alias("_l"), F.from_json("_r", schemas[1], _JSON).alias("_r"), ROW_KIND)
    return out.select("_l.*", "_r.*", ROW_KIND)


class TopNProcessor(StatefulProcessor):
    """The n first rows by one or more keys; ties by arrival.  Insert-only input keeps n rows, others all."""

    def __init__(self, n: int, orders: list[tuple[str, bool, bool]], retractable: bool, data: list[str]):
        self.n, self.retractable = n, retractable
        self.orders = [(data.index(c), down, nulls_first) for c, down, nulls_first in orders]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rows = handle.getMapState("rows", "seq bigint", "r string")
        self.next = handle.getValueState("next", "seq bigint")

    def _rank(self, item: tuple[int, list]) -> tuple:
        out: list[Any] = []
        for at, down, nulls_first in self.orders:
            value = item[1][at]
            place = (0 if nulls_first else 2, 0) if value is None else (1, _Reversed(_order(value)) if down else _order(value))
            out.append(place)
        return (*out, item[0])

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        held = {seq: json.loads(r) for (seq,), (r,) in self.rows.iterator()}
        seq = self.next.get()[0] if self.next.exists() else 0
        before = dict(held)
        top = sorted(held.items(), key=self._rank)[: self.n]
        for row in rows:
            data = json.loads(row["_row"])
            if row[ROW_KIND] in ADDITIONS:
                held[seq] = data
                seq += 1
            elif not self.retractable:
                raise EngineError("a retraction reached a top-n over an insert-only input")
            else:
                gone = next((s for s, d in held.items() if d == data), None)
                if gone is None:
                    continue
                del held[gone]
            new = sorted(held.items(), key=self._rank)[: self.n]
            if not self.retractable:
                held = dict(new)
            old_ids, new_ids = {s for s, _ in top}, {s for s, _ in new}
            for s, d in top:
                if s not in new_ids:
                    yield Row(_row=json.dumps(d), **{ROW_KIND: "-D"})
            for s, d in new:
                if s not in old_ids:
                    yield Row(_row=json.dumps(d), **{ROW_KIND: "+I"})
            top = new
        for s in before.keys() - held.keys():
            self.rows.removeKey((s,))
        for s in held.keys() - before.keys():
            self.rows.updateValue((s,), (json.dumps(held[s]),))
        self.next.update((seq,))

    def close(self) -> None:
        pass


class _Reversed:
    def __init__(self, value: Any):
        self.value = value

    def __lt__(self, other: _Reversed) -> bool:
        return other.value < self.value

    def __eq__(self, other: object) -> bool:
        return isinstance(other, _Reversed) and other.value == self.value


def _first_by(df: DataFrame, n: int, orders: list[tuple[str, bool, bool]]) -> DataFrame:
    """The n first rows of each Arrow batch, in their order: all that insert-only input can add to the n first of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows > n:
                columns, keys = {"at": pa.array(range(batch.num_rows))}, []
                for i, (c, down, nulls_first) in enumerate(orders):
                    x = batch.column(c)
                    nan = pc.fill_null(pc.is_nan(x), False) if pa.types.is_floating(x.type) else None
                    columns[f"null{i}"] = pc.is_null(x).cast(pa.int8())
                    columns[f"nan{i}"] = nan.cast(pa.int8()) if nan is not None else pa.array([0] * len(x), pa.int8())
                    columns[f"key{i}"] = pc.if_else(nan, pa.scalar(None, x.type), x) if nan is not None else x
                    way = "descending" if down else "ascending"
                    keys += [(f"null{i}", "descending" if nulls_first else "ascending"), (f"nan{i}", way), (f"key{i}", way)]
                best = pc.sort_indices(pa.table(columns), sort_keys=[*keys, ("at", "ascending")])[:n]
                batch = batch.take(pc.take(best, pc.sort_indices(best)))
            yield batch

    return df.mapInArrow(run, df.schema)


def top_n_changes(changes: DataFrame, n: int, order: str | list[tuple[str, bool, bool]], descending: bool = False, nulls_first: bool | None = None, retractable: bool = True) -> DataFrame:
    """The changelog of ``ORDER BY order LIMIT n`` over a changelog; ``order`` is a column or a list of (column, descending, nulls first)."""
    changes = with_kind(changes)
    data = [c for c in changes.columns if c != ROW_KIND]
    if isinstance(order, str):
        order = [(order, descending, (not descending) if nulls_first is None else nulls_first)]
    if not retractable and all(changes.schema[c].dataType.typeName() in _SORTED for c, _, _ in order):
        changes = _first_by(changes, n, order)
    texts = changes.select(F.to_json(F.array(*(F.to_json(F.struct(F.col(c).alias("v")), _JSON) for c in data))).alias("_cells"), ROW_KIND, F.lit(1).alias("_g"))
    row = F.concat(F.lit("["), F.array_join(F.transform(F.from_json("_cells", "array<string>"), lambda x: F.substring(x, F.lit(6), F.length(x) - 6)), ","), F.lit("]"))
    texts = texts.withColumn("_row", row)
    out = texts.groupBy("_g").transformWithState(TopNProcessor(n, order, retractable, data), StructType.fromDDL(f"_row string, {ROW_KIND} string"), "Append", "None")
    schema = StructType([f for f in changes.schema if f.name != ROW_KIND])
    cells = F.from_json("_row", "array<string>")
    return out.select(*(F.get(cells, i).cast(f.dataType).alias(f.name) for i, f in enumerate(schema)), ROW_KIND)


#: Types whose order in Arrow is that of the processor.
_SORTED = {"byte", "short", "integer", "long", "float", "double", "timestamp", "timestamp_ntz", "date"}
