"""Element-wise Python: map, flat_map, map_batches, filter, map_reduce, in Arrow batches."""

from __future__ import annotations

import asyncio
import inspect
import logging
from collections.abc import Callable, Iterable, Iterator, Mapping
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import StructType

from tidewright.errors import EngineError

_LOG = logging.getLogger(__name__)

#: Rows that are looked at to infer the schema of a function's results.
SAMPLE = 50


def build(fn: Any, args: Iterable = (), kwargs: Mapping | None = None) -> Callable:
    """A function as it is; a class is instantiated, once for each task."""
    return fn(*args, **(kwargs or {})) if inspect.isclass(fn) else fn


def _inferred(df: DataFrame, make: Callable[[], Callable[[list[dict]], Iterable[Mapping]]], schema: StructType | str | None) -> StructType:
    if schema is not None:
        return StructType.fromDDL(schema) if isinstance(schema, str) else schema
    if df.isStreaming:
        raise EngineError("a function on a stream needs schema=")
    rows = make()([r.asDict(recursive=True) for r in df.limit(SAMPLE).collect()])
    if not rows:
        raise EngineError("no row to infer the schema from; give schema=")
    return from_arrow_schema(pa.Table.from_pylist([dict(r) for r in rows]).schema)


def _rows(df: DataFrame, make: Callable[[], Callable[[list[dict]], Iterable[Mapping]]], schema: StructType) -> DataFrame:
    """``make`` is called once for each task and returns the function from a batch's rows to new rows."""
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            out = list(work(batch.to_pylist()))
            for r in out:
                if not isinstance(r, Mapping):
                    raise EngineError("a record must be a mapping")
            yield from pa.Table.from_pylist([dict(r) for r in out], schema=arrow).to_batches()

    return df.mapInArrow(run, schema)


def _is_async(fn: Callable) -> bool:
    return inspect.iscoroutinefunction(fn) or inspect.iscoroutinefunction(getattr(fn, "__call__", None))


def _guarded(fn: Callable, ignore: bool) -> Callable:
    """With ``ignore``, a record whose function fails is dropped, and the failure logged; coroutine functions stay such."""

    async def call_async(x: Any) -> Any:
        try:
            return await fn(x)
        except Exception:
            if not ignore:
                raise
            _LOG.warning("a record is dropped, as its function failed", exc_info=True)
            return None

    if _is_async(fn):
        return call_async

    def call(x: Any) -> Any:
        try:
            return fn(x)
        except Exception:
            if not ignore:
                raise
            _LOG.warning("a record is dropped, as its function failed", exc_info=True)
            return None

    return call


def _applied(fn: Callable, rows: list[dict], limit: int | None) -> list[Any]:
    """Results in input order; coroutine functions run up to ``limit`` at a time."""
    if not _is_async(fn):
        return [fn(r) for r in rows]

    async def gather() -> list[Any]:
        out: list[Any] = [None] * len(rows)
        left = iter(enumerate(rows))

        async def worker() -> None:  # each takes the next row when it is done with one
            for i, r in left:
                out[i] = await fn(r)

        await asyncio.gather(*(worker() for _ in range(min(limit or 8, len(rows)))))
        return out

    return asyncio.run(gather())


def map_rows(df: DataFrame, fn: Any, *, args: Iterable = (), kwargs: Mapping | None = None, schema: StructType | str | None = None, ignore_errors: bool = False, async_buffer_size: int | None = None) -> DataFrame:
    """One record in, one record out."""

    def make() -> Callable[[list[dict]], list[Mapping]]:
        f = build(fn, args, kwargs)
        f = _guarded(f, True) if ignore_errors else f

        def work(rows: list[dict]) -> list[Mapping]:
            out = _applied(f, rows, async_buffer_size)
            return [r for r in out if r is not None] if ignore_errors else out

        return work

    return _rows(df, make, _inferred(df, make, schema))


def flat_map(df: DataFrame, fn: Any, *, args: Iterable = (), kwargs: Mapping | None = None, schema: StructType | str | None = None, ignore_errors: bool = False) -> DataFrame:
    """One record in, any number out, in order."""

    def make() -> Callable[[list[dict]], list[Mapping]]:
        f = _guarded(build(fn, args, kwargs), ignore_errors)
        return lambda rows: [x for made in _applied(f, rows, None) for x in (made or ())]

    return _rows(df, make, _inferred(df, make, schema))


def filter_rows(df: DataFrame, fn: Any, *, args: Iterable = (), kwargs: Mapping | None = None, batch_size: int | None = None) -> DataFrame:
    """Rows for which ``fn`` is true; with ``batch_size`` it gets lists of rows and returns as many booleans."""

    def make() -> Callable[[list[dict]], list[dict]]:
        f = build(fn, args, kwargs)

        def work(rows: list[dict]) -> list[dict]:
            if batch_size is None:
                return [r for r, k in zip(rows, _applied(f, rows, None), strict=True) if k]
            out = []
            for at in range(0, len(rows), batch_size):
                part = rows[at : at + batch_size]
                keep = list(f([dict(r) for r in part]))
                if len(keep) != len(part):
                    raise EngineError("a batch filter must return one boolean for each row")
                out += [r for r, k in zip(part, keep, strict=True) if k]
            return out

        return work

    return _rows(df, make, df.schema)


def _to_format(batch: pa.Table, kind: str) -> Any:
    if kind == "pandas":
        return batch.to_pandas()
    if kind == "pyarrow":
        return batch
    if kind in ("default", "numpy"):
        return {n: np.asarray(batch.column(n).to_pandas()) for n in batch.column_names}
    raise EngineError(f"unknown batch format {kind!r}")


def _to_table(out: Any) -> pa.Table:
    if isinstance(out, pa.Table):
        return out
    if isinstance(out, pa.RecordBatch):
        return pa.Table.from_batches([out])
    if isinstance(out, pd.DataFrame):
        return pa.Table.from_pandas(out, preserve_index=False)
    sizes = {len(v) for v in out.values()}
    if len(sizes) > 1:
        raise EngineError("the columns of a batch must have equal lengths")
    return pa.table({k: pa.array(list(v)) for k, v in out.items()})


def _regrouped(batches: Iterator[pa.RecordBatch], size: int | None) -> Iterator[pa.Table]:
    """The batches as they come, or, where ``size`` is larger, joined up to so many rows."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        rows = sum(b.num_rows for b in held)
        if not size or rows >= size:
            table = pa.Table.from_batches(held)
            whole = rows - rows % size if size else rows
            yield table.slice(0, whole)
            held = table.slice(whole).to_batches() if whole < rows else []
    if held:
        yield pa.Table.from_batches(held)


def map_batches(df: DataFrame, fn: Any, *, batch_size: int | None = None, batch_format: str = "default", args: Iterable = (), kwargs: Mapping | None = None, schema: StructType | str | None = None) -> DataFrame:
    """Column batches in, column batches out; ``batch_size`` is an upper bound."""

    def pieces(f: Callable, table: pa.Table) -> Iterator[pa.Table]:
        step = batch_size or max(1, table.num_rows)
        for at in range(0, table.num_rows, step):
            yield _to_table(f(_to_format(table.slice(at, step), batch_format)))

    if schema is None:
        if df.isStreaming:
            raise EngineError("a function on a stream needs schema=")
        sample = pa.Table.from_pylist([r.asDict(recursive=True) for r in df.limit(SAMPLE).collect()], schema=to_arrow_schema(df.schema))
        made = list(pieces(build(fn, args, kwargs), sample))
        if not made:
            raise EngineError("no row to infer the schema from; give schema=")
        kind = from_arrow_schema(made[0].schema)
    else:
        kind = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = build(fn, args, kwargs)
        for table in _regrouped(batches, batch_size):
            for out in pieces(f, table):
                yield from out.select(arrow.names).cast(arrow).to_batches()

    return df.mapInArrow(run, kind)


def map_reduce(df: DataFrame, key: str, preprocess: Callable, process: Callable, postprocess: Callable, *, schema: StructType | str, middle: StructType | str, batch_size: int = 1, missing: str = "error") -> DataFrame:
    """Splits each record, processes the parts in batches anywhere, and joins each record's parts again in their order.

    ``preprocess(record)`` gives parts (schema ``middle``), ``process(list of parts)`` as many parts, ``postprocess(dict of
    lists)`` the record.  Only one record's parts meet in a task.  ``missing`` says what happens to a record of which parts
    got lost: error, warning (it goes on with the rest) or ignore (it is dropped).
    """
    parts = StructType.fromDDL(middle) if isinstance(middle, str) else middle
    outer = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    kind = dict(df.dtypes)[key]
    wide = StructType.fromDDL(f"_id {kind}, _rank int, _total int")
    wide = StructType([*wide.fields, *parts.fields])

    def split(rows: list[dict]) -> Iterator[dict]:
        for r in rows:
            made = list(preprocess(r))
            for i, p in enumerate(made):
                yield {"_id": r[key], "_rank": i, "_total": len(made), **p}

    def batch(rows: list[dict]) -> Iterator[dict]:
        for at in range(0, len(rows), batch_size):
            part = rows[at : at + batch_size]
            got = list(process([{k: v for k, v in r.items() if k not in ("_id", "_rank", "_total")} for r in part]))
            for r, g in zip(part, got, strict=False):
                if g is not None:
                    yield {"_id": r["_id"], "_rank": r["_rank"], "_total": r["_total"], **g}

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values("_rank")
        if len(rows) < rows["_total"].iloc[0]:
            if missing == "error":
                raise EngineError("parts of a record are missing")
            if missing == "ignore":
                return pd.DataFrame({f.name: [] for f in outer})
        out = postprocess({f.name: rows[f.name].tolist() for f in parts})
        return pd.DataFrame([out])[[f.name for f in outer]]

    spread = _rows(df, lambda: split, wide)
    spread = spread if df.isStreaming else spread.hint("rebalance")
    done = _rows(spread, lambda: batch, wide)
    return done.groupBy(F.col("_id")).applyInPandas(join, outer)
