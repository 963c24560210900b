"""Streams: a DataFrame, bounded or not, with the kinds of rows it may hold."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping
from contextlib import contextmanager
from typing import TYPE_CHECKING, Any

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from tidewright.duration import milliseconds
from tidewright.errors import EngineError, ResultOverflowError, SQLQueryError
from tidewright.operators import interval_join, placement, python_maps, windows
from tidewright.operators.changelog import ALL_KINDS, INSERT_ONLY, materialise
from tidewright.sources import custom, kafka, sinks
from tidewright.streaming import changelog, keyed, run

if TYPE_CHECKING:
    from tidewright.session import Pipeline

_TUNING = ("num_cpus", "num_gpus", "concurrency", "name", "batch_timeout")


def _options(kwargs: dict) -> dict:
    """Constructor arguments under their short names; placement hints are accepted and have no effect here."""
    out = {k: v for k, v in kwargs.items() if k not in _TUNING and not k.endswith("_serve_enabled")}
    out["args"] = out.pop("fn_constructor_args", None) or out.pop("args", ())
    out["kwargs"] = out.pop("fn_constructor_kwargs", None) or out.pop("kwargs", None)
    return out


class DataStream:
    """A lazy table.  Transformations give new streams, terminals run them; other DataFrame methods work by name."""

    def __init__(self, owner: Pipeline, df: DataFrame, kinds: frozenset[str] = INSERT_ONLY, from_sql: bool = False):
        self.owner, self.df, self.kinds, self.from_sql = owner, df, kinds, from_sql

    def _next(self, df: DataFrame, kinds: frozenset[str] | None = None) -> DataStream:
        return DataStream(self.owner, df, self.kinds if kinds is None else kinds, self.from_sql)

    def __getattr__(self, name: str) -> Any:
        if name.startswith("_"):
            raise AttributeError(name)
        found = getattr(self.df, name)
        if not callable(found) or isinstance(found, Column):
            return found

        def call(*args: Any, **kwargs: Any) -> Any:
            out = found(*(a.df if isinstance(a, DataStream) else a for a in args), **kwargs)
            return self._next(out) if isinstance(out, DataFrame) else out

        return call

    # transformations

    def map(self, fn: Any, *, schema: Any = None, ignore_errors: bool = False, batch_size: int | None = None, **tune: Any) -> DataStream:
        return self._next(python_maps.map_rows(self.df, fn, schema=schema, ignore_errors=ignore_errors, **_options(tune)))

    def flat_map(self, fn: Any, *, schema: Any = None, ignore_errors: bool = False, **tune: Any) -> DataStream:
        return self._next(python_maps.flat_map(self.df, fn, schema=schema, ignore_errors=ignore_errors, **_options(tune)))

    def map_batches(self, fn: Any, *, batch_size: int | None = None, batch_format: str = "default", schema: Any = None, **tune: Any) -> DataStream:
        return self._next(python_maps.map_batches(self.df, fn, batch_size=batch_size, batch_format=batch_format, schema=schema, **_options(tune)))

    def filter(self, fn: Any = None, *, expr: Any = None, batch_size: int | None = None, **tune: Any) -> DataStream:
        """By a column, SQL text (``expr``) or a Python function."""
        condition = expr if expr is not None else fn
        if isinstance(condition, (Column, str)):
            return self._next(self.df.filter(condition))
        return self._next(python_maps.filter_rows(self.df, fn, batch_size=batch_size, **_options(tune)))

    def with_column(self, name: str, expr: Column | str) -> DataStream:
        return self._next(self.df.withColumn(name, F.expr(expr) if isinstance(expr, str) else expr))

    def rename_columns(self, names: Mapping[str, str]) -> DataStream:
        return self._next(self.df.withColumnsRenamed(dict(names)))

    def random_shuffle(self, seed: int | None = None) -> DataStream:
        return self._next(self.df.orderBy(F.rand(seed)))

    def transform(self, fn: Callable[[DataFrame], DataFrame]) -> DataStream:
        return self._next(fn(self.df))

    def map_reduce(self, key: str, preprocess: Callable, process: Callable, postprocess: Callable, *, schema: Any, middle: Any, batch_process_size: int = 1, missing: str = "error") -> DataStream:
        return self._next(python_maps.map_reduce(self.df, key, preprocess, process, postprocess, schema=schema, middle=middle, batch_size=batch_process_size, missing=missing))

    def union(self, *others: DataStream) -> DataStream:
        out, kinds = self.df, self.kinds
        for o in others:
            out, kinds = out.unionByName(o.df, allowMissingColumns=True), kinds | o.kinds
        return self._next(out, kinds)

    def sql(self, query: str, /, *, table_name: str = "self", tables: Mapping[str, DataStream] | None = None, functions: Mapping[str, Callable] | None = None) -> DataStream:
        return self.owner._query(query, {**{k.lower(): v for k, v in (tables or {}).items()}, table_name.lower(): self}, functions or {})

    # time, keys, windows

    def with_event_time(self, timestamp: str, *, max_out_of_orderness: int | str = 0, idleness: int | str | None = None) -> DataStream:
        """A watermark on a timestamp column, or on a column of epoch milliseconds; Spark has no idleness of its own."""
        kind = dict(self.df.dtypes)[timestamp]
        time = F.timestamp_millis(timestamp) if kind in ("bigint", "int") else F.col(timestamp).cast("timestamp")
        df = self.df.withColumn("event_time" if kind in ("bigint", "int") else timestamp, time)
        return self._next(df.withWatermark("event_time" if kind in ("bigint", "int") else timestamp, f"{milliseconds(max_out_of_orderness)} milliseconds"))

    def assign_timestamps_and_watermarks(self, strategy: WatermarkStrategy) -> DataStream:
        return self.with_event_time(strategy.timestamp, max_out_of_orderness=strategy.delay)

    def key_by(self, *keys: str) -> KeyedStream:
        return KeyedStream(self, list(keys))

    group_by = key_by

    def interval_join(self, other: DataStream, *, left_key: str, right_key: str, left_timestamp: str, right_timestamp: str, lower_bound: int | str, upper_bound: int | str) -> DataStream:
        return self._next(interval_join.interval_join(self.df, other.df, left_key, right_key, left_timestamp, right_timestamp, lower_bound, upper_bound))

    def join(self, other: DataStream | DataFrame, *args: Any, **kwargs: Any) -> DataStream:
        """An interval join if bounds are given, else Spark's join."""
        if "lower_bound" in kwargs:
            return self.interval_join(other, **kwargs)
        return self._next(self.df.join(other.df if isinstance(other, DataStream) else other, *args, **kwargs))

    # changelogs

    def aggregate_changes(self, keys: list[str], aggregates: Mapping[str, tuple[str, str | None]], ttl: int | str | None = None) -> DataStream:
        out = changelog.aggregate_changes(self.df, keys, dict(aggregates), self.kinds != INSERT_ONLY, None if ttl is None else milliseconds(ttl))
        return self._next(out, ALL_KINDS)

    def join_changes(self, other: DataStream, left_keys: list[str], right_keys: list[str], ttl: tuple = (None, None)) -> DataStream:
        limits = tuple(None if t is None else milliseconds(t) for t in ttl)
        return self._next(changelog.join_changes(self.df, other.df, left_keys, right_keys, limits), frozenset({"+I", "-D"}))

    def top_n_changes(self, n: int, order: str, descending: bool = False, nulls_first: bool | None = None) -> DataStream:
        out = changelog.top_n_changes(self.df, n, order, descending, nulls_first, self.kinds != INSERT_ONLY)
        return self._next(out, frozenset({"+I", "-D"}))

    def materialise(self) -> DataStream:
        """The table that the changes amount to; a stream is drained first."""
        return self._next(materialise(run.drain(self.df) if self.df.isStreaming else self.df), INSERT_ONLY)

    # placement

    def broadcast(self) -> DataStream:
        return self._next(placement.broadcast(self.df))

    def rescale(self, n: int | None = None) -> DataStream:
        return self._next(placement.rescale(self.df, n))

    def round_robin(self, n: int | None = None) -> DataStream:
        return self._next(placement.round_robin(self.df, n))

    def adaptive_shuffle(self) -> DataStream:
        return self._next(placement.adaptive_shuffle(self.df))

    def partition_by(self, target: Column, n: int) -> DataStream:
        return self._next(placement.partition_by(self.df, target, n))

    # terminals

    def _bounded(self) -> DataFrame:
        return run.drain(self.df) if self.df.isStreaming else self.df

    @contextmanager
    def _sql_errors(self) -> Iterator[None]:
        """Errors inside the expressions of a query are the query's."""
        try:
            yield
        except PySparkException as e:
            if self.from_sql:
                raise SQLQueryError(str(e)) from e
            raise

    def collect(self, limit: int | None = None) -> list[Row]:
        """All rows; an error if there are more than ``limit``."""
        with self._sql_errors():
            df = self._bounded()
            if limit is None:
                return df.collect()
            rows = df.limit(limit + 1).collect()
        if len(rows) > limit:
            raise ResultOverflowError(f"more than {limit} rows")
        return rows

    take_all = collect

    def take(self, limit: int = 20) -> list[Row]:
        if isinstance(limit, bool) or not isinstance(limit, int) or limit < 0:
            raise EngineError("take needs a number of rows, 0 or more")
        with self._sql_errors():
            return self._bounded().take(limit)

    def show(self, limit: int = 20) -> None:
        with self._sql_errors():
            self._bounded().show(limit, truncate=False)

    def schema(self) -> Any:
        return self.df.schema

    def explain(self) -> str:
        return self.df._jdf.queryExecution().explainString(self.df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))

    def write_files(self, path: str, data_format: str, **options: Any) -> Any:
        return sinks.write_files(self.df, path, data_format, **options)

    def write_json(self, path: str, **options: Any) -> Any:
        return self.write_files(path, "json", **options)

    def write_csv(self, path: str, **options: Any) -> Any:
        return self.write_files(path, "csv", **options)

    def write_parquet(self, path: str, **options: Any) -> Any:
        return self.write_files(path, "parquet", **options)

    def write_text(self, path: str, **options: Any) -> Any:
        return self.write_files(path, "text", **options)

    def write_sql(self, sql: str, connection_factory: Callable, checkpoint: str | None = None) -> Any:
        return sinks.write_sql(self.df, sql, connection_factory, checkpoint)

    def write_kafka(self, topic: str, bootstrap_servers: str, **options: Any) -> Any:
        return kafka.write_kafka(self.df, topic, bootstrap_servers, **options)

    def write_redis(self, client_factory: Callable, **options: Any) -> Any:
        return sinks.write_redis(self.df, client_factory, **options)

    def write_iceberg(self, table: str, **options: Any) -> Any:
        return sinks.write_iceberg(self.df, table, **options)

    def write(self, make: Callable[[], custom.SinkFunction], checkpoint: str | None = None) -> Any:
        return custom.write_with(self.df, make, checkpoint)


class WatermarkStrategy:
    """A timestamp column and how late rows may be."""

    def __init__(self, timestamp: str, delay: int | str = 0, idleness: int | str | None = None):
        self.timestamp, self.delay, self.idleness = timestamp, delay, idleness

    @classmethod
    def for_monotonous_timestamps(cls, timestamp: str) -> WatermarkStrategy:
        return cls(timestamp)

    @classmethod
    def for_bounded_out_of_orderness(cls, delay: int | str, timestamp: str) -> WatermarkStrategy:
        return cls(timestamp, delay)

    def with_idleness(self, timeout: int | str) -> WatermarkStrategy:
        return WatermarkStrategy(self.timestamp, self.delay, timeout)


class KeyedStream:
    def __init__(self, stream: DataStream, keys: list[str]):
        self.stream, self.keys = stream, keys

    def process(self, function: keyed.KeyedProcessFunction, *, schema: Any, time_mode: str = "None", order: str | None = None) -> DataStream:
        run.use_rocksdb(self.stream.owner.spark)
        return self.stream._next(keyed.process_keyed(self.stream.df, self.keys, function, schema, time_mode, order))

    def window(self, assigner: Any, *, timestamp: str = "event_time", allowed_lateness: int | str = 0) -> WindowedStream:
        return WindowedStream(self, assigner, timestamp, milliseconds(allowed_lateness))


class WindowedStream:
    def __init__(self, keyed_stream: KeyedStream, assigner: Any, timestamp: str, lateness: int):
        self.keyed, self.assigner, self.timestamp, self.lateness = keyed_stream, assigner, timestamp, lateness

    def aggregate(self, **aggregates: Column) -> DataStream:
        """Built-in aggregates, partly formed before the shuffle."""
        out = windows.window_aggregate(self.keyed.stream.df, self.assigner, self.keyed.keys, self.timestamp, **aggregates)
        return self.keyed.stream._next(out)

    def reduce(self, function: Callable[[dict, dict], dict], schema: Any = None) -> DataStream:
        """Folds a window's rows in order of time with a Python function; the window's rows meet in one list."""
        stream, df = self.keyed.stream, self.keyed.stream.df
        columns = df.columns
        listed = windows.window_aggregate(df, self.assigner, self.keyed.keys, self.timestamp, rows=F.array_sort(F.collect_list(F.struct(self.timestamp, *(c for c in columns if c != self.timestamp)))))

        def fold(row: dict) -> dict:
            rows = iter(row["rows"])
            out = {c: v for c, v in next(rows).items()}
            for r in rows:
                out = function(out, r)
            return out

        return stream._next(python_maps.map_rows(listed, fold, schema=schema or df.schema))


class StatementSet:
    """Several inserts and sinks that run as one."""

    def __init__(self, owner: Pipeline):
        self.owner, self._work = owner, []

    def add(self, terminal: Callable, /, *args: Any, **kwargs: Any) -> StatementSet:
        self._work.append((terminal, args, kwargs))
        return self

    def add_insert_sql(self, statement: str) -> StatementSet:
        return self.add(self.owner.execute_sql, statement)

    def execute(self, shared: Iterable[DataStream] = ()) -> list[Any]:
        """Runs all; bounded streams that several statements share are kept while they run."""
        if not self._work:
            raise EngineError("the statement set is empty")
        kept = [s.df.persist() for s in shared if not s.df.isStreaming]
        try:
            return [terminal(*args, **kwargs) for terminal, args, kwargs in self._work]
        finally:
            for df in kept:
                df.unpersist()

    def explain(self) -> str:
        return "\n".join(getattr(t, "__name__", str(t)) for t, _, _ in self._work)
