"""User sources and sinks on Spark's Python data source interface."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamWriter, InputPartition, SimpleDataSourceStreamReader, WriterCommitMessage
from pyspark.sql.types import Row, StructType

from tidewright.errors import EngineError


class SourceFunction:
    """``read(position)`` gives rows (mappings) and the next position; ``commit(position)`` follows a durable checkpoint."""

    initial: dict = {"position": 0}

    def read(self, position: dict) -> tuple[list[dict], dict]:
        raise NotImplementedError

    def commit(self, position: dict) -> None:
        return None


def source(spark: SparkSession, fn: type[SourceFunction], schema: str | StructType, *args: Any, bounded: bool = False, **kwargs: Any) -> DataFrame:
    """A stream (or, if bounded, a table) of what a source function reads."""
    kind = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    name = f"tidewright_{fn.__name__.lower()}_{uuid.uuid4().hex[:8]}"

    class Stream(SimpleDataSourceStreamReader):
        def __init__(self) -> None:
            self.fn = fn(*args, **kwargs)

        def initialOffset(self) -> dict:
            return dict(self.fn.initial)

        def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
            rows, end = self.fn.read(start)
            return iter([tuple(r.get(n) for n in kind.names) for r in rows]), end

        def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
            return self.read(start)[0]

        def commit(self, end: dict) -> None:
            self.fn.commit(end)

    class Table(DataSourceReader):
        def partitions(self) -> list[InputPartition]:
            return [InputPartition(0)]

        def read(self, partition: InputPartition) -> Iterator[tuple]:
            work = fn(*args, **kwargs)
            at = dict(work.initial)
            while True:
                rows, then = work.read(at)
                yield from (tuple(r.get(n) for n in kind.names) for r in rows)
                if then == at:
                    return
                at = then

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> StructType:
            return kind

        def simpleStreamReader(self, schema: StructType) -> Stream:
            return Stream()

        def reader(self, schema: StructType) -> Table:
            return Table()

    spark.dataSource.register(Source)
    return (spark.read if bounded else spark.readStream).format(name).load()


class TwoPhaseCommitSink:
    """``write(rows)`` prepares a transaction in a task and returns it; ``commit`` and ``abort`` get all of a batch."""

    def write(self, rows: Iterator[Row]) -> Any:
        raise NotImplementedError

    def commit(self, transactions: list[Any], batch_id: int) -> None:
        raise NotImplementedError

    def abort(self, transactions: list[Any], batch_id: int) -> None:
        raise NotImplementedError


@dataclass
class _Message(WriterCommitMessage):
    transaction: Any


def two_phase_sink(spark: SparkSession, sink: Callable[[], TwoPhaseCommitSink]) -> str:
    """Registers a sink; the result is the format for ``writeStream``."""
    name = f"tidewright_sink_{uuid.uuid4().hex[:8]}"

    class Writer(DataSourceStreamWriter):
        def write(self, iterator: Iterator[Row]) -> _Message:
            return _Message(sink().write(iterator))

        def commit(self, messages: list, batchId: int) -> None:
            sink().commit([m.transaction for m in messages if m is not None], batchId)

        def abort(self, messages: list, batchId: int) -> None:
            sink().abort([m.transaction for m in messages if m is not None], batchId)

    class Sink(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def streamWriter(self, schema: StructType, overwrite: bool) -> Writer:
            return Writer(self.options)

    Writer.__init__ = lambda self, options: None
    spark.dataSource.register(Sink)
    return name


class SinkFunction:
    """``open, write(row), flush, close`` for each task."""

    def open(self) -> None:
        return None

    def write(self, row: dict) -> None:
        raise NotImplementedError

    def flush(self) -> None:
        return None

    def close(self) -> None:
        return None


def write_with(df: DataFrame, make: Callable[[], SinkFunction], checkpoint: str | None = None):
    """Runs a sink function over all rows, a task at a time."""

    def task(rows: Iterator[Row]) -> None:
        out = make()
        out.open()
        try:
            for r in rows:
                out.write(r.asDict(recursive=True))
            out.flush()
        finally:
            out.close()

    if df.isStreaming:
        if checkpoint is None:
            raise EngineError("a stream's sink needs a checkpoint location")
        return df.writeStream.foreachBatch(lambda batch, _: batch.foreachPartition(task)).option("checkpointLocation", checkpoint).start()
    return df.foreachPartition(task)
