"""Files, SQL databases and Redis."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql.types import Row

from tidewright.errors import EngineError

FORMATS = ("csv", "json", "parquet", "text")
#: Rows of one commit of a SQL sink.
SQL_BATCH = 128


def write_files(df: DataFrame, path: str, data_format: str, *, columns: list[str] | None = None, max_rows_per_file: int | None = None, mode: str = "append", checkpoint: str | None = None, options: dict | None = None):
    """Files in a folder; a stream's files are published exactly once."""
    if data_format not in FORMATS:
        raise EngineError(f"unknown format {data_format!r}")
    out = df.select(*columns) if columns else df
    if data_format == "text" and len(out.columns) != 1:
        raise EngineError("text needs one column")
    if data_format == "text":
        out = out.select(out[out.columns[0]].cast("string").alias("value"))
    options = dict(options or {})
    if data_format == "csv":
        options.setdefault("header", "true")
    if max_rows_per_file:
        options["maxRecordsPerFile"] = max_rows_per_file
    if df.isStreaming:
        if checkpoint is None:
            raise EngineError("a stream's sink needs a checkpoint location")
        return out.writeStream.format(data_format).options(**options).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    return out.write.format(data_format).options(**options).mode(mode).save(path)


def _each_batch(df: DataFrame, task: Callable[[Iterator[Row]], None], checkpoint: str | None):
    if df.isStreaming:
        if checkpoint is None:
            raise EngineError("a stream's sink needs a checkpoint location")
        return df.writeStream.foreachBatch(lambda batch, _: batch.foreachPartition(task)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    return df.foreachPartition(task)


def write_sql(df: DataFrame, sql: str, connection_factory: Callable[[], Any], checkpoint: str | None = None):
    """``executemany`` of a DB-API connection, SQL_BATCH rows a commit; at least once."""

    def task(rows: Iterator[Row]) -> None:
        connection = connection_factory()
        try:
            held: list[tuple] = []

            def flush() -> None:
                if held:
                    connection.cursor().executemany(sql, held)
                    connection.commit()
                    held.clear()

            for r in rows:
                held.append(tuple(r))
                if len(held) == SQL_BATCH:
                    flush()
            flush()
        finally:
            connection.close()

    return _each_batch(df, task, checkpoint)


def write_redis(df: DataFrame, client_factory: Callable[[], Any], *, key: Callable[[dict], str], value: Callable[[dict], Any], data_type: str = "string", prefix: str = "", ttl_seconds: int | None = None, checkpoint: str | None = None):
    """STRING, HASH, SET or LIST values through a client object."""
    if data_type not in ("string", "hash", "set", "list"):
        raise EngineError(f"unknown Redis type {data_type!r}")

    def task(rows: Iterator[Row]) -> None:
        client = client_factory()
        for r in rows:
            row = r.asDict(recursive=True)
            name, v = prefix + key(row), value(row)
            if data_type == "string":
                client.set(name, v)
            elif data_type == "hash":
                client.hset(name, mapping=v)
            elif data_type == "set":
                client.sadd(name, *(v if isinstance(v, (list, tuple, set)) else [v]))
            else:
                client.rpush(name, *(v if isinstance(v, (list, tuple)) else [v]))
            if ttl_seconds:
                client.expire(name, ttl_seconds)

    return _each_batch(df, task, checkpoint)


def redis_lookup(df: DataFrame, client_factory: Callable[[], Any], key: str, output: str = "redis_value", prefix: str = "") -> DataFrame:
    """Adds the value at each row's key, null if there is none; one ``mget`` for each batch."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client = client_factory()
        for b in batches:
            keys = b.column(key).to_pylist()
            asked = [prefix + str(k) for k in keys if k is not None]
            got = iter(client.mget(asked) if asked else [])
            values = [None if k is None else next(got) for k in keys]
            values = [v.decode() if isinstance(v, bytes) else v for v in values]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(values, pa.string())], names=[*b.schema.names, output])

    return df.mapInArrow(run, df.schema.add(output, "string"))


def redis_missing(df: DataFrame, client_factory: Callable[[], Any], key: str, prefix: str = "") -> DataFrame:
    """The rows whose key does not exist."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client = client_factory()
        for b in batches:
            keep = [k is None or not client.exists(prefix + str(k)) for k in b.column(key).to_pylist()]
            yield b.filter(pa.array(keep, pa.bool_()))

    return df.mapInArrow(run, df.schema)


def write_iceberg(df: DataFrame, table: str, mode: str = "append", condition: Any = None):
    """Append or overwrite of a table in a configured catalog."""
    if mode == "append":
        return df.writeTo(table).append()
    if mode == "overwrite":
        return df.writeTo(table).overwrite(condition) if condition is not None else df.writeTo(table).overwritePartitions()
    raise EngineError(f"unknown mode {mode!r}; for upserts use MERGE INTO")
